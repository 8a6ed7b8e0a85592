"""Exact top-k inner products with multi-resolution segment statistics.

A vector's components are cut into segments; a segment keeps its mean and the length of
what deviates from it.  For two vectors, the product of the means times the segment's
length plus the product of the deviations bounds the inner product of the segment, and
the sums over all segments bound the whole: the upper bound of a product is the lower
bound of a distance.  Bounds are taken from a few segments to many; a pair whose bound
is below the query's k-th best score so far is dropped, and what is left is computed
exactly on whole numbers.

Vectors and queries are packed into blocks.  A block of vectors lies in one part, blocks of
queries are copied to every part, and a part is a task: it reads its queries first, then one
block of vectors after the other, so no pair of blocks is ever a row.  Queries beyond
HELD_BLOCKS blocks go in further rounds, to which the vectors are copied as well.  One
block of vectors gives every query a first threshold; after that a task keeps a running
list of the k best for each query and emits only those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.base import quoted, stage

SEGMENTS = (4, 16, 32)  # the finest bounds prune where vectors point in all directions
BLOCK, QUERY_BLOCK = 2048, 512
HELD_BLOCKS = 64  # deals of queries, a block each, whose running lists a task holds
EXACT = float(1 << 53)
PACKED = "block long, dim int, ids binary, numbers binary"


def _packed(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Blocks of rows (id, vector): whole numbers floor(scale * x) of the valid ones."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            vectors = batch.column("vector").cast(pa.list_(pa.float64()))
            ids, flat = batch.column("id").to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
            lengths = np.array([x or 0 for x in vectors.value_lengths().to_pylist()], np.int64)
            starts = np.cumsum(lengths) - lengths
            with np.errstate(over="ignore", invalid="ignore"):
                numbers = np.floor(flat * scale)
            broken = np.add.accumulate(np.append(0, ~np.isfinite(numbers)))
            valid = (broken[starts + lengths] == broken[starts]) & np.asarray(vectors.is_valid()) & np.asarray(batch.column("id").is_valid())
            for dim in np.unique(lengths[valid]).tolist():
                at = np.flatnonzero(valid & (lengths == dim))
                for i in range(0, len(at), size):
                    one = at[i : i + size]
                    matrix = numbers[starts[one][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part + count], pa.int64()),
                            pa.array([dim], pa.int32()),
                            pa.array([ids[one].astype("<i8").tobytes()], pa.binary()),
                            pa.array([matrix.astype("<f8").tobytes()], pa.binary()),
                        ],
                        ["block", "dim", "ids", "numbers"],
                    )
                    count += 1

    return rows.mapInArrow(pack, PACKED)


def segment_features(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of the matrix's rows from above."""
    dim = matrix.shape[1]
    if not dim:
        return np.zeros((len(matrix), 0))
    cuts = np.unique(np.arange(segments) * dim // segments)
    lengths = np.diff(np.append(cuts, dim))
    means = np.add.reduceat(matrix, cuts, axis=1) / lengths
    rest = matrix - np.repeat(means, lengths, axis=1)
    spread = np.sqrt(np.add.reduceat(rest * rest, cuts, axis=1))
    return np.concatenate([means * np.sqrt(lengths), spread], axis=1)


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs; what no long holds is the nearest long."""
    most = np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(1, vectors.shape[1])
    if most < EXACT:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(sum(int(a) * b for a, b in zip(v, whole, strict=True)), low), high) for v in vectors], np.int64)


class _Block:
    def __init__(self, dim: int, ids: bytes, numbers: bytes) -> None:
        self.ids = np.frombuffer(ids, "<i8")
        self.matrix = np.frombuffer(numbers, "<f8").reshape(len(self.ids), dim)
        self.features = [segment_features(self.matrix, s) for s in SEGMENTS]


class _Best:
    """The k best of each query of a block, as far as seen."""

    def __init__(self, queries: _Block, k: int, floor: np.ndarray | None) -> None:
        self.queries, self.k = queries, k
        self.ids = [np.zeros(0, np.int64)] * len(queries.ids)
        self.scores = [np.zeros(0, np.int64)] * len(queries.ids)
        self.floor = np.full(len(queries.ids), -np.inf) if floor is None else floor.copy()
        self.pairs = self.computed = 0  # pairs of a query and a vector met, and exact products among them

    def look(self, block: _Block) -> None:
        if not len(block.ids):
            return
        near = block.ids != self.queries.ids[:, None]
        for own, other in zip(self.queries.features, block.features, strict=True):
            bound = own @ other.T
            # a bound that is no number, of components whose squares overflow, leaves nothing out
            near &= ~(bound + 1e-6 + 1e-9 * np.abs(bound) < self.floor[:, None])
        self.pairs += near.size
        for q, query in enumerate(self.queries.matrix):
            at = np.flatnonzero(near[q])
            self.computed += len(at)
            if len(at):
                scores = np.concatenate([self.scores[q], exact_products(block.matrix[at], query)])
                ids = np.concatenate([self.ids[q], block.ids[at]])
                keep = np.lexsort((ids, ~scores))[: self.k]  # ~x: larger scores first, and no overflow
                self.ids[q], self.scores[q] = ids[keep], scores[keep]
                if len(keep) == self.k:
                    self.floor[q] = max(self.floor[q], float(np.nextafter(float(scores[keep[-1]]), -np.inf)))


def _meet(queries: DataFrame, blocks: DataFrame, parts: int, rounds: int, k: int) -> DataFrame:
    """(query block, place in it, query, vector, score) of the best in each part.

    Queries are copied to all parts and lie in one round, blocks of vectors are copied to
    all rounds and lie in one part.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Best] = {}
        now: tuple[int, int] | None = None

        def emit(number: int, best: _Best) -> pa.RecordBatch:
            sizes = [len(x) for x in best.ids]
            place = np.repeat(np.arange(len(sizes)), sizes)
            columns = [np.full(len(place), number), place, best.queries.ids[place], np.concatenate([*best.ids, []]), np.concatenate([*best.scores, np.zeros(0, np.int64)])]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query_block", "place", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(len(batch)):
                r = {name: batch.column(name)[i].as_py() for name in ("place", "dim", "asks", "block")}
                if now != (r["place"], r["dim"]):
                    for number, best in held.items():
                        yield emit(number, best)
                    held, now = {}, (r["place"], r["dim"])
                if not (r["asks"] or held):
                    continue  # vectors of a length that no query has
                block = _Block(r["dim"], batch.column("ids")[i].as_py(), batch.column("numbers")[i].as_py())
                if r["asks"]:
                    floor = batch.column("floor")[i].as_py()
                    held[r["block"]] = _Best(block, k, np.frombuffer(floor, "<f8") if floor else None)
                else:
                    for best in held.values():
                        best.look(block)
        for number, best in held.items():
            yield emit(number, best)

    def to_all(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asking = queries.withColumn("asks", F.lit(True)).withColumn("part", to_all(parts))
    asked = blocks.withColumns({"asks": F.lit(False), "floor": F.lit(None).cast("binary")}).withColumn("round", to_all(rounds))
    rows = asking.unionByName(asked).withColumn("place", F.col("part") * rounds + F.col("round")).drop("part", "round")
    dealt = rows.repartitionById(parts * rounds, "place").sortWithinPartitions("place", "dim", F.desc("asks"), "block")
    return dealt.mapInArrow(look, "query_block long, place long, query_id long, vec_id long, score long")


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query row.

    Components are taken as floor(scale * x).  Every row whose id is not the query's is
    a candidate; ties go to the smaller id; with fewer candidates all are returned.
    Rows with a null id, a null vector, or a component that is null, not finite, or not
    finite when scaled, take no part.  Only vectors of equal length meet; vectors of
    length 0 score 0.  Rows that share an id are searched and found each.  A score that
    no long holds is the nearest long.  Other columns are left out.  An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("vector"), is_query.alias("asks"))
    asking = rows.where("asks").select("id", "vector")
    blocks = stage(_packed(rows.select("id", "vector"), BLOCK, scale), "vector-blocks")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, blocks.count()))
    deals = max(1, -(-asking.count() // QUERY_BLOCK))
    rounds = -(-deals // HELD_BLOCKS)
    # a block's number is its task's and its place in it; a query block's task is its deal
    task, turn = F.shiftrightunsigned("block", 32), F.col("block").bitwiseAND((1 << 32) - 1)
    queries = stage(_packed(asking.repartition(deals), QUERY_BLOCK, scale), "query-blocks")

    # One block of vectors of each length gives a first threshold to all queries.
    least = blocks.groupBy("dim").agg(F.min("block").alias("block"))
    first = blocks.join(F.broadcast(least), ["block", "dim"], "left_semi").withColumn("part", F.lit(0))
    pilot = _meet(queries.withColumns({"floor": F.lit(None).cast("binary"), "round": task.cast("int")}), first, 1, deals, k)
    ranked = pilot.withColumn("nth", F.row_number().over(Window.partitionBy("query_block", "place").orderBy(F.desc("score"), "vec_id")))
    floors = ranked.where(F.col("nth") == k).groupBy("query_block").agg(F.collect_list(F.struct("place", "score")).alias("floors"))

    @F.arrow_udf("binary")
    def as_floor(found: pa.Array, ids: pa.Array) -> pa.Array:
        out = []
        for places, own in zip(found.to_pylist(), ids.to_pylist(), strict=True):
            floor = np.full(len(own) // 8, -np.inf)
            for p in places or []:
                floor[p["place"]] = np.nextafter(float(p["score"]), -np.inf)
            out.append(floor.astype("<f8").tobytes())
        return pa.array(out, pa.binary())

    floored = queries.join(floors, queries["block"] == floors["query_block"], "left").withColumn("floor", as_floor("floors", "ids"))
    copies = stage(floored.drop("floors", "query_block"), "query-floors").withColumn("round", F.pmod(task, F.lit(rounds)).cast("int"))
    # parts get blocks in turn, whether many tasks packed few or few packed many; the window has a row a task
    sizes = blocks.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    numbered = blocks.withColumn("task", task).join(F.broadcast(before), "task")
    dealt = numbered.withColumn("part", F.pmod(F.col("before") + turn, F.lit(parts)).cast("int")).drop("task", "before")
    best = _meet(copies, dealt, parts, rounds, k)
    rank = F.row_number().over(Window.partitionBy("query_block", "place").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
