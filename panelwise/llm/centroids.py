"""Centroid clustering with a LAESA pivot table.

The vectors' distances to a few fixed pivots are computed once and stored beside them.
A centroid's distances to the same pivots bound its distance to every vector from below,
by the largest difference between the two rows (triangle inequality).  In each round a
vector visits the centroids from the smallest bound on and gets the exact distance, in
whole numbers, of those whose bound does not exceed the best distance so far; bounds are
rounded down, so no centroid that could win or tie is passed over.

Each round is one pass over the stored table, which never moves: tasks give the sums of
their vectors by cluster, and only k rows of sums reach the driver, as do the k start
vectors and the candidates for pivots (``POOL`` vectors).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from panelwise.llm.base import fresh, quoted, stage, without

OUT = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
POOL = 256  # vectors among which pivots are sought
LARGEST = 1 << 26  # a component: squared distances of up to 256 components then fit into a long
SLACK = 1e-9  # relative error that bounds allow for


def whole_vectors(df: DataFrame, dims: int, scale: int, vector_col: str, name: str) -> DataFrame:
    """Rows with ``dims`` finite components, and these as floor(scale * x) in the column ``name``."""
    xs = quoted(vector_col)
    good = xs.isNotNull() & (F.size(xs) == dims) & F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(xs, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(whole, lambda x: F.abs(x) <= LARGEST)
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component times {scale} lies beyond {LARGEST}")))
    return df.where(F.coalesce(good, F.lit(False))).withColumn(name, checked)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(kind, copy=False)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    return ((a - b) ** 2).sum(axis=-1)


def choose_pivots(pool: np.ndarray, n: int) -> np.ndarray:
    """Up to n vectors of the pool: the first, then always the one farthest from those before."""
    chosen: list[int] = []
    far = np.full(len(pool), np.iinfo(np.int64).max)
    while len(chosen) < n and len(pool) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(pool, pool[chosen[-1]]))
    return pool[chosen]


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(vectors, p) for p in pivots], axis=1).astype(np.float64))


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector, its squared distance, and how many distances were computed.

    ``table`` holds the vectors' distances to the pivots.  Ties go to the smaller number.
    """
    n, k = len(vectors), len(centroids)
    to_pivots = pivot_distances(centroids, pivots)
    scale = np.maximum(table.max(axis=1, initial=1.0), to_pivots.max(initial=1.0))
    low = np.zeros((n, k))
    for p in range(len(pivots)):
        low = np.maximum(low, np.abs(table[:, p : p + 1] - to_pivots[:, p]))
    low = np.maximum(low - SLACK * scale[:, None], 0)
    bound = low * low * (1 - SLACK)
    order = np.argsort(bound, axis=1, kind="stable")
    best, which, visited = np.full(n, np.iinfo(np.int64).max), np.full(n, k), 0
    live = np.arange(n)
    for turn in range(k):
        c = order[live, turn]
        still = bound[live, c] <= best[live]  # bounds rise from turn to turn
        live, c = live[still], c[still]
        if not len(live):
            break
        d = squared(vectors[live], centroids[c])
        visited += len(live)
        better = (d < best[live]) | ((d == best[live]) & (c < which[live]))
        best[live[better]], which[live[better]] = d[better], c[better]
    return which, best, visited


def _tables(pivots: np.ndarray, names: tuple[str, str]):
    """Adds the distances to the pivots."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(names[0]), np.int64)
            found = pivot_distances(vectors, pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * len(pivots), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, names[1]])

    return add


def _sums(pivots: np.ndarray, centroids: np.ndarray, names: tuple[str, str]):
    """A task's vectors summed up by nearest centroid."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, visited = np.zeros_like(centroids), np.zeros(len(centroids), np.int64), 0
        for batch in batches:
            vectors, table = _matrix(batch.column(names[0]), np.int64), _matrix(batch.column(names[1]), np.float64)
            which, _, computed = nearest(vectors, table, centroids, pivots)
            visited += computed
            np.add.at(total, which, vectors)
            count += np.bincount(which, minlength=len(centroids))
        visits = np.zeros_like(count)
        visits[0] = visited
        yield pa.record_batch(
            [pa.array(np.arange(len(count))), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64())), pa.array(visits)],
            names=["cluster", "n", "total", "visited"],
        )

    return sums


def _assign(pivots: np.ndarray, centroids: np.ndarray, names: tuple[str, str], out: list[str]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, table = (_matrix(batch.column(c), kind) for c, kind in zip(names, (np.int64, np.float64), strict=True))
            which, distance, _ = nearest(vectors, table, centroids, pivots)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.array(which.astype(np.int32)), pa.array(distance)], [*out, "cluster", "distance"])

    return assign


def cluster_vectors(
    df: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: str = "",
    pivots: int = 16,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    log: list[dict] | None = None,
) -> DataFrame:
    """Rows with a vector of ``dims`` finite components, with all their columns, and their cluster.

    Adds ``cluster``, ``distance`` (squared, to its centroid), ``cluster_inertia`` and
    ``inertia`` (distances summed over the cluster and over all rows) and
    ``centroid_sha256`` (of the centroid's components as decimal numbers joined by commas).
    Components are floor(scale * x) throughout; one beyond 2^26 is an error.

    Centroids start as the k vectors with the smallest SHA-256 of ``seed`` and the id, ties
    by vector; rows without an id come last.  There are fewer centroids if there are fewer
    vectors.  Then come ``rounds`` rounds of assigning all rows and replacing each centroid
    that has any by the floor of their mean, and a last assignment.  Ties go to the smaller
    number.  Null, shorter, longer and partly null vectors are left out; repeated rows
    count each time; input columns named like an added one are replaced.  An empty table
    gives an empty result.  ``log`` receives the vectors and the distances computed in each
    round.
    """
    spark = df.sparkSession
    kept = without(df, *OUT)
    names = tuple(fresh(kept, "whole", "pivoted"))
    rows = whole_vectors(kept, dims, scale, vector_col, names[0])
    hashed = rows.select(F.sha2(F.concat(F.lit(seed), quoted(id_col).cast("string")).cast("binary"), 256).alias("h"), F.col(names[0]).alias("v"))
    first = [r.v for r in hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(max(k, POOL)).collect()]
    pool = np.array(first, np.int64).reshape(-1, dims)
    centroids, fixed = pool[:k].copy(), choose_pivots(pool, pivots)
    if not len(pool):
        return kept.limit(0).selectExpr("*", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    with_table = StructType([*rows.schema, StructField(names[1], ArrayType(DoubleType()))])
    stored = stage(rows.mapInArrow(_tables(fixed, names), with_table), "pivot-table")
    numbers = stored.select(*names)
    for _ in range(rounds):
        parts = numbers.mapInArrow(_sums(fixed, centroids, names), "cluster long, n long, total array<long>, visited long")
        cells = parts.select("cluster", "n", "visited", F.posexplode("total").alias("i", "x"))
        summed = cells.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("visited").alias("visited")).collect()
        for r in summed:
            if r.n:
                centroids[r.cluster, r.i] = r.x // r.n
        if log is not None:
            log.append({"vectors": sum(r.n for r in summed if r.i == 0), "computed": sum(r.visited for r in summed if r.i == 0)})
    out = [c for c in stored.columns if c not in names]
    schema = StructType([*kept.schema, StructField("cluster", IntegerType()), StructField("distance", LongType())])
    found = stage(stored.mapInArrow(_assign(fixed, centroids, names, out), schema), "clustered")
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = ", ".join(f"({c}, {inertia.get(c, 0)}L, {sum(inertia.values())}L, '{h}')" for c, h in enumerate(digests))
    return found.join(spark.sql(f"SELECT * FROM VALUES {facts} AS t(cluster, cluster_inertia, inertia, centroid_sha256)"), "cluster").select(
        *map(quoted, out), *OUT
    )
