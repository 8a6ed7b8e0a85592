"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit for each bit that more than half of its shingles'
hashes have.  Two fingerprints of 64 bits that differ in three bits or fewer differ
in one bit or none in one of their two halves, so each half is an index: a
fingerprint looks up the ball of radius one around its half, and the whole distance
of every match is then checked.  Of a pair whose halves differ in one bit only one
side has that bit set, so each fingerprint looks up its half and what the half
becomes when one of its set bits is cleared; every link is found, none by chance.

Links run between distinct fingerprints: copies of a text, however many, are one
fingerprint.  Groups are connected components, found by alternating large-star and
small-star steps over staged edge tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.base import fresh, quoted, stage, without

OUT = ("fingerprint", "component_id")
BITS, HALF, SEED = 64, 32, 42


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 if it has no word.

    A-Z are lowered and words are split at ASCII white space; a text of fewer words
    than a shingle has is one shingle.  Repeated shingles count each time.
    """
    words = text.lower().split()  # on bytes, both know ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words_per_shingle].tolist()
    shingles = zip(starts, ends[words_per_shingle - 1 :].tolist(), strict=True)
    digests = b"".join([xxhash.xxh64_digest(joined[i:j], SEED) for i, j in shingles])
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, BITS // 8)
    set_ = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # a slice at a time: very long texts
        set_ += np.unpackbits(hashes[part : part + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_ * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(words_per_shingle: int):
    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = (fingerprint(t or b"", words_per_shingle) for t in texts.cast(pa.binary()).to_pylist())
            yield pa.array(np.fromiter(values, np.uint64, len(texts)).view(np.int64))

    return of


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b) of the distinct longs in column ``print`` that differ in 1 to ``max_bits`` bits.

    ``max_bits`` is 3 at most: two halves and balls of radius one find no more.
    """
    if max_bits > 3:
        raise ValueError("two indexes with balls of radius one find links of up to 3 bits")
    low = (1 << HALF) - 1
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("print", HALF).alias("value")),
        F.struct(F.lit(1).alias("half"), F.col("print").bitwiseAND(low).alias("value")),
    )
    table = prints.select(F.col("print").alias("b"), F.inline(halves))
    cleared = F.array(*[F.lit(1 << i) for i in range(HALF)])
    ball = F.concat(
        F.array(F.struct(F.col("value").alias("value"), F.lit(True).alias("same"))),
        F.transform(
            F.filter(cleared, lambda bit: F.col("value").bitwiseAND(bit) != 0),
            lambda bit: F.struct(F.col("value").bitwiseXOR(bit).alias("value"), F.lit(False).alias("same")),
        ),
    )
    probes = table.select(F.col("b").alias("a"), "half", F.inline(ball))
    near = hamming(F.col("a"), F.col("b")) <= max_bits
    once = ~F.col("same") | (F.col("a") < F.col("b"))
    return probes.join(table, ["half", "value"]).where(near & once).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the smallest node it is linked to.

    A node's edges are never collected: minima are partial aggregates that are joined
    back, and a node with very many edges is split like any skewed join key.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def simhash_groups(
    docs: DataFrame,
    words_per_shingle: int = 3,
    max_bits: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """All rows, with the columns ``keep`` (all unless given), ``fingerprint`` (16 hex digits) and ``component_id``.

    Rows whose fingerprints differ in ``max_bits`` bits or fewer are linked;
    ``component_id`` is the smallest id that can be reached over links, the row's own
    included.  Null and empty texts have fingerprint zero and are linked like any
    other.  Null ids are left out of the minimum; a group with no other id has a null
    component.  Repeated rows get the same answer each.  Input columns named like an
    added one are replaced.  An empty table gives an empty result.
    """
    kept = without(docs if keep is None else docs.select(*map(quoted, keep)), *OUT).columns
    (own,) = fresh(docs, "print")
    printed = docs.select(*map(quoted, kept), quoted(id_col).alias(f"{own}_id"), _fingerprints(words_per_shingle)(quoted(text_col)).alias(own))
    printed = stage(printed, "fingerprints")
    nodes = stage(printed.groupBy(F.col(own).alias("print")).agg(F.min(f"{own}_id").alias("first_id")), "prints")
    roots = components(near_pairs(nodes, max_bits)).select(F.col("node").alias("print"), "root")
    rooted = nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    answer = rooted.join(smallest, "root").select(F.col("print").alias(own), "component_id")
    found = printed.join(answer, own)
    hexed = F.lower(F.lpad(F.hex(F.col(own)), 16, "0"))
    return found.select(*map(quoted, kept), hexed.alias("fingerprint"), "component_id")
