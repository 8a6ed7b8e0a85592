"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``coordinates`` bins.  In round i every shingle is hashed anew into a bin; a
bin keeps the smallest hash of the first round that reached it, and a text is done when
none of its bins is empty.  Long texts are done after a round or two; from round
``coordinates`` on, round i puts all shingles into bin i - coordinates, so that every
coordinate fills after twice as many rounds at the latest.  Equal coordinates of two
sketches estimate the similarity with the concentration of as many independent hashes.

Texts with the same set of shingles are one class.  Bands of ``rows`` coordinates are the
buckets: two classes with 85 % of their shingles in common miss each other in all of 32
bands of 5 with a probability of 7e-9.  In a bucket of up to ``SMALL`` classes all pairs are
verified on their full sets.

A larger bucket is not multiplied out.  All buckets choose a center, the class that lies in
most large buckets, and each class is verified with its centers alone.  Classes linked
with a center c are in its group, and links among them change nothing.  For a link of x,
which is not linked with c, and any y, count the shingles they share within c and outside
it.  The former are at most i = min(|x and c|, |y and c|).  If the link needs more than i, x
and y share shingles outside c, need - i of them or more, and meet in a bucket of one of
their rarest: of so many that fewer than that are left over (prefix filter).  If it needs
no more than i, then y is smaller than c (else x would be linked with c), and both meet in
the bucket of what is small and near to c.  These buckets lack c, so they are smaller; they
are treated in the same way until none is left.  No pair of classes is passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.base import fresh, quoted, stage, without
from panelwise.llm.decontam import _bloom, _in
from panelwise.llm.simhash import components

OUT = ("n_shingles", "component_id", "kept")
SEED = 42
SMALL, LARGEST = 8, 1024  # classes of a bucket whose pairs are all verified, in the first round and at most
EMPTY = np.uint64(2**64 - 1)
GOLDEN = 0x9E3779B97F4A7C15
CELLS = 1 << 19  # shingles that are sketched together


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, words_per_shingle: int = 3) -> np.ndarray:
    """Sorted distinct hashes (XXH64) of a UTF-8 text's shingles.

    A-Z are lowered and words are split at ASCII white space; a text of fewer words than a
    shingle has is one shingle, one without words has none.
    """
    words = text.lower().split()  # on bytes, both know ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words_per_shingle].tolist()
    shingles = zip(starts, ends[words_per_shingle - 1 :].tolist(), strict=True)
    digests = b"".join([xxhash.xxh64_digest(joined[i:j], SEED) for i, j in shingles])
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))


def sketches(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """(set, coordinate): fast similarity sketches of sets that are not empty."""
    out = np.full((len(sets), coordinates), EMPTY)
    flat = out.reshape(-1)
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * coordinates):
        h = _mixed(hashes + np.uint64(GOLDEN * (i + 1) % 2**64))
        if i < coordinates:
            bins = ((h >> np.uint64(32)) * np.uint64(coordinates) >> np.uint64(32)).astype(np.int64)
        else:
            bins = i - coordinates
        np.minimum.at(flat, row * coordinates + bins, np.uint64(i << 32) | (h & np.uint64(0xFFFFFFFF)))
        open_ = (out == EMPTY).any(axis=1)
        if not open_.any():
            break
        left = open_[row]
        hashes, row = hashes[left], row[left]
    return out


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(set, band): a hash of the band's number and coordinates."""
    keys = np.tile(_mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLDEN)), (len(found), 1))
    for r in range(rows):
        keys = _mixed(keys * np.uint64(GOLDEN) + found[:, r : bands * rows : rows])
    return keys


def _runs(texts: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    """Sets of the texts in order, some at a time: up to ``CELLS`` shingles and one text more.

    A batch may hold 10,000 long texts; only those of a run are objects at once.
    """
    run, cells = [], 0
    for t in texts.cast(pa.binary()):
        run.append(shingle_set(t.as_py() or b"", words))
        cells += len(run[-1])
        if cells >= CELLS:
            yield run
            run, cells = [], 0
    if run:
        yield run


def _lists(values: list[np.ndarray], lengths: list[int]) -> pa.Array:
    """Lists of these lengths over the values, one after the other."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def _sketched(words: int, bands: int, rows: int):
    """Class, size and band keys of each text."""

    @F.arrow_udf("struct<class: binary, n: long, bands: array<long>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, sizes, keys = [], [], []
            for run in _runs(texts, words):
                full = [s for s in run if len(s)]
                keys.append(band_keys(sketches(full, bands * rows), bands, rows).ravel().view(np.int64))
                names += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in run]
                sizes += map(len, run)
            lists = _lists(keys, [bands if n else 0 for n in sizes])
            yield pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), lists], ["class", "n", "bands"])

    return of


def _sets(words: int):
    """Sets of the texts; each run is handed on by itself, so that no batch of sets is as large as one of texts."""

    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for run in _runs(texts, words):
                yield _lists([s.view(np.int64) for s in run], [len(s) for s in run])

    return of


def _passes(bloom):
    @F.arrow_udf("boolean")
    def of(hashes: pa.Array) -> pa.Array:
        return pa.array(_in(bloom.value, hashes.to_numpy().view(np.uint64)))

    return of


def _need(n: Column, m: Column, percent: int) -> Column:
    """Shingles that sets of n and m must share: 100 * shared >= percent * (n + m - shared)."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent) - 1e-9)


def _shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the sizes and sets of both and the number of shingles they share.

    Each side's sets are narrowed to its classes first.
    """
    one, other = (
        sets.join(pairs.select(F.col(c).alias("node")).distinct(), "node", "left_semi").select(
            F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("set").alias(f"{c}_set")
        )
        for c in "ab"
    )
    both = pairs.join(one, "a").join(other, "b")
    return both.withColumn("shared", F.size(F.array_intersect("a_set", "b_set")).cast("long"))


def _linked(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("a_n") + F.col("b_n") - F.col("shared"))


def _with_counts(entries: DataFrame) -> DataFrame:
    """Entries (bucket, node, n, far) of buckets with two classes or more, one of them far, and their count."""
    counts = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.max("far").alias("open"))
    return entries.join(counts.where("count > 1 AND open").select("bucket", "count"), "bucket")


def _small_pairs(small: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the classes of small buckets whose sizes allow a link, one of them far at least."""
    one, other = (small.select("bucket", F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("far").alias(f"{c}_far")) for c in "ab")
    fits = (F.col("a") < F.col("b")) & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (F.col("a_far") | F.col("b_far"))
    return one.join(other, "bucket").where(fits).select("a", "b").distinct()


def _centered(large: DataFrame, hubs: bool) -> DataFrame:
    """Classes of large buckets by the center of their bucket, each once: (group, center, node).

    A bucket's center is the class of it that lies in most large buckets.  ``hubs``: it takes
    over the best center that any of its classes has in another bucket, so that
    buckets of like classes have one center, of which it need not hold the class.
    Buckets of one group that choose one center go on as one.
    """
    weight = large.groupBy("node").agg(F.sum("count").alias("weight"))
    weighed = large.join(weight, "node")
    chosen = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "n", "node")).alias("center"))
    if hubs:
        liked = large.join(chosen, "bucket").groupBy("node").agg(F.max("center").alias("liked"))
        chosen = large.join(liked, "node").groupBy("bucket").agg(F.max("liked").alias("center"))
    chosen = chosen.select("bucket", F.col("center.node").alias("center"))
    group = F.xxhash64(F.col("bucket")["group"], "center").alias("group")
    return large.join(chosen, "bucket").select(group, "center", "node").distinct()


def _next_buckets(measured: DataFrame, percent: int) -> DataFrame:
    """What is left to be looked at of groups (group, a: center, b: member, shared, outside, near)."""
    least = measured.groupBy("group", "a").agg(F.min("b_n").alias("least_n"))
    measured = measured.join(least, ["group", "a"]).withColumn("far", ~F.col("near"))
    # what a link to the smallest possible partner needs
    partner = F.greatest(F.col("least_n"), F.ceil(F.col("b_n") * percent / F.lit(100.0) - 1e-9))
    needed = _need(F.col("b_n"), partner, percent)
    prefix = F.size("outside") - F.greatest(needed - F.col("shared"), F.lit(1).cast("long")) + 1
    own = measured.where(prefix > 0).select("group", F.col("b").alias("node"), F.col("b_n").alias("n"), "far", prefix.alias("prefix"), F.explode("outside").alias("shingle"))
    # Any order serves that is the same for all: first what no far class shares with another, then by rarity.
    counts = own.groupBy("group", "shingle").agg(F.count(F.lit(1)).alias("often"), F.max("far").alias("open"))
    useful = (F.col("often") > 1) & F.col("open")
    ordered = own.join(counts, ["group", "shingle"]).withColumn("useful", useful)
    place = F.row_number().over(Window.partitionBy("group", "node").orderBy("useful", "often", "shingle"))
    firsts = ordered.withColumn("place", place).where(F.col("useful") & (F.col("place") <= F.col("prefix")))
    of = lambda shingle: F.struct("group", shingle.alias("shingle")).alias("bucket")
    outer = firsts.select(of(F.col("shingle")), "node", "n", "far")
    inner = measured.where((F.col("shared") >= needed) & (F.col("far") | (F.col("b_n") < F.col("a_n"))))
    return outer.unionByName(inner.select(of(F.lit(None).cast("long")), F.col("b").alias("node"), F.col("b_n").alias("n"), "far"))


def class_links(entries: DataFrame, sets: DataFrame, percent: int, log: list[dict] | None = None) -> DataFrame:
    """Links (a, b) that connect all classes that share buckets and are similar enough.

    ``entries`` (bucket (group, shingle), node, n, far) and ``sets`` (node, n, set) are
    staged tables.  A round measures all its pairs in one join, and hands on only the sets
    of classes that still share a bucket.  From the second round on every group lacks the centers of the groups it
    came from, so the rounds end; what counts as small doubles from round to round, up
    to ``LARGEST``.
    """
    links, small = stage(entries.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), "no-links"), SMALL
    while True:
        counted = stage(_with_counts(entries), "buckets")
        if counted.isEmpty():
            return links
        pairs = _small_pairs(counted.where(F.col("count") <= small), percent)
        centered = _centered(counted.where(F.col("count") > small), hubs=small == SMALL).where("center <> node")
        small = min(2 * small, max(SMALL, LARGEST))
        to_center = centered.select("group", F.col("center").alias("a"), F.col("node").alias("b"))
        both = stage(to_center.unionByName(pairs.withColumn("group", F.lit(None).cast("long"))), "pairs")
        has_center = F.col("group").isNotNull()
        outside = F.when(has_center, F.sort_array(F.array_except("b_set", "a_set")))
        columns = ("group", "a", "b", "a_n", "b_n", "shared", _linked(percent).alias("near"), outside.alias("outside"))
        measured = stage(_shared(both, sets).select(*columns), "measured")
        found, measured = measured.where("near").select("a", "b"), measured.where(has_center)
        links = links.unionByName(found)
        if log is not None:
            log.append({"pairs": both.where(~has_center).count(), "to_center": measured.count(), "links": found.count()})
        if measured.where(~F.col("near")).isEmpty():
            return links
        entries = stage(_next_buckets(measured, percent), "entries")
        sets = stage(sets.join(entries.select("node").distinct(), "node", "left_semi"), "sets")


def minhash_groups(
    docs: DataFrame,
    words_per_shingle: int = 3,
    percent: int = 85,
    bands: int = 32,
    rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    log: list[dict] | None = None,
) -> DataFrame:
    """All rows, with the columns ``keep`` (all unless given), ``n_shingles``, ``component_id`` and ``kept``.

    Rows are linked if 100 * (shared shingles) >= percent * (shingles of either);
    ``component_id`` is the smallest id that can be reached over links, the row's own
    included, and ``kept`` whether it is the row's own.  A text of fewer words than a
    shingle has is one shingle.  Null, empty and wordless texts have no shingle and are
    linked with nothing, not even with each other.  Null ids are left out of the minimum; a
    group with no other id has a null component, and its rows count as kept.  Repeated rows
    get the same answer each.  Input columns named like an added one are replaced.  An empty
    table gives an empty result.  Shingles are told apart by 64-bit hashes, sets by 128-bit
    ones.  ``log`` receives the pairs verified in each round.
    """
    kept = without(docs if keep is None else docs.select(*map(quoted, keep)), *OUT).columns
    own, ident, row, text = fresh(docs, "sketch", "own_id", "row", "own_text")
    printed = docs.select(
        *map(quoted, kept),
        quoted(id_col).alias(ident),
        quoted(text_col).alias(text),
        F.monotonically_increasing_id().alias(row),
        _sketched(words_per_shingle, bands, rows)(quoted(text_col)).alias(own),
    )
    printed = stage(printed, "sketches")
    s = F.col(own)
    classes = printed.where(s["n"] > 0).groupBy(s["class"].alias("class"))
    one = F.max(F.struct(F.col(row).alias("row"), s["n"].alias("n"), s["bands"].alias("bands"))).alias("one")
    nodes = classes.agg(F.min(ident).alias("first_id"), one).select(F.col("one.row").alias("node"), "class", "first_id", "one.n", "one.bands")
    nodes = stage(nodes, "classes")
    banded = nodes.select(F.explode("bands").alias("band"), "node")
    several = banded.groupBy("band").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("band")
    bucket = F.struct(F.lit(0).cast("long").alias("group"), F.col("band").alias("shingle")).alias("bucket")
    entries = banded.join(several, "band").join(nodes.select("node", "n"), "node").select(bucket, "node", "n", F.lit(True).alias("far"))
    entries = stage(entries, "entries")
    # sets of the classes that share a bucket, from one text of each
    wanted = stage(entries.select("node", "n").distinct(), "wanted")
    hashed = F.xxhash64("node").alias("hash")
    bloom = _bloom(wanted.select(hashed), wanted.count())  # most texts need not be shuffled
    texts = printed.select(F.col(row).alias("node"), F.col(text).alias("text")).where(_passes(bloom)(hashed))
    sets = stage(wanted.join(texts, "node").select("node", "n", _sets(words_per_shingle)("text").alias("set")), "sets")
    roots = components(class_links(entries, sets, percent, log)).select("node", "root")
    rooted = nodes.select("node", "class", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    answer = rooted.join(smallest, "root").select(F.col("class").alias(f"{own}_class"), F.col("component").alias(f"{own}_component"))
    found = printed.drop(text).join(answer, s["class"] == F.col(f"{own}_class"), "left")
    component = F.when(s["n"] > 0, F.col(f"{own}_component")).otherwise(F.col(ident))
    return found.select(
        *map(quoted, kept),
        s["n"].alias("n_shingles"),
        component.alias("component_id"),
        F.col(ident).eqNullSafe(component).alias("kept"),
    )
