"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document if the document has at least ``threshold`` of the
item's distinct shingles.  A MinHash signature of fixed length says nothing about a
short item inside a long document, so the signature is taken where the size is known,
on the side of the item: of an item with n shingles, at most n - need may be missing,
so the n - need + 1 shingles of smallest hash are a signature of which every document
that contains the item has at least one.  Items are partitioned by the logarithm of the
size they need, and a document probes only the partitions whose items it can hold.

Documents are scanned once.  Two Bloom filters of bounded size, whatever the benchmark,
are probed by every shingle: one of the signatures, by partition, and one of all item
shingles.  Only a document with a probable signature shingle hands anything on, namely
its probable item shingles.  Signature shingles are then joined by partition and text,
which gives the candidates, pairs of a document and an item; of these alone the shared
shingles are counted, on the shingles' texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.base import fresh, quoted, stage

CHUNK = 1 << 21  # bytes of text that are hashed at once
BLOOM_WORDS_MOST = 1 << 20  # 8 MB, the most that a filter has
SALTS = 16
PRIME, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd: both have inverses modulo 2**64
# ASCII letters and digits and all other characters beyond ASCII are parts of words.
_IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


class _Powers:
    """Powers of PRIME and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK)
            factors = np.full((2, size), [[PRIME], [pow(PRIME, -1, 1 << 64)]], np.uint64)
            factors[:, 0] = 1
            self.up, self.down = np.cumprod(factors, axis=1)
        return self.up[:n], self.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK bytes; a longer text is a run of its own."""
    row = 0
    while row < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1
        end = min(max(end, row + 1), len(offsets) - 1)
        yield row, end
        row = end


def hashed_shingles(texts: pa.Array, words: int, powers: _Powers) -> Iterator[tuple]:
    """For runs of texts: (rows, hashes, starts, ends, data), an entry per shingle.

    The shingle is ``data[start:end]``, from its first to its last word.  A text with
    fewer words than a shingle has is one shingle; one without words has none.
    """
    low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    raw = low.buffers()[2]
    whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    for first, last in _chunks(offsets):
        data = whole[offsets[first] : offsets[last]]
        bounds = offsets[first : last + 1] - offsets[first]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = _IN_WORD[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[bounds[:-1]] = inside[bounds[:-1]]  # a text ends a word
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | begins[1:]
        ends = np.flatnonzero(stops) + 1
        up, down = powers.get(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        word = _mixed((sums[ends] - sums[starts]) * down[starts])
        row = np.searchsorted(bounds, starts, "right") - 1
        count = np.bincount(row, minlength=len(bounds) - 1)
        n = min(words, len(word))
        total = word[: len(word) - n + 1].copy()
        for k in range(1, n):
            total = total * np.uint64(STEP) + word[k : len(word) - n + 1 + k]
        full = row[: len(word) - n + 1] == row[n - 1 :]
        full &= n == words
        at = np.flatnonzero(full)
        rows, hashes, begin, end = row[at], total[at], starts[at], ends[at + words - 1] if len(at) else at
        firsts = np.searchsorted(row, np.flatnonzero((count > 0) & (count < words)))
        if len(firsts):  # short texts
            short = [(row[i], i, i + count[row[i]]) for i in firsts.tolist()]
            tail = []
            for _, i, j in short:
                h = np.zeros(1, np.uint64)
                for w in word[i:j]:
                    h = h * np.uint64(STEP) + w
                tail.append(h[0])
            rows = np.concatenate([rows, [r for r, _, _ in short]])
            hashes = np.concatenate([hashes, np.array(tail, np.uint64)])
            begin = np.concatenate([begin, starts[firsts]])
            end = np.concatenate([end, ends[[j - 1 for _, _, j in short]]])
        yield rows + first, _mixed(hashes), begin, end, data


def _text(data: np.ndarray, start: int, end: int) -> str:
    """The words of a shingle, one space between them."""
    part = data[start:end].copy()
    part[~_IN_WORD[part]] = 0x20
    return " ".join(w for w in part.tobytes().decode().split(" ") if w)


def _bits(hashes: np.ndarray, words: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Word and bit of each hash in a Bloom filter, three times."""
    mask = np.uint64(words - 1)
    return tuple(
        (((hashes >> np.uint64(s)) & mask).astype(np.int64), (hashes >> np.uint64(s + 20)) & np.uint64(63)) for s in (0, 19, 38)
    )


def _distinct(rows: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the entries ``at``, the first of each row and hash."""
    return at[np.sort(np.unique(np.stack([rows[at], hashes[at].view(np.int64)]), axis=1, return_index=True)[1])]


def _by_class(hashes: np.ndarray, size_class: int) -> np.ndarray:
    """Hashes of shingles as the signatures of one size class have them."""
    return _mixed(hashes + np.uint64(PRIME * (size_class + 1) % 2**64))


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for word, bit in _bits(hashes, len(bits)):
        found &= (bits[word] >> bit) & np.uint64(1) == 1
    return found


def _item_shingles(items: DataFrame, words: int) -> DataFrame:
    """Distinct shingles (key, shingle, hash) of rows (key, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            for rows, hashes, starts, ends, data in hashed_shingles(batch.column("text"), words, powers):
                at = _distinct(rows, hashes, np.arange(len(rows)))
                texts = [_text(data, s, e) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                columns = [batch.column("key").take(pa.array(rows[at])), pa.array(texts, pa.string()), pa.array(hashes[at].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "shingle", "hash"])

    key = items.schema["key"].dataType.simpleString()
    return items.mapInArrow(scan, f"key {key}, shingle string, hash long").distinct()


def _hits(docs: DataFrame, words: int, classes: list[int], signed, every) -> DataFrame:
    """Probable item shingles of documents (key, text) with a probable signature shingle.

    Rows (key, size, shingle, classes): ``size`` is the number of the document's shingles,
    repeats included; ``classes`` has a bit for each size class, no larger than the
    document's, whose signatures the shingle is probably in.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            texts = batch.column("text")
            for rows, hashes, starts, ends, data in hashed_shingles(texts, words, powers):
                sizes = np.bincount(rows, minlength=len(texts))[rows]
                found = np.zeros(len(rows), np.int64)
                for c in classes:
                    at = np.flatnonzero(sizes >= 1 << c)
                    found[at[_in(signed.value, _by_class(hashes[at], c))]] |= 1 << c
                probable = np.zeros(len(texts), bool)
                probable[rows[found != 0]] = True
                at = np.flatnonzero(probable[rows])
                at = _distinct(rows, hashes, at[(found[at] != 0) | _in(every.value, hashes[at])])
                columns = [
                    batch.column("key").take(pa.array(rows[at])),
                    pa.array(sizes[at]),
                    pa.array([_text(data, s, e) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.string()),
                    pa.array(found[at]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "size", "shingle", "classes"])

    key = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(scan, f"key {key}, size long, shingle string, classes long")


def _bloom(hashed: DataFrame, count: int):
    """Bloom filter of the column ``hash``, at most BLOOM_WORDS_MOST words of 64 bits.

    Beyond 64 million bits it lets more through, and the joins have more to do.
    """
    words = min(BLOOM_WORDS_MOST, 1 << max(10, ceil(log2(max(1, count) / 4))))
    spots = F.array(
        *[
            F.struct(
                F.shiftrightunsigned("hash", s).bitwiseAND(words - 1).alias("word"),
                F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {s + 20}) & 63 as int))").alias("bit"),
            )
            for s in (0, 19, 38)
        ]
    )
    parts = hashed.select(F.inline(spots)).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[parts["word"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return hashed.sparkSession.sparkContext.broadcast(out)


def signatures(index: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of item shingles (key, shingle, hash): the signatures and the items.

    Signatures (item, need, class, shingle, hash) are the n - need + 1 shingles of smallest
    hash; items (item, shingles, need, texts) have all shingles.
    """
    need = F.greatest(F.ceil(F.size("own") * threshold - 1e-9), F.lit(1).cast("long"))
    sizes = index.groupBy(F.col("key").alias("item")).agg(F.sort_array(F.collect_list(F.struct("hash", "shingle"))).alias("own"))
    sized = sizes.select("item", F.size("own").cast("long").alias("shingles"), need.alias("need"), "own")
    size_class = F.floor(F.log2("need")).cast("int").alias("class")
    first = F.slice("own", F.lit(1), (F.col("shingles") - F.col("need") + 1).cast("int"))
    return sized.select("item", "need", size_class, F.inline(first)), sized.select("item", "shingles", "need", F.col("own.shingle").alias("texts"))


def _class_hash(hashes: Column, classes: Column) -> Column:
    @F.arrow_udf("long")
    def of(hashes: pa.Array, classes: pa.Array) -> pa.Array:
        h, c = hashes.to_numpy(zero_copy_only=False).view(np.uint64), classes.to_numpy(zero_copy_only=False)
        out = np.zeros(len(h), np.uint64)
        for one in np.unique(c).tolist():
            out[c == one] = _by_class(h[c == one], one)
        return pa.array(out.view(np.int64))

    return of(hashes, classes)


def candidate_pairs(hits: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (key, item) of a document and an item it has a signature shingle of.

    A shingle that most documents have is dealt over SALTS keys.
    """
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    probes = signed.select("item", "need", "class", "shingle", F.explode(every).alias("salt"))
    at = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda c: F.getbit("classes", c) == 1)
    asking = hits.where("classes <> 0").withColumn("class", F.explode(at)).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    met = asking.join(probes, ["class", "shingle", "salt"]).where("size >= need")
    return met.select("key", "item").distinct()


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, text_hash, item, shared, item_shingles, containment) of every contained item.

    A row per pair of a document and an item of which the document has at least
    ``threshold`` of the distinct shingles of ``words`` words, whatever stands between
    them.  Words are lowered runs of ASCII letters and digits and of characters beyond
    ASCII.  A text of fewer words is one shingle; null, empty and wordless texts have
    none and are in no pair.  Documents are told apart by id and text (``text_hash`` is
    Spark's xxhash64 of the text), so equal rows give one answer; null ids are an id.
    Equal items each count, items of one id and text once.  Other columns of either table
    are not looked at, whatever their names.  Empty tables give an empty result.
    """
    named = F.struct(quoted(item_col).alias("item"), F.xxhash64(quoted(item_text)).alias("text"))
    index = stage(_item_shingles(items.select(named.alias("key"), quoted(item_text).alias("text")), words), "item-shingles")
    signed, known = (stage(t, n) for t, n in zip(signatures(index, threshold), ("item-signatures", "item-index"), strict=True))
    classes = sorted(r[0] for r in signed.select("class").distinct().collect())  # a logarithm's values
    in_class = signed.select(_class_hash(F.col("hash"), F.col("class")).alias("hash"))
    blooms = _bloom(in_class, signed.count()), _bloom(index.select("hash"), index.count())
    rows = docs.select(F.struct(quoted(id_col).alias("id"), F.xxhash64(quoted(text_col)).alias("text")).alias("key"), quoted(text_col).alias("text"))
    hits = stage(_hits(rows, words, classes, *blooms), "item-hits")
    candidates = stage(candidate_pairs(hits, signed), "item-candidates")
    own = hits.join(candidates.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.collect_set("shingle").alias("own"))
    compared = candidates.join(known, "item").join(own, "key")
    verified = compared.withColumn("shared", F.size(F.array_intersect("texts", "own")).cast("long")).where("shared >= need")
    return verified.select(
        F.col("key")["id"].alias(id_col),
        F.col("key")["text"].alias("text_hash"),
        F.col("item")["item"].alias(item_col),
        "shared",
        F.col("shingles").alias("item_shingles"),
        (F.col("shared") / F.col("shingles")).alias("containment"),
    ).distinct()


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows that contain no item, with all their columns."""
    found = contained_items(docs, items, id_col=id_col, text_col=text_col, **how)
    own, ident, text = fresh(docs, "hash", "leaked_id", "leaked_text")
    leaked = stage(found.select(F.col(id_col).alias(ident), F.col("text_hash").alias(text)).distinct(), "leaked")
    rows = docs.withColumn(own, F.xxhash64(quoted(text_col)))
    left = rows.join(leaked, quoted(id_col).eqNullSafe(F.col(ident)) & (F.col(own) == F.col(text)), "left_anti")
    return left.select(*map(quoted, docs.columns))
