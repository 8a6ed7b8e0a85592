"""Source divergence audit by in-mapper stripes.

A task folds the whole documents of its partition into hash stripes: a term of a language
maps to the number of documents that hold it and to its occurrences by source.  When a
task's stripes hold ``STRIPE_CELLS`` counts they are handed to the shuffle and the task
goes on with empty ones, so its memory does not follow its partition.  Stripes of a
term meet after one shuffle by (language, term), sorted by Spark (which spills), and are
merged as they stream by.  A term is kept if enough documents of its language hold it;
the empty term, which no text has, carries the sources that occur.

The merged stripes then emit the divergences: they are dealt into pieces of at most about
``PIECE_TERMS`` terms of a language, each piece meets the totals of its language's sources,
and gives its part of every pair's sum and its own ten best terms of every source.  A
piece answers for one block of sources at a time, so a language with very many sources
does not make a large group either.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.base import quoted, stage

STRIPE_CELLS = 250_000  # counts that a task's stripes hold before they go to the shuffle
PIECE_TERMS = 2_048  # about as many terms of a language meet its totals in one group
BLOCK = 256  # sources that a group answers for
SLICE = 1 << 22  # bytes of a text that are split into terms at once
ONE = 1_000_000_000
LONGEST_EXACT = 9_000_000_000  # counts up to here times ONE fit into 64 bits

# Letters A-Z are lowered; these, a-z and all bytes of characters beyond ASCII are in terms.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

STRIPE = pa.schema(
    [("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
)
STRIPE_DDL = "lang string, term string, df long, sources array<string>, counts array<long>"


def term_counts(text: str) -> Counter:
    """Occurrences of each term (as UTF-8) in a text of any length."""
    folded, found, start = text.encode().translate(_FOLD), Counter(), 0
    while start < len(folded):
        end = folded.find(b" ", start + SLICE)
        end = len(folded) if end < 0 else end
        found.update(folded[start:end].split())
        start = end
    return found


def _rows(stripes: dict[tuple[str, bytes], dict]) -> Iterator[pa.RecordBatch]:
    """Stripes as rows; the entry under None is the document frequency."""
    items = list(stripes.items())
    for at in range(0, len(items), 10_000):
        part = items[at : at + 10_000]
        df = [s.pop(None) for _, s in part]
        yield pa.record_batch(
            [
                pa.array([lang for (lang, _), _ in part], pa.string()),
                pa.array([term.decode() for (_, term), _ in part], pa.string()),
                pa.array(df, pa.int64()),
                pa.array([list(s) for _, s in part], pa.list_(pa.string())),
                pa.array([list(s.values()) for _, s in part], pa.list_(pa.int64())),
            ],
            schema=STRIPE,
        )


def _fold(cells_most: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[tuple[str, bytes], dict] = {}
        cells = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                group = stripes.setdefault((lang, b""), {None: 0})
                cells += source not in group
                group.setdefault(source, 0)
                for term, n in term_counts(text).items():
                    stripe = stripes.get((lang, term))
                    if stripe is None:
                        stripes[lang, term] = {None: 1, source: n}
                        cells += 1
                    else:
                        cells += source not in stripe
                        stripe[None] += 1
                        stripe[source] = stripe.get(source, 0) + n
                if cells >= cells_most:
                    yield from _rows(stripes)
                    stripes, cells = {}, 0
        yield from _rows(stripes)

    return fold


def _merged(rows: pa.Table, min_docs: int) -> pa.Table:
    """One stripe per (lang, term) of rows that are sorted by both; rare terms go."""
    if not rows.num_rows:
        return rows
    key = [rows.column(c).combine_chunks() for c in ("lang", "term")]
    new = np.ones(rows.num_rows, bool)
    new[1:] = np.logical_or.reduce([pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False) for k in key])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    df = np.add.reduceat(rows.column("df").to_numpy(), first)
    kept = (df >= min_docs) | (pc.binary_length(key[1]).to_numpy()[first] == 0)
    sources, counts = (rows.column(c).combine_chunks() for c in ("sources", "counts"))
    of = group[pc.list_parent_indices(sources).to_numpy()]
    cells = pa.table({"group": of, "source": sources.flatten(), "count": counts.flatten()}).filter(pa.array(kept[of]))
    summed = cells.group_by(["group", "source"]).aggregate([("count", "sum")]).sort_by([("group", "ascending"), ("source", "ascending")])
    left = np.flatnonzero(kept)
    offsets = np.searchsorted(summed.column("group").to_numpy(), np.append(left, len(first)))
    at = pa.array(first[left])
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), summed.column(c).combine_chunks()) for c in ("source", "count_sum")]
    return pa.table([key[0].take(at), key[1].take(at), pa.array(df[left]), *lists], schema=STRIPE)


def _merge(min_docs: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = STRIPE.empty_table()  # the stripes of the last term, of which more may come
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_tables([open_, pa.Table.from_batches([batch.cast(STRIPE)])])
            last = rows.slice(rows.num_rows - 1)
            same = pc.and_(*[pc.equal(rows.column(c), last.column(c)[0]) for c in ("lang", "term")])
            cut = rows.num_rows - pc.sum(same).as_py()
            # what is known of the open term is folded, so that it does not grow with its stripes
            open_ = _merged(rows.slice(cut), 0).combine_chunks()
            yield from _merged(rows.slice(0, cut), min_docs).to_batches()
        yield from _merged(open_, min_docs).to_batches()

    return merge


def source_stripes(docs: DataFrame, min_docs: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, df, sources, counts): the merged stripe of every term in ``min_docs`` documents of its language or more.

    The empty term has all sources of the language, with count 0.  Null text, language
    and source are empty ones.  A text of any length is folded whole; repeated rows are
    documents of their own; other columns are not looked at.  An empty table gives an
    empty result.
    """
    named = [F.coalesce(quoted(c).cast("string"), F.lit("")).alias(a) for a, c in (("lang", lang_col), ("source", source_col), ("text", text_col))]
    folded = docs.select(*named).mapInArrow(_fold(STRIPE_CELLS), STRIPE_DDL)
    return folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(min_docs), STRIPE_DDL)


def smoothed(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(ONE * (count + 2) / (total + 2 * terms)), exactly."""
    if max(counts.max(initial=0), total.max(initial=0)) > LONGEST_EXACT:
        counts, total = counts.astype(object), total.astype(object)
    return (1 + (counts + 2) * ONE // (total + 2 * terms)).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of longs up to about ONE."""
    return (p - q) ** 2 // (p + q)


def _dense(piece: pa.Table, place: dict[str, int]) -> np.ndarray:
    """(term, source) counts of a few stripes."""
    out = np.zeros((piece.num_rows, len(place)), np.int64)
    sources = piece.column("sources").combine_chunks()
    row = pc.list_parent_indices(sources).to_numpy()
    out[row, [place[s] for s in sources.flatten().to_pylist()]] = piece.column("counts").combine_chunks().flatten().to_numpy()
    return out


def _emit(best: int):
    """Divergences of one piece of a language's stripes, for one block of its sources."""

    def emit(key, stripes: pa.Table, totals: pa.Table) -> pa.Table:
        totals = totals.sort_by("source")
        names = totals.column("source").to_pylist()
        total, v, block = totals.column("total").to_numpy(), totals.column("terms")[0].as_py(), key[2].as_py()
        own = np.flatnonzero(totals.column("own_block").to_numpy() == block)
        place = {s: i for i, s in enumerate(names)}
        sums = np.zeros((len(own), len(names)), np.int64)
        top: list[list[tuple[int, str]]] = [[] for _ in own]
        step = max(1, (1 << 20) // max(1, len(names)))
        for at in range(0, stripes.num_rows, step):
            part = stripes.slice(at, step)
            counts = _dense(part, place)
            terms = part.column("term").to_pylist()
            p = smoothed(counts, total, v)
            q = smoothed(counts.sum(axis=1), total.sum(keepdims=True), v)
            for k, i in enumerate(own.tolist()):
                sums[k] += divergence(p[:, i : i + 1], p).sum(axis=0)
                over = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
                if len(over):
                    f = divergence(p[over, i], q[over])
                    if len(f) > best:  # all that tie with the last stay until terms are compared
                        near = f >= np.partition(f, len(f) - best)[len(f) - best]
                        over, f = over[near], f[near]
                    found = [*top[k], *((x, terms[t]) for x, t in zip(f.tolist(), over.tolist(), strict=True))]
                    top[k] = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:best]
        lang = key[0].as_py()
        rows = [(lang, names[i], "pair", names[j], int(sums[k, j])) for k, i in enumerate(own.tolist()) for j in range(len(names)) if i != j]
        rows += [(lang, names[i], "term", t, x) for k, i in enumerate(own.tolist()) for x, t in top[k]]
        kinds = [pa.string()] * 4 + [pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "part", "item", "value"])

    return emit


def audit_sources(
    docs: DataFrame,
    min_docs: int = 10,
    best: int = 10,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language lie apart.

    Part ``pair`` has every other source of the language with the summed divergence, part
    ``term`` the ``best`` terms that the source uses more than its language does.  Ranks
    start at 1 in each (lang, source, part), by value from the largest, then by item as
    UTF-8.  Sources without any term take part; a language with one source has no pair,
    one without kept terms has pairs of value 0.  Nulls, long texts, repeated rows, clashing
    columns and empty tables are as in ``source_stripes``.
    """
    stripes = stage(source_stripes(docs, min_docs, text_col, lang_col, source_col), "stripes")
    of_lang = stripes.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("terms"))
    cells = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    totals = cells.groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    of_lang = of_lang.join(totals.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")), "lang")
    of_lang = of_lang.withColumns({"pieces": F.ceil(F.greatest("terms", F.lit(1)) / PIECE_TERMS), "blocks": F.ceil(F.col("n_sources") / BLOCK)})
    of_lang = stage(of_lang, "langs")
    # blocks are told by a hash, so no task has to number the sources
    known = stage(totals.join(of_lang, "lang").withColumn("own_block", F.pmod(F.xxhash64("source"), F.col("blocks"))), "totals")
    every = known.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    every = every.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = every.select("lang", "piece", "block", "source", "total", "terms", "own_block")
    dealt = stripes.where("term <> ''").join(of_lang.select("lang", "pieces", "blocks"), "lang")
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("term"), F.col("pieces")))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "piece", "block", "term", "sources", "counts")
    key = ["lang", "piece", "block"]
    schema = "lang string, source string, part string, item string, value long"
    parts = dealt.groupBy(*key).cogroup(every.groupBy(*key)).applyInArrow(_emit(best), schema)
    # a pair's parts add up; a term is in one piece alone
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= best))
