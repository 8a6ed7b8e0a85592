"""Shards of equal bytes by histogram sort.

Documents are ordered by a key: a hash of the text, then a hash of the id.  The
splitters between shards are found without sorting.  Each round counts the exact
bytes below the probes, which are evenly spaced candidate boundaries inside the
bracket that is known to hold a splitter, and then keeps the one interval between
two probes that holds it.  A splitter is done when a probe lies within the
tolerance of its byte position.  Equal texts have one key and stay in one shard,
unless a group of them is so large that no boundary between texts meets the
tolerance; then the rounds go on over the ids of that group.  Every row is dealt
out once, when the splitters are known.

Only DataFrame expressions are used.  A round brings one row per splitter to the
driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.base import fresh, hash60, longs, quoted, stage, without

OUT = ("size", "shard", "slot")
KEY_BITS, STEP_BITS = 60, 12  # keys have 60 bits; a round looks at 12 more of them
SLOT_BITS = 10  # a shard's slots are numbered within 1024 pieces of it


@dataclass(frozen=True)
class Bracket:
    """Bytes ``at`` of splitter ``number`` lie inside this interval of keys."""

    number: int
    at: int
    text: int  # first text key of the interval
    id: int  # first id key, once the text key is known
    text_bits: int  # how many leading bits of the keys are known
    id_bits: int
    before: int  # bytes below the interval


def _known(value: int, bits: int) -> int:
    return value >> (KEY_BITS - bits)


def _round(keys: DataFrame, brackets: list[Bracket]) -> list:
    """Bytes below and in the interval between two probes that holds each splitter."""
    spark = keys.sparkSession
    first = brackets[0]
    by_id = first.text_bits == KEY_BITS
    column, bits = ("id_key", first.id_bits) if by_id else ("text_key", first.text_bits)
    known = F.shiftright(F.col(column), KEY_BITS - bits) if bits else F.lit(0).cast("long")
    probe = F.shiftright(F.col(column), KEY_BITS - bits - STEP_BITS)
    group = [F.col("text_key") if by_id else F.lit(0).cast("long"), known]
    places = {(b.text if by_id else 0, _known(b.id if by_id else b.text, bits), b.before) for b in brackets}
    wanted = longs(spark, sorted(places), "hot, known, below")
    counts = (
        keys.select(group[0].alias("hot"), known.alias("known"), probe.alias("probe"), "size", "text_key", "id_key")
        .join(F.broadcast(wanted), ["hot", "known"])  # at most one row per splitter
        .groupBy("hot", "known", "below", "probe")
        .agg(
            F.sum("size").alias("bytes"),
            *[f(c).alias(f"{n}_{c}") for c in ("text_key", "id_key") for n, f in (("min", F.min), ("max", F.max))],
        )
    )
    running = Window.partitionBy("hot", "known").orderBy("probe").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("bytes").over(running), F.lit(0)))
    ats = longs(spark, [(b.number, b.at, b.text if by_id else 0, _known(b.id if by_id else b.text, bits)) for b in brackets], "number, at, hot, known")
    holds = (F.col("below") <= F.col("at")) & (F.col("at") < F.col("below") + F.col("bytes"))
    return counts.join(F.broadcast(ats), ["hot", "known"]).where(holds).collect()  # a row per splitter


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The first (text_key, id_key) of each shard but shard 0.

    ``keys`` holds text_key, id_key and size of every row.  A boundary is taken in
    the first round that has one within ``tolerance`` of a shard's bytes; once single
    ids are reached, the nearest one is taken.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    near = tolerance * total / shards
    open_, found = [Bracket(i, total * i // shards, 0, 0, 0, 0, 0) for i in range(1, shards)], {}
    end = 1 << KEY_BITS
    while open_ and total:
        level = {(b.text_bits, b.id_bits) for b in open_}
        rows, by_number = [], {b.number: b for b in open_}
        for bits in level:
            rows += _round(keys, [b for b in open_ if (b.text_bits, b.id_bits) == bits])
        open_ = []
        for r in rows:
            b = by_number[r.number]
            by_id = b.text_bits == KEY_BITS
            bits = (b.id_bits if by_id else b.text_bits) + STEP_BITS
            low, high = r.probe << (KEY_BITS - bits), (r.probe + 1) << (KEY_BITS - bits)
            down, up = b.at - r.below, r.below + r.bytes - b.at
            one_text, one_id = r.min_text_key == r.max_text_key, r.min_id_key == r.max_id_key
            last = one_text and one_id or by_id and bits == KEY_BITS
            if min(down, up) <= near or last:
                edge = low if down <= up else high
                if by_id:
                    found[b.number] = (b.text, edge) if edge < end else (b.text + 1, 0)
                else:
                    found[b.number] = (edge, 0)
            elif by_id:
                open_.append(Bracket(b.number, b.at, b.text, low, KEY_BITS, bits, r.below))
            elif one_text:
                open_.append(Bracket(b.number, b.at, r.min_text_key, 0, KEY_BITS, 0, r.below))
            else:
                open_.append(Bracket(b.number, b.at, low, 0, bits, 0, r.below))
    return [found[i] for i in sorted(found)]


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    tolerance: float = 0.025,
    row_bytes: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows with ``size``, ``shard`` and ``slot``.

    ``size`` is the UTF-8 bytes of the text plus ``row_bytes``.  Shards hold nearly
    equal bytes; ``slot`` numbers the rows of a shard from 0 without a gap, in the
    order of the id hash, so copies of a text do not follow each other.

    A null text counts as an empty one and a null id as an empty one.  Rows equal in
    both text and id are not split from each other.  Input columns named like an
    added one are replaced.  An empty table gives an empty result; with fewer rows
    than shards some shards are empty.
    """
    docs = without(docs, *OUT)
    text_key, id_key, piece, skip = fresh(docs, "text_key", "id_key", "shard_piece", "slots_before")
    text = F.coalesce(quoted(text_col), F.lit(""))
    ident = F.coalesce(quoted(id_col).cast("string"), F.lit(""))
    keyed = (
        docs.withColumn("size", F.octet_length(text).cast("long") + row_bytes)
        .withColumn(text_key, hash60(text))
        .withColumn(id_key, hash60(ident))
    )
    keys = stage(keyed.select(F.col(text_key).alias("text_key"), F.col(id_key).alias("id_key"), "size"), "shard-keys")

    def shard_of(text_key: str, id_key: str):
        above = [
            ((F.col(text_key) > t) | ((F.col(text_key) == t) & (F.col(id_key) >= i)) if i else F.col(text_key) >= t).cast("int")
            for t, i in splitters
        ]
        return reduce(add, above, F.lit(0))

    splitters = find_splitters(keys, shards, tolerance)
    piece_of = lambda c: F.shiftright(F.col(c), KEY_BITS - SLOT_BITS)
    counts = keys.groupBy(shard_of("text_key", "id_key").alias("shard"), piece_of("id_key").alias("piece")).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "shard", F.col("piece").alias(piece), F.coalesce(F.sum("rows").over(earlier), F.lit(0).cast("long")).alias(skip)
    )
    order = Window.partitionBy("shard", piece).orderBy(id_key, text_key, "size")
    dealt = keyed.withColumn("shard", shard_of(text_key, id_key)).withColumn(piece, piece_of(id_key))
    slots = dealt.join(offsets, ["shard", piece]).withColumn("slot", F.col(skip) + F.row_number().over(order) - 1)
    return slots.select(*[quoted(c) for c in docs.columns], *OUT)
