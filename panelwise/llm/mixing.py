"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is one long stream: its documents in a keyed random order, repeated
from the start when it is used up.  Its target is cut into a whole number of blocks of
equally many words, the source's quota; the blocks of all sources stand in one random
order, and a tree of halvings deals them to the output shards: a node's blocks are the
slots of an interval of that order, and as many of them as the left half of its shards
is to get go left.  Given the counts of a node, those of its left half thus follow the
multivariate hypergeometric law, and quotas are split exactly at every node.  A document is
taken once for each epoch in which its middle lies in a block that the tree has dealt
to a shard.

Only DataFrame expressions are used.  Ranks and running sums over sources and over
blocks are taken in ranges of their order, so that there may be as many sources as
there are web hosts; there are ``shards * blocks_per_shard`` blocks and at most one more
for each source.  A hot source is spread over 4096 buckets of its random order; running
sums are taken within a bucket and shifted by the sums of the buckets before it.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.base import fresh, quoted, stage, without, word_count
from panelwise.operators.groups import running_sum

OUT = ("size", "source_size", "target", "draws")
BUCKET_HEX = 3  # 16 ** 3 buckets of each source's random order
PIECE_BITS = 6  # a shard is dealt out in 64 pieces


def source_targets(sources: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Add ``target`` to (source_key, source, words), a row per source.

    Weights go to the sources by code point, null last, and repeat.  The shares of
    all words stop at ``max_epochs`` times a source's words; what is above is shared
    out again by weight.  In the order in which sources fill up, the first one that
    its share does not fill gives the words per weight for it and all after it.
    """
    one = sources.withColumn("one", F.lit(1).cast("long"))
    ranked = running_sum(one, {"one": "rank"}, [F.asc_nulls_last("source"), F.asc("source_key")], stage)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    filling = ranked.select("source_key", "words", w.alias("weight"), (F.col("words") * max_epochs).cast("double").alias("most"))
    filling = filling.withColumn("full_at", F.col("most") / F.col("weight"))
    filled = stage(running_sum(filling, {"most": "most_upto", "weight": "weight_upto"}, [F.asc("full_at"), F.asc("source_key")], stage), "mix-filling")
    everything = filled.agg(F.struct(F.sum("words").alias("words"), F.sum("weight").alias("weight"))).scalar()
    left = everything["words"] - (F.col("most_upto") - F.col("most"))
    level = left / (everything["weight"] - (F.col("weight_upto") - F.col("weight")))
    levels = filled.withColumn("level", level).where("level <= full_at")
    per_weight = levels.agg(F.min_by("level", F.struct("full_at", "source_key"))).scalar()
    # without such a source all are full
    target = F.coalesce(F.least("most", F.col("weight") * per_weight), F.col("most"))
    return filled.select("source_key", "words", target.alias("target"))


def shard_of(slot: Column, slots: Column, shards: int) -> Column:
    """The shard whose leaf of the splitting tree holds a slot (from 0) of ``slots``.

    A node has the shards ``low`` to ``high`` (exclusive) and ``n`` slots from ``first`` on;
    its left half gets its share of them, as a whole number.
    """
    start = F.struct(F.lit(0).alias("low"), F.lit(shards).alias("high"), F.lit(0).cast("long").alias("first"), slots.cast("long").alias("n"))

    def descend(node: Column, _: Column) -> Column:
        middle = F.floor((node["low"] + node["high"]) / 2).cast("int")
        left = F.round(node["n"] * (middle - node["low"]) / (node["high"] - node["low"])).cast("long")
        leaf, goes_left = node["high"] - node["low"] < 2, slot - node["first"] < left
        return F.struct(
            F.when(leaf | goes_left, node["low"]).otherwise(middle).alias("low"),
            F.when(~leaf & goes_left, middle).otherwise(node["high"]).alias("high"),
            F.when(leaf | goes_left, node["first"]).otherwise(node["first"] + left).alias("first"),
            F.when(leaf, node["n"]).when(goes_left, left).otherwise(node["n"] - left).alias("n"),
        )

    depth = ceil(log2(shards)) if shards > 1 else 0
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)) if depth else F.array().cast("array<int>"), start, descend)["low"]


def split_quotas(sources: DataFrame, shards: int, blocks_per_shard: int, seed: str) -> DataFrame:
    """Add ``block_words`` and ``shards`` to (source_key, words, target).

    ``shards[i]`` is the shard that draws block i of the source's stream; there are as many
    blocks as the source's quota, and they cover its target.
    """
    total = sources.agg(F.sum("target")).scalar()
    step = F.greatest(F.lit(1.0), F.ceil(total / (shards * blocks_per_shard)).cast("double"))
    sized = sources.withColumn("quota", F.ceil(F.col("target") / step).cast("int")).where("quota > 0")
    blocks = sized.select("source_key", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("block"), F.lit(1).cast("long").alias("one"))
    order = F.md5(F.concat_ws("|", F.lit(seed), "source_key", "block"))
    placed = running_sum(blocks.withColumn("place", order), {"one": "upto"}, [F.asc(c) for c in ("place", "source_key", "block")], stage)
    slots = sized.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    dealt = placed.withColumn("shard", shard_of(F.col("upto") - 1, F.lit(slots), shards).cast("smallint"))
    in_order = F.sort_array(F.collect_list(F.struct("block", "shard")))  # a source's blocks, a bounded number
    drawn = dealt.groupBy("source_key").agg(in_order["shard"].alias("shards"))
    block_words = (F.col("target") / F.col("quota")).alias("block_words")
    return sources.join(sized.join(drawn, "source_key").select("source_key", block_words, "shards"), "source_key", "left")


def mix_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    max_epochs: int = 3,
    shards: int = 64,
    blocks_per_shard: int = 32,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """All documents, each with the draws that the mix makes of it.

    Adds ``size`` (words of the text), ``source_size``, ``target`` (words that the
    source is to give) and ``draws``: for each time the document is taken, its epoch,
    block, shard and place; the array is empty where it is not taken.  A document is
    taken in an epoch if its middle lies in one of the blocks that the tree has dealt
    out, so a source misses its target by half a document at most.

    Null and empty texts have size 0: they weigh nothing.  Null sources are one
    source, ordered last.  Rows that share an id are ordered by size; equal rows
    count separately.  Input columns named like an added one are replaced.  An empty
    table gives an empty result.
    """
    docs = without(docs, *OUT)
    key, bucket, skey, skip, at = fresh(docs, "mix_key", "mix_bucket", "source_key", "mix_before", "mix_at")
    source = quoted(source_col)
    keyed = (
        docs.withColumn("size", word_count(quoted(text_col)))
        .withColumn(skey, F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string"))))
        .withColumn(key, F.md5(F.concat_ws("|", F.lit(seed), quoted(id_col).cast("string"))))
        .withColumn(bucket, F.substring(key, 1, BUCKET_HEX))
    )
    sums = stage(
        keyed.groupBy(F.col(skey).alias("source_key"), F.col(bucket).alias("bucket")).agg(F.sum("size").alias("words")),
        "mix-sums",
    )
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source_key").alias(skey), F.col("bucket").alias(bucket), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias(skip)
    )
    sources = sums.groupBy("source_key").agg(F.sum("words").alias("words"))
    sources = sources.withColumn("source", F.when(F.col("source_key") != "0", F.expr("substring(source_key, 2)")))
    quotas = stage(split_quotas(source_targets(sources, weights, max_epochs), shards, blocks_per_shard, seed), "mix-quotas")
    plan = quotas.select(F.col("source_key").alias(skey), F.struct("words", "target", "block_words", "shards").alias(at))

    inside = Window.partitionBy(skey, bucket).orderBy(key, "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(offsets, [skey, bucket]).withColumn(skip, F.col(skip) + F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(plan, skey)
    words, target = F.col(at)["words"], F.col(at)["target"]

    def draw(epoch: Column) -> Column:
        middle = epoch * words + F.col(skip) + F.col("size") / 2.0
        block = F.floor(middle / F.col(at)["block_words"])
        return F.struct(
            epoch.cast("int").alias("epoch"),
            block.alias("block"),
            F.get(F.col(at)["shards"], block.cast("int")).cast("int").alias("shard"),
            F.xxhash64(F.lit(seed), F.col(key), epoch).alias("place"),
        )

    epochs = F.sequence(F.lit(0).cast("long"), F.lit(max_epochs - 1).cast("long"))
    dealt = F.when(F.col(at)["shards"].isNotNull(), F.filter(F.transform(epochs, draw), lambda d: d["shard"].isNotNull()))
    none = F.array().cast("array<struct<epoch:int,block:bigint,shard:int,place:bigint>>")
    return placed.select(
        *[quoted(c) for c in docs.columns], "size", words.alias("source_size"), target.alias("target"), F.coalesce(dealt, none).alias("draws")
    )


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row per draw, dealt out to its shard and shuffled within it.

    Adds ``epoch``, ``shard`` and ``place``; takes the result of ``mix_documents``.
    Places are random; a shard is dealt out in 64 ranges of them, so that the rows
    of one shard need not fit into one task, and each range is sorted.
    """
    kept = [c for c in without(mixed, "epoch", "shard", "place").columns if c not in OUT]
    (one,) = fresh(mixed, "draw")
    rows = mixed.select(*[quoted(c) for c in kept], F.explode("draws").alias(one))
    rows = rows.select(*[quoted(c) for c in kept], *[F.col(one)[c].alias(c) for c in ("epoch", "shard", "place")])
    piece = F.shiftright("place", 64 - PIECE_BITS)
    return rows.repartition("shard", piece).sortWithinPartitions("shard", "place")
