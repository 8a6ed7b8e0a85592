"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, and one on toxic text.
Every window of every text is compressed with both; what the toxic dictionary saves over
the ordinary one is its distance.  A window is a word between two spaces (a longer run
without a space is several), inside a fixed frame that both dictionaries end with
(zstandard looks for no match in the last bytes).  A window counts as toxic if it
saves ``saved`` bytes or more, and a document by the share of such windows among all of
its windows.  The thresholds and the compression level are calibrated on labelled
documents that the dictionaries have not seen.  Equal windows of a task are
compressed once; none is left out.

Most of a toxic document is ordinary prose, which the ordinary dictionary holds too.
So the toxic one is the ordinary one, so that prose costs the same with both, and
behind it a dictionary trained on the rest: the parts of toxic windows that the
ordinary sample could not have supplied, runs of five bytes that it has at most once.

The model is fitted on the driver on a sample of labelled rows whose bounds (rows of
each label, characters of a text) are parameters; it is a few kilobytes.  Scoring is one
pass over the documents without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.base import hash60, quoted, without

OUT = ("score", "predicted")
FRAME = b"@@##~~%%@@##~~%%"
GRAM = 5  # bytes that an ordinary text must have in a row to supply them
LONGEST = 192  # bytes of a window
LEVELS, SAVED = (1, 2, 3), range(1, 9)
SHARES = (0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03)
ORDINARY_BYTES, TOXIC_BYTES = 8192, 2048
SEGMENTS = (16, 24)  # bytes that a dictionary takes over at once
PROSE_WINDOWS, PROSE_SAMPLES = 24, 40_000  # windows in a sample of prose, and samples
REPEATS = 5  # toxic windows that share five bytes before these are worth a place
SLICE = 1 << 22  # bytes of a text that are cut into windows at once
CACHED_WINDOWS = 200_000
NO_HIT = 0.01  # score without any toxic window


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    level: int = 2
    saved: int = 1
    share: float = 1.0


def windows_of(low: bytes) -> Iterator[list[bytes]]:
    """The windows of a lowered UTF-8 text, a slice at a time."""
    start = 0
    while start < len(low):
        end = low.find(b" ", start + SLICE)
        end = len(low) if end < 0 else end
        words = low[start:end].split()
        if any(len(w) > LONGEST for w in words):
            words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
        yield words
        start = end


class Windows:
    """Bytes that the toxic dictionary saves over the ordinary one, window by window."""

    def __init__(self, model: Model) -> None:
        params = zstandard.ZstdCompressionParameters.from_level(
            model.level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        self.packers = []
        for part in (model.ordinary, model.ordinary + model.toxic):
            held = zstandard.ZstdCompressionDict(part + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.packers.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params))
        self.known: dict[bytes, int] = {}

    def distance(self, word: bytes) -> int:
        framed = b"%b %b %b" % (FRAME, word, FRAME)
        ordinary, toxic = (len(p.compress(framed)) for p in self.packers)
        return ordinary - toxic

    def saved(self, words: list[bytes]) -> list[int]:
        if len(self.known) > CACHED_WINDOWS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.distance(w)
        return [known[w] for w in words]

    def count(self, low: bytes, least: list[int]) -> tuple[int, list[int]]:
        """Windows of a text, and those that save at least so many bytes."""
        n, hits = 0, [0] * len(least)
        for words in windows_of(low):
            n += len(words)
            saved = [s for s in self.saved(words) if s > 0]
            hits = [h + sum(s >= x for s in saved) for h, x in zip(hits, least, strict=True)]
        return n, hits


def _trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """A dictionary of the samples (at least eight bytes each); too few of them are a dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, [s * (1 + 7 // len(s)) for s in samples if s], **how).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def _grams(window: bytes) -> list[bytes]:
    return [window[i : i + GRAM] for i in range(len(window) - GRAM + 1)]


def _prose(texts: list[bytes]) -> list[bytes]:
    """Samples of running text of a few windows, evenly from all texts if there are too many."""
    samples = []
    for low in texts:
        for words in windows_of(low):
            samples += [b" %b " % b" ".join(words[i : i + PROSE_WINDOWS]) for i in range(0, len(words), PROSE_WINDOWS)]
    return samples[:: 1 + len(samples) // PROSE_SAMPLES]


def _supplied(texts: list[bytes]) -> Counter:
    """In how many texts a run of five bytes of one window stands, counted once for each window."""
    windows: Counter = Counter()
    for low in texts:
        windows.update({w for words in windows_of(low) for w in words})
    found: Counter = Counter()
    for w, n in windows.items():
        for g in set(_grams(b" %b " % w)):
            found[g] += n
    return found


def _left_over(toxic: list[bytes], supplied: Counter) -> list[bytes]:
    """Parts of toxic windows, from the first to the last five bytes that ordinary text does not supply.

    A window after the same window as before is a copy and does not count again; parts
    that share no five bytes with a few others are chance.
    """
    parts, seen = [], set()
    for low in toxic:
        last = b""
        for words in windows_of(low):
            for w in words:
                pair = hash((last, w))
                last = w
                if pair in seen:
                    continue
                seen.add(pair)
                framed = b" %b " % w
                new = [i for i, g in enumerate(_grams(framed)) if supplied[g] < 2]
                if new:
                    parts.append(framed[new[0] : new[-1] + GRAM])
    often = Counter(g for p in parts for g in set(_grams(p)))
    return [p for p in parts if max(often[g] for g in _grams(p)) >= REPEATS]


def lowered(texts: list[str]) -> list[bytes]:
    return [t.lower().encode() for t in texts]


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from two thirds of the texts; segments, level and thresholds from the last third.

    Without any toxic text nothing is toxic.
    """
    build, rest = ([lowered(t[i::3]) for t in (toxic, ordinary)] for i in (0, 2))
    for held, part in zip(build, (toxic, ordinary), strict=True):
        held += lowered(part[1::3])
    plain = _trained(_prose(build[1]), ORDINARY_BYTES, k=48, d=6)
    left = _left_over(build[0], _supplied(build[1]))
    if not left:
        return Model(b"", plain)
    if not rest[0] or not rest[1]:
        rest = build
    label = np.repeat([True, False], [len(rest[0]), len(rest[1])])
    weight = np.where(label, 1 / max(1, len(rest[0])), 1 / max(1, len(rest[1])) * 4)  # a clean document lost costs more
    best, model = (math.inf, 0.0, 0), Model(b"", plain)  # of thresholds that err alike, the strictest
    for segment in SEGMENTS:
        marks = _trained(left, TOXIC_BYTES, k=segment, d=6)
        for level in LEVELS:
            scan = Windows(Model(marks, plain, level))
            counted = [scan.count(low, list(SAVED)) for low in rest[0] + rest[1]]
            n, hits = np.array([c for c, _ in counted]), np.array([h for _, h in counted])
            for k, s in enumerate(SAVED):
                for cut in SHARES:
                    wrong = ((hits[:, k] >= cut * n) & (hits[:, k] > 0)) != label
                    found = (round(float((wrong * weight).sum()), 9), -cut, -s)
                    if found < best:
                        best, model = found, Model(marks, plain, level, s, cut)
    return model


def training_texts(
    docs: DataFrame,
    labels: DataFrame,
    toxic: int = 2000,
    ordinary: int = 4000,
    held_out_of: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = 20_000,
) -> tuple[list[str], list[str]]:
    """At most about ``toxic`` and ``ordinary`` texts of each label, chosen by a hash of the id.

    The sample has one text of an id, and none of more than ``longest`` characters.  Rows
    whose crc32(id as text) modulo ``held_out_of`` is 0 are never used.
    """
    key = F.col(id_col).cast("string")
    known = labels.where("toxic IS NOT NULL").groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(key.cast("binary")) % held_out_of != 0)
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, toxic / max(1, n.get(1, 0))).otherwise(ordinary / max(1, n.get(0, 0)))
    drawn = known.where(hash60(F.concat(F.lit("sample"), key)) < share * float(1 << 60))
    texts = docs.select(quoted(id_col).alias(id_col), quoted(text_col).alias("text")).where(F.length("text") <= longest)
    # Two expected numbers of rows, both parameters, bound what is broadcast.
    found = texts.join(F.broadcast(drawn), id_col).groupBy(id_col).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = found.select("toxic", "text").orderBy("toxic", hash60(F.col("text")), "text").collect()
    return [r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic != 1]


def toxicity_score(model: Model, text: Column) -> Column:
    """Score from 0 to 1: 0.5 where the share of toxic windows is at its threshold."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = Windows(model)
        for texts in batches:
            out = []
            for low in pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary()):
                n, (hits,) = windows.count(low.as_py(), [model.saved])
                share = hits / max(n, 1)
                out.append(max(share / (share + model.share), NO_HIT) if hits and model.toxic else NO_HIT)
            yield pa.array(out, pa.float64())

    return score(text)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    toxic: int = 2000,
    ordinary: int = 4000,
    held_out_of: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows with ``score`` and ``predicted`` (1 where the score is 0.5 or more).

    The model is fitted on the texts of ``docs`` that ``labels`` marks (the larger of
    several labels counts), without the held-out ones.  Null and empty texts have no
    toxic window and a low score.  Repeated rows score alike.  Input columns named
    like an added one are replaced.  An empty table gives an empty result; without
    toxic labels every score is low.
    """
    docs = without(docs, *OUT)
    model = fit(*training_texts(docs, labels, toxic, ordinary, held_out_of, id_col, text_col))
    scored = docs.withColumn("score", toxicity_score(model, quoted(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
