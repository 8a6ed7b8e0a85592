"""Language identification by rank-order profiles.

A profile lists the n-grams of one to three letters of a language, or of a document,
from the most frequent one down.  A document's distance to a language is the sum, over
the document's n-grams, of how far each is out of its place in the language's list; one
that is not in the list counts as far out as the list is long.  The nearest language
is predicted.

Runs of letters are words; a word is counted with one space before and after it.
N-grams are numbers (21 bits a letter), so a document is counted by sorting an array.
Profiles are counted by Spark over all training documents that the bound leaves in;
they are a few kilobytes for each language, and prediction is one pass without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.base import fresh, hash60, quoted, without

OUT = ("lang_pred", "score")
LONGEST, PLACES = 3, 400  # letters of an n-gram, places of a profile
UNDETERMINED = "und"
LETTER_BITS, SPACE = 21, 1  # a space's number is no letter's
PIECE = 1 << 20  # code points that are counted at once
LANGUAGES_MOST = 4096  # what is sent to the tasks is at most this many profiles

_LETTERS: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Letters as Unicode has them; the table is made at first use, in each worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0][codes]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers, and how often each stands in it.

    Long texts are counted a piece at a time; pieces end between words.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter(codes) if len(codes) else np.zeros(0, bool)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one space after each word
    line = np.concatenate([[SPACE], np.where(letter, codes, SPACE)[kept]]).astype(np.int64)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if line[-1] != SPACE:
        line = np.append(line, SPACE)
    grams, counts = [], []
    spaces = np.flatnonzero(line == SPACE)
    start = 0
    while start < len(line) - 1:
        end = len(line) - 1
        if end - start > PIECE:
            end = int(spaces[max(np.searchsorted(spaces, start + PIECE, "right") - 1, 0)])
            end = end if end > start else int(spaces[np.searchsorted(spaces, start, "right")])
        part = line[start : end + 1]
        found = [part[part != SPACE]]
        for n in range(2, LONGEST + 1):
            gram = part[: len(part) - n + 1]
            for k in range(1, n):
                gram = (gram << LETTER_BITS) | part[k : len(part) - n + 1 + k]
            inside = np.ones(len(gram), bool)  # spaces stand at the ends of an n-gram only
            for k in range(1, n - 1):
                inside &= part[k : len(part) - n + 1 + k] != SPACE
            found.append(gram[inside])
        unique, count = np.unique(np.concatenate(found), return_counts=True)
        grams.append(unique)
        counts.append(count)
        start = end
    if len(grams) == 1:
        return grams[0], counts[0]
    unique, where = np.unique(np.concatenate(grams), return_inverse=True)
    return unique, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def top(grams: np.ndarray, counts: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The most frequent n-grams in order; ties by number."""
    if len(grams) > places:
        bar = np.partition(counts, len(counts) - places)[len(counts) - places]
        keep = counts >= bar
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:places]


@dataclass(frozen=True)
class Profiles:
    """Places of the n-grams in every language: rows follow ``grams``, columns ``languages``."""

    languages: list[str]
    grams: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(lists: dict[str, list[int]]) -> Profiles:
        languages = sorted(lists)
        grams = np.unique(np.array([g for found in lists.values() for g in found], np.int64))
        place = np.full((len(grams) + 1, len(languages)), PLACES, np.int64)  # the last row: in no list
        for j, language in enumerate(languages):
            place[np.searchsorted(grams, np.array(lists[language], np.int64)), j] = np.arange(len(lists[language]))
        return Profiles(languages, grams, place)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (the first by name of equals), and 1 - its distance as a share of the largest."""
        grams, counts = ngram_counts(text or "")
        if not len(grams) or not self.languages:
            return UNDETERMINED, 0.0
        own = top(grams, counts)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        place = self.place[np.where(self.grams[at] == own, at, len(self.grams))]
        here = np.arange(len(own))[:, None]
        distance = np.where(place == PLACES, PLACES, np.abs(place - here)).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (PLACES * len(own)))


def train_profiles(
    docs: DataFrame, per_language: int = 4000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id"
) -> Profiles:
    """Profiles of the languages that rows of ``docs`` name.

    Of each language about ``per_language`` documents are used, chosen by a hash of
    the id; null texts and languages are not.  The n-grams are counted by Spark.
    """
    rows = docs.select(quoted(id_col).cast("string").alias("id"), quoted(text_col).alias("text"), quoted(lang_col).cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES_MOST + 1).collect()}
    if len(sizes) > LANGUAGES_MOST:
        raise ValueError(f"more than {LANGUAGES_MOST} languages: their profiles are too large to send to every task")
    spark = docs.sparkSession
    shares = spark.createDataFrame([(k, per_language / n) for k, n in sizes.items()], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang")  # a row per language, checked above
    drawn = drawn.where(hash60(F.concat(F.lit("profile"), F.coalesce("id", F.lit("")))) < F.col("share") * float(1 << 60))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[tuple]] = {}
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(language, []).append(ngram_counts(text))
            for language, found in texts.items():
                unique, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                sums = np.bincount(where, np.concatenate([c for _, c in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(unique)), pa.array(unique), pa.array(sums)], ["lang", "gram", "n"])

    counts = drawn.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    lists: dict[str, list[int]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= PLACES).orderBy("lang", "place").collect():
        lists.setdefault(r.lang, []).append(r.gram)
    return Profiles.of(lists)


def identify_language(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """All rows with ``lang_pred`` and ``score`` (0 to 1, higher: nearer to the profile).

    ``und`` with score 0 stands for null texts and texts without a letter.  Only the
    text is looked at.  Input columns named like an added one are replaced.  An empty
    table gives an empty result.
    """
    docs = without(docs, *OUT)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [profiles.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang_pred", "score"]
            )

    (own,) = fresh(docs, "predicted")
    return docs.withColumn(own, predict(quoted(text_col))).select(*map(quoted, docs.columns), F.col(own)["lang_pred"].alias("lang_pred"), F.col(own)["score"].alias("score"))
