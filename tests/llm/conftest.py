"""Odd documents that every operator has to bear."""

from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} lang" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["size", "SHARD", "slot", "target", "draws", "score", "predicted", "fingerprint", "print", "hash", "pii", "lang_pred", "key", "id", "text_hash"]
ROWS = [
    (None, None, None, None, None),
    (1, None, "en", None, 0),
    (2, "", None, "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one", "en", "a", 3),
    (5, "the same text of a few words, twice there", "en", "b", 41),
    (5, "the same text of a few words, twice there", "en", "b", 41),
    (6, "the same text of a few words, twice there", "fr", "c", 41),
    (7, LONG, "en", "c", len(LONG)),
    (None, "a text without an id, and with some words", "de", "c", 41),
    (8, "!!! 123 ??? \U0001f600 éàü ßßß <s>[INST]</s> \\", "de", "\U0001f600", 44),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns with clashing names."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.selectExpr("*", *[f"concat('own ', doc_id) AS `{c}`" for c in CLASHES])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
