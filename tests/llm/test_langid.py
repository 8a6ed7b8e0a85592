from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelwise.llm import langid
from panelwise.llm.langid import identify_language, ngram_counts, top, train_profiles
from panelwise.llm.queries import op2_language

SF = "/root/testdata/sf0.01"


def plain_counts(text: str) -> Counter:
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
        padded = f" {w} "
        out.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    return out


def number(gram: str) -> int:
    out = 0
    for c in gram:
        out = out << 21 | (1 if c == " " else ord(c))
    return out


def test_counts_against_brute_force(monkeypatch):
    texts = ["", "123 !", "a", "Der Hund, l'été: ßß", "\U00010400x y", "abc " * 500 + "ü"]
    for piece in (1 << 20, 16):
        monkeypatch.setattr(langid, "PIECE", piece)
        for t in texts:
            grams, counts = ngram_counts(t)
            want = Counter()
            for g, n in plain_counts(t).items():
                want[number(g)] += n
            assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == dict(want)


def test_top_is_by_count_then_number():
    assert top(np.array([5, 3, 9, 1]), np.array([2, 7, 2, 2]), 3).tolist() == [3, 1, 5]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op2_language(spark, SF).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.97 and 0 <= got[1] and got[2] <= 1


def test_odd_documents(odd, none, small):
    profiles = train_profiles(small)
    rows = identify_language(odd, profiles).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if not any(c.isalpha() for c in r.text or ""))
    assert all(r.lang_pred in profiles.languages and 0 <= r.score <= 1 for r in rows if any(c.isalpha() for c in r.text or ""))
    assert identify_language(none, profiles).count() == 0
    assert {r.lang_pred for r in identify_language(odd, train_profiles(none)).collect()} == {"und"}
    assert train_profiles(odd).languages == ["de", "en", "fr"]
