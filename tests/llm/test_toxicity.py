import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from panelwise.llm import toxicity
from panelwise.llm.queries import op9_toxicity
from panelwise.llm.toxicity import Windows, fit, score_toxicity, training_texts, windows_of

SMALL = "/root/testdata/sf0.001"

MARKED = ["grobnax", "vilthor", "skarmuck", "pladwort"]


def corpus(n: int, toxic_share: float = 0.2) -> list[tuple[int, str, int]]:
    draw = random.Random(11)
    syllables = ["an", "the", "er", "ion", "st", "wh", "ou", "re", "ly", "ing", "or"]
    out = []
    for i in range(n):
        words = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(draw.randint(20, 200))]
        toxic = draw.random() < toxic_share
        for _ in range(len(words) // 30 + 1 if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(MARKED) + draw.choice(["", "", "s", "."]))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    scored = score_toxicity(docs, labels).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    counts = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    right = counts.get((0, 0), 0) + counts.get((1, 1), 0)
    assert right / sum(counts.values()) > 0.97 and counts.get((1, 1), 0) > 20


def plain_score(model, text: str | None) -> float:
    """Every word of the text compressed with both dictionaries, one by one."""
    params = zstandard.ZstdCompressionParameters.from_level(
        model.level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    frame = b"@@##~~%%" * 2
    raw = zstandard.DICT_TYPE_RAWCONTENT
    ordinary, both = (
        zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d + frame, dict_type=raw), compression_params=params)
        for d in (model.ordinary, model.ordinary + model.toxic)
    )
    words = (text or "").lower().encode().split()
    windows = [frame + b" " + w[i : i + 192] + b" " + frame for w in words for i in range(0, len(w), 192)]
    hits = sum(len(ordinary.compress(w)) - len(both.compress(w)) >= model.saved for w in windows)
    return max(hits / len(windows) / (hits / len(windows) + model.share), 0.01) if hits else 0.01


def test_query_against_plain_scores(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(*training_texts(docs, labels))
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in op9_toxicity(spark, SMALL).collect()}
    assert set(got) == {r.doc_id for r in docs.select("doc_id").collect()}
    for r in docs.collect():
        score = plain_score(model, r.text)
        assert got[r.doc_id] == (pytest.approx(score, abs=1e-12), int(score >= 0.5), zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_every_window_is_compressed(monkeypatch):
    """A text's windows all go through both dictionaries, also where they share no byte with the toxic one."""
    rows = corpus(300)
    model = fit([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    scan, asked = Windows(model), []
    distance = scan.distance
    monkeypatch.setattr(scan, "distance", lambda w: asked.append(w) or distance(w))
    for _, t, _ in rows:
        scan.count(t.lower().encode(), [1])
    assert sorted(asked) == sorted({w.encode() for _, t, _ in rows for w in t.lower().split()})


def test_long_texts_are_cut_between_windows(monkeypatch):
    text = (b"one two " * 3000 + b"x" * 1000 + b" y")
    whole = [w for part in windows_of(text) for w in part]
    monkeypatch.setattr(toxicity, "SLICE", 100)
    assert [w for part in windows_of(text) for w in part] == whole and len(whole) == 6007


def test_odd_documents(tables, odd, none, spark):
    docs, labels = tables
    both = docs.unionByName(odd.selectExpr("doc_id + 10000 AS doc_id", "text"))
    rows = score_toxicity(both, labels).where("doc_id IS NULL OR doc_id >= 10000").collect()
    assert len(rows) == odd.count() and all(0 <= r.score < 0.5 and r.predicted == 0 for r in rows)
    assert score_toxicity(none, labels).count() == 0
    no_labels = score_toxicity(odd, labels.limit(0)).collect()
    assert len(no_labels) == odd.count() and {r.predicted for r in no_labels} == {0}
    null_labels = spark.createDataFrame([(None, 1), (5, None), (5, 1), (5, 0), (4, 0)], "doc_id long, toxic int")
    assert score_toxicity(odd, null_labels).count() == odd.count()
