import random

from pyspark.sql import functions as F

from panelwise.llm import decontam
from panelwise.llm.decontam import clean_documents, contained_items

ITEM = " ".join(f"w{i}" for i in range(14))  # ten shingles of five words


def found(docs, items):
    return sorted((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in contained_items(docs, items).collect())


def test_containment(spark):
    items = spark.createDataFrame([(1, ITEM), (2, ITEM.upper()), (3, "two words"), (4, ""), (5, None)], "item_id int, text string")
    filler = " ".join(f"f{i}" for i in range(5000))
    words = ITEM.split()
    docs = [
        (1, f"{filler} {ITEM} {filler}"),
        (2, f"{filler}\n{', '.join(words)}. {filler}"),  # punctuation does not count
        (3, " ".join(words[:12]) + " x"),  # eight of ten
        (4, " ".join(words[:11]) + " x"),  # seven of ten
        (5, " ".join(words[:8]) + f" {filler} " + " ".join(words[6:])),  # shingles in two places
        (6, "only these two words here"),
        (7, "Two  words"),
    ]
    got = found(spark.createDataFrame(docs, "doc_id int, text string"), items)
    want = [(d, i, n, 10) for d, n in ((1, 10), (2, 10), (3, 8), (5, 8)) for i in (1, 2)] + [(7, 3, 1, 1)]
    assert got == sorted(want)


def test_very_common_passage(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", f"if(id % 3 = 0, concat('text ', id, ' {ITEM} end'), concat('a text without it, number ', id)) AS text")
    items = spark.createDataFrame([(i, f"{ITEM} end") for i in range(5)], "item_id int, text string")
    got = contained_items(docs, items)
    assert got.count() == 1334 * 5 and got.where("doc_id % 3 <> 0").isEmpty()
    assert clean_documents(docs, items).count() == 4000 - 1334


def test_odd_documents(spark, odd, none):
    items = spark.createDataFrame([(1, "the same text of a few words, twice there"), (None, "one"), (2, None)], "item_id int, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in contained_items(odd, items).collect())
    assert got == [("4", "None"), ("5", "1"), ("6", "1")]
    kept = clean_documents(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert contained_items(none, items).count() == 0 and contained_items(odd, items.limit(0)).count() == 0
    assert clean_documents(odd, items.limit(0)).count() == odd.count()


def shingles(text: str | None) -> set[str]:
    words = "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (text or "").lower()).split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def mixed_tables(spark):
    """Items of all sizes, whole, with up to a third of their words changed, and inside other text."""
    draw = random.Random(3)
    items = [(i, " ".join(f"w{draw.randrange(60)}" for _ in range(draw.choice([1, 3, 5, 6, 9, 20, 60, 200])))) for i in range(60)]
    docs = []
    for i in range(300):
        words = draw.choice(items)[1].split()
        for _ in range(draw.choice([0, 0, 1, 2, len(words) // 20, len(words) // 3])):
            words[draw.randrange(len(words))] = "changed"
        around = [" ".join(f"w{draw.randrange(60)}" for _ in range(draw.choice([0, 2, 400]))) for _ in range(2)]
        docs.append((None if i % 17 == 0 else i, f"{around[0]} {' '.join(words)} {around[1]}"))
    return docs, items, spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")


def test_against_brute_force(spark):
    docs, items, d, i = mixed_tables(spark)
    want = sorted(
        (str(doc), item, len(a & b), len(b))
        for doc, text in set(docs)
        for item, other in items
        for a, b in [(shingles(text), shingles(other))]
        if b and len(a & b) >= 0.8 * len(b) - 1e-9
    )
    odd = i.selectExpr("*", "1 AS key", "2 AS shingle", "3 AS hash", "4 AS need", "5 AS item", "6 AS `class`")
    assert sorted((str(r.doc_id), r.item_id, r.shared, r.item_shingles) for r in contained_items(d, odd).collect()) == want
    assert len(want) > 50 and any(doc == "None" for doc, *_ in want)


def test_results_come_through_the_signatures(spark, monkeypatch):
    """With wrong signatures or without candidates, contained items are not found."""
    _, _, d, i = mixed_tables(spark)
    whole = contained_items(d, i).count()
    true = decontam.signatures

    def broken(index, threshold):
        signed, known = true(index, threshold)
        return signed.withColumn("shingle", F.concat("shingle", F.lit(" x"))), known

    monkeypatch.setattr(decontam, "signatures", broken)
    assert whole > 50 and contained_items(d, i).count() == 0

    def in_larger_classes(index, threshold):
        signed, known = true(index, threshold)
        return signed.withColumn("class", F.col("class") + 20), known

    monkeypatch.setattr(decontam, "signatures", in_larger_classes)
    assert contained_items(d, i).count() == 0
