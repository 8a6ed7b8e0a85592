import datetime
import random

import pytest
from pyspark.sql import functions as F

from panelwise.llm.pii import feistel, pseudonymise


def luhn(digits: str) -> bool:
    twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def pii(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r for r in pseudonymise(df, "key").orderBy("doc_id").collect()]


@pytest.mark.parametrize(("a", "b"), [(10, 10), (27, 41), (1, 7), (100, 1)])
def test_feistel_permutes(spark, a, b):
    x = spark.range(a * b)
    got = [r[0] for r in x.select(feistel(F.col("id"), a, b, "k", "f")).collect()]
    assert sorted(got) == list(range(a * b))
    other = [r[0] for r in x.select(feistel(F.col("id"), a, b, "another key", "f")).collect()]
    assert a * b < 50 or (got != other and got != list(range(a * b)))


def test_values_stay_valid_and_linked(spark):
    draw = random.Random(6)
    cards = []
    while len(cards) < 200:
        body = "".join(draw.choices("0123456789", k=draw.choice([13, 15, 16])))
        cards += [body] if luhn(body) else []
    dates = [datetime.date(1900, 1, 1) + datetime.timedelta(draw.randrange(73_000)) for _ in range(200)]
    ips = [".".join(str(draw.randrange(256)) for _ in range(4)) for _ in range(200)]
    rows = pii(spark, [f"{c} and {d.isoformat()} or {d:%d.%m.%Y}, {i}." for c, d, i in zip(cards, dates, ips, strict=True)])
    seen: dict[str, dict[str, str]] = {}
    for r in rows:
        card, iso, dotted, ip = (x.text for x in r.pii)
        assert luhn(card) and len(card) == len(r.pii[0].value) and card[0] == r.pii[0].value[0]
        assert datetime.date.fromisoformat(iso) == datetime.datetime.strptime(dotted, "%d.%m.%Y").date()
        assert all(0 <= int(p) < 256 for p in ip.split("."))
        for x in r.pii:
            assert seen.setdefault(x.kind, {}).setdefault(x.value, x.text) == x.text
    for pairs in seen.values():
        assert len(set(pairs.values())) >= len(set(pairs)) - 200 * (next(iter(pairs)).count("-") > 0 or "." in next(iter(pairs)))
    assert sum(x.text != x.value for r in rows for x in r.pii) > 790


def test_forms(spark):
    (row,) = pii(
        spark,
        ["+1 (262) 555-3752 4524132264652876 x 4041 8949 7460 8795; a.b@c.example.com; 123-45-6789, 2/3/2001 and 415-555-2671, +44 20 7946 0958."],
    )
    assert [x.kind for x in row.pii] == ["phone", "card", "card", "email", "ssn", "date", "phone", "phone"]
    for x in row.pii:
        assert x.value not in row.pseudonymised
        if x.kind not in ("email", "date"):
            assert ["9" if c.isdigit() else c for c in x.value] == ["9" if c.isdigit() else c for c in x.text]
    assert row.pseudonymised.startswith("+1 (") and " x 4" in row.pseudonymised


def test_invalid_values_stay(spark):
    texts = ["4041894974608796", "31.02.2001", "300.1.1.1", "000-12-1234", "1.2.3", "12 34", "a@b", "no"]
    assert [r.pseudonymised for r in pii(spark, texts)] == texts


def test_odd_documents(odd, none):
    rows = pseudonymise(odd, "k").collect()
    assert len(rows) == odd.count()
    assert all(r.pseudonymised == r.text and r.pii == [] for r in rows)
    assert pseudonymise(none, "k").count() == 0
