import random

from panelwise.llm.chat import escape, format_conversations, parse_conversations, unescape

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<turn>", "[ROLE]", "[/NOROLE]", "\\", "<", "[", "]", " ", "\n", "é", "ok", "$1", ""]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_escaping_is_reversible(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", escape(df.text).alias("e")).select("text", "e", unescape("e").alias("u")).collect()
    marks = [p for p in PARTS if len(p) > 2]
    assert all(r.u == r.text for r in rows)
    assert not [r for r in rows if any(m in r.e for m in marks)]


def test_round_trip(spark):
    draw = random.Random(2)
    roles = ["user", "assistant", "system", "tool", None, "", "[/ROLE]<turn>"]
    rows = [
        (c, t, draw.choice(roles), "".join(draw.choices(PARTS, k=draw.randint(0, 8))))
        for c in range(300)
        for t in range(draw.randint(1, 9))
    ]
    shuffled = draw.sample(rows, len(rows))
    formatted = format_conversations(spark.createDataFrame(shuffled, SCHEMA))
    got = {r.conv_id: r for r in parse_conversations(formatted).collect()}
    for c in range(300):
        want = [(r, t) for conv, _, r, t in rows if conv == c]
        assert [tuple(t) for t in got[c].turns] == want
        assert got[c].loss_text == "".join(t for r, t in want if r == "assistant")


def test_adjacent_turns_of_a_role_are_one_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", None), (1, 4, "user", "d")]
    (row,) = format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert row.formatted == "[INST] a<turn>b [/INST]<s> c<turn> </s>[INST] d [/INST]"
    assert row.n_rows == 5


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "assistant", "x " * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS turns", "2 AS formatted", "3 AS first", "4 AS one")
    got = {r.conv_id: r for r in parse_conversations(format_conversations(df)).collect()}
    assert [tuple(t) for t in got[None].turns] == [(None, ""), (None, "")]
    assert [t.text[:2] for t in got[1].turns] == ["x ", "a", "b"]
    assert format_conversations(df.limit(0)).count() == 0
