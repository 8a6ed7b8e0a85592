"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of
one role are merged into one block by joining the slice of their texts; the blocks
are concatenated.  The template:

    user       [INST] text [/INST]
    assistant  <s> text </s>
    system     <<SYS>> text <</SYS>>
    others     [ROLE] role<turn>text [/ROLE]
    no role    [NOROLE] text [/NOROLE]

Texts that were merged into one block are kept apart by ``<turn>``.  A control
string inside a text gets one backslash after its first character, and one more if
it has some already, so texts hold no control string and lose nothing: taking one
backslash away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.base import quoted

BLOCKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER, NONE, TURN = ("[ROLE]", "[/ROLE]"), ("[NOROLE]", "[/NOROLE]"), "<turn>"
# A control string, cut after its first character, with any backslashes there.
CONTROL = r"(/?(?:INST|ROLE|NOROLE)\]|/?s>|</?SYS>>|turn>)"
OPEN, CLOSE = r"(\[INST\]|\[ROLE\]|\[NOROLE\]|<s>|<<SYS>>)", r"(\[/INST\]|\[/ROLE\]|\[/NOROLE\]|</s>|<</SYS>>)"
BLOCK = f"(?s){OPEN} (.*?) {CLOSE}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def _mark(role: Column, side: int) -> Column:
    """What stands before (0) or after (1) the texts of a block."""
    pad = (lambda m: f"{m} ") if side == 0 else (lambda m: f" {m}")
    out = F.when(role.isNull(), F.lit(pad(NONE[side])))
    for name, marks in BLOCKS.items():
        out = out.when(role == name, F.lit(pad(marks[side])))
    other = F.lit(pad(OTHER[side]))
    return out.otherwise(F.concat(other, escape(role), F.lit(TURN)) if side == 0 else other)


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its id, ``n_rows`` and ``formatted``.

    Rows are ordered by turn, then role, then text (nulls first), so repeated turns
    have a fixed order; equal rows count as often as they are there.  A null text is
    an empty text, a null role has its own block, rows with a null conversation id
    are one conversation.  Other input columns are left out.  An empty table gives
    no rows.  A conversation is one text and so has to fit into one row.
    """
    rows = turns.select(
        quoted(conv).alias(conv),
        F.struct(
            quoted(turn).alias("turn"), quoted(role).cast("string").alias("role"), F.coalesce(quoted(text), F.lit("")).alias("text")
        ).alias("one"),
    )
    sorted_ = rows.groupBy(quoted(conv)).agg(F.sort_array(F.collect_list("one")).alias("turns"))
    at = lambda i: F.get("turns", i)
    first = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | ~at(i)["role"].eqNullSafe(at(i - 1)["role"]),
    )
    runs = sorted_.withColumn("first", first)
    block = F.transform(
        "first",
        lambda i, n: F.concat(
            _mark(at(i)["role"], 0),
            F.array_join(
                F.transform(
                    F.slice("turns", i + 1, F.coalesce(F.get("first", n + 1), F.size("turns")) - i), lambda t: escape(t["text"])
                ),
                TURN,
            ),
            _mark(at(i)["role"], 1),
        ),
    )
    return runs.select(quoted(conv), F.size("turns").cast("long").alias("n_rows"), F.array_join(block, "").alias("formatted"))


def parse_conversations(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Read back: the id, ``formatted``, ``turns`` (role and text, in order) and ``loss_text``.

    ``loss_text`` is all text that a model is trained on: the texts of the assistant.
    """
    def turns_of(block: Column) -> Column:
        opened = F.regexp_extract(block, "^" + OPEN, 1)
        texts = F.split(F.regexp_extract(block, BLOCK, 2), TURN)
        role = F.when(opened == OTHER[0], unescape(F.get(texts, F.lit(0))))
        for name, marks in BLOCKS.items():
            role = role.when(opened == marks[0], F.lit(name))
        texts = F.when(opened == OTHER[0], F.slice(texts, 2, F.size(texts))).otherwise(texts)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.regexp_extract_all("formatted", F.lit(BLOCK), 0)
    read = formatted.select(quoted(conv), "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"))
    spoken = F.filter("turns", lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))
    return read.select(quoted(conv), "formatted", "turns", F.array_join(F.transform(spoken, lambda t: t["text"]), "").alias("loss_text"))
