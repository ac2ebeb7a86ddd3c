"""Chat formatting against a plain state machine: every conversation comes back from its text."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from panelforge.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
HARD = [
    "", "plain", chat.HARD_TEXT, "[\\INST]", "[\\\\/INST] [INST", "<s></s>", "<<s>>", "s>", "/INST]", "\\", "<\\", "[", "<",
    "[ROLE]user[/ROLE][TURN]x[/TURN]", "</s><s>", "[/INST][INST]", "é\n[\\\\/TURN]\t", "$1\\$2", "[s> <INST] <\\s] [\\/s>", "𝄞</s>",
]


def source(rows):
    """conv_id -> turns (role, text) by the stated rules."""
    found = {}
    for conv, turn, role, text, *_ in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in found.items()}


def read(text):
    """Turns and (start, length) of assistant texts, by a plain scanner of the grammar."""
    ends = {m: (e, r) for r, (m, e) in chat.MARKS.items()}
    plain = lambda s: re.sub(r"([<\[])\\(\\*/?(?:s>|(?:SYS|INST|ROLE|TURN)\]))", r"\1\2", s)
    turns, spans, at = [], [], 0
    while at < len(text):
        mark = re.compile(chat.CONTROL).match(text, at).group()
        at += len(mark)
        role = None
        if mark == "[ROLE]":
            stop = text.index("[/ROLE][TURN]", at)
            role, at, end = plain(text[at:stop]), stop + len("[/ROLE][TURN]"), "[/TURN]"
        else:
            end, role = ends[mark]
        stop = text.index(end, at)
        assert not re.search(chat.CONTROL, text[at:stop])
        if mark == "<s>":
            spans.append((at, stop - at))
        turns.append((role, plain(text[at:stop])))
        at = stop + len(end)
    return turns, spans


@pytest.fixture(scope="module")
def rows():
    rows = [(i, 0, "user", t, "x") for i, t in enumerate(HARD)] + [(i, 1, "assistant", HARD[-i], None) for i in range(len(HARD))]
    rows += [(100, 2, "assistant", "c", None), (100, None, "system", "a", None), (100, 1, None, None, None), (100, 1, None, None, None)]
    rows += [(100, 1, "[/ROLE][TURN]", "</s>", None), (100, 3, "user\n", "b", None), (None, 1, "user", "n", None), (None, 0, "assistant", None, None)]
    rows += [(101, i, "assistant", "[INST]" * (i % 3), None) for i in range(300)] + [(102, 0, "assistant", "long </s> " * 20_000, None)]
    return rows + [(103, 0, "assistant", "same", None)] * 3


def test_turns_and_mask_come_back(spark, rows):
    made = {r["conv_id"]: r for r in chat.formatted_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = source(rows)
    assert made.keys() == want.keys()
    for conv, turns in want.items():
        got, spans = read(made[conv]["formatted"])
        assert got == turns
        assert [tuple(s) for s in made[conv]["loss_spans"]] == spans


def test_only_conflicts_are_escaped(spark, rows):
    made = {r["conv_id"]: r["formatted"] for r in chat.formatted_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert made[1].startswith("[INST]plain[/INST]<s>") and "[\\/INST]" in made[HARD.index(chat.HARD_TEXT)]
    assert made[103] == "<s>same</s>" * 3


def test_parser_refuses_other_texts(spark):
    bad = ["x", "[INST]", "[INST]a", "[INST]a[/SYS]", "a[INST]b[/INST]", "[INST]b[/INST]c", "[/INST]a[INST]", "[ROLE]a[/ROLE]", "[TURN]a[/TURN]", "[ROLE]a[/ROLE][INST]b[/INST]", "<s><s></s>"]
    frame = spark.createDataFrame([(b,) for b in bad], "t string").select("t", chat.parse(F.col("t")).alias("p"))
    assert [r["t"] for r in frame.collect() if r["p"] is not None] == []
    assert spark.createDataFrame([("",)], "t string").select(chat.parse(F.col("t")).alias("p")).first()["p"] == []


def test_query_digests(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    hard = [(-1, 0, "user", chat.HARD_TEXT), (-1, 1, "assistant", chat.HARD_TEXT)]
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv, turns in source(rows + hard).items():
        learned = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), hexed(learned))
    got = chat.op13_chat_format(spark, str(tmp_path)).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want


def test_empty_table(spark):
    assert chat.formatted_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    plan = chat.op13_chat_format(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
