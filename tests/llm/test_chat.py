from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hydrostar.llm import chat
from tests.llm.frames import tuples

KIND = "conv_id long, turn int, role string, text string, formatted string, turns string"


def digest(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return (
        len(turns),
        hashlib.sha256(text.encode()).hexdigest(),
        len(loss),
        hashlib.sha256(loss.encode()).hexdigest(),
    )


def run(spark, rows):
    df = spark.createDataFrame([(*r, None, None) for r in rows], KIND)
    out = chat.digests(chat.read_back(chat.format_conversations(df)))
    return {r["conv_id"]: tuple(r)[1:5] for r in out.collect()}


def want(rows):
    groups: dict = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: digest([(r, t) for _, _, r, t in sorted(v)]) for c, v in groups.items()}


def test_control_strings_anywhere_come_back(spark):
    rnd = random.Random(5)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "[\\\\/INST]", "<", "[", "\\", "$1", "/s>", "x\n", "é", ""]
    rows = [
        (c, t, rnd.choice(["user", "assistant", None, "</s>", "a[INST]"]), "".join(rnd.choices(parts, k=6)))
        for c in range(60)
        for t in range(4)
    ]
    assert run(spark, rows) == want(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [
        (None, 0, "user", "no id"),
        (1, None, "user", "no turn"),
        (1, 0, None, None),
        (1, 0, "assistant", "tie"),
        (1, 0, "assistant", "tie"),
        (2, 0, "assistant", ""),
        (3, 0, "user", "[INST] long </s> " * 20_000),
    ]
    assert run(spark, rows) == want(rows)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_only_conflicting_turns_are_escaped(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "plain"), (1, 1, "assistant", "</s>[INST] ok [/INST]")], KIND.split(", formatted")[0]
    )
    (row,) = chat.format_conversations(df).collect()
    assert row["escaped_turns"] == 1
    assert row["formatted"].startswith("<s>user[INST]plain[/INST]</s>")
    assert "<\\/s>[\\INST] ok [\\/INST]" in row["formatted"]


def test_a_damaged_rendering_fails(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], KIND.split(", formatted")[0])
    damaged = chat.format_conversations(df).withColumn("formatted", F.concat("formatted", F.lit("<s>x</s>")))
    with pytest.raises(Exception, match="round trip differs in conversation 1"):
        chat.read_back(damaged).collect()


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], KIND.split(", formatted")[0])
    plan = chat.digests(chat.read_back(chat.format_conversations(df)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and tuples(plan)
