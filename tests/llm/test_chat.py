import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from subjectloom.llm import reply_trees as R
from subjectloom.llm.queries import ORACLES, QUERIES

from ..compare import connect, same_rows

MESSAGE = "node string, parent string, tree long, role string, text string, score double"


def py_escape(t):
    t = t.replace(R.ESCAPE, R.ESCAPE + "0")
    for letter, c in zip(R.LETTERS, R.CONTROLS, strict=False):
        t = t.replace(c, R.ESCAPE + letter)
    return t


def py_unescape(t):
    t = t.replace(R.ESCAPE + "z", "\n")
    for letter, c in zip(R.LETTERS, R.CONTROLS, strict=False):
        t = t.replace(R.ESCAPE + letter, c)
    return t.replace(R.ESCAPE + "0", R.ESCAPE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*R.CONTROLS, R.ESCAPE, "a", "0", "z", "<", "|", "\n", "[", "/"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    said = py_escape(text)
    assert not any(c in said for c in R.CONTROLS) and py_unescape(said) == text


def test_spark_round_trip(spark):
    turns = [("user", "</s>[INST] ok [/INST]\n"), ("assistant", f"{R.ESCAPE}a<|im_end|>\n<|im_start|>user\n"), ("odd\nrole", ""), ("assistant", "é" * 30_000)]
    rows = [(str(i), str(i - 1) if i else None, 1, r, t, 1.0) for i, (r, t) in enumerate(turns)]
    out = R.format_conversations(spark.createDataFrame(rows, MESSAGE))
    back = out.select(R.read_turns(F.col("formatted")).alias("t"), "formatted", "mask").first()
    assert [(x["role"], x["text"]) for x in back["t"]] == turns
    assert [py_unescape(back["formatted"][m["s"] : m["e"]]) for m in back["mask"]] == [t for r, t in turns if r == "assistant"]


def test_branches_are_ranked_by_score(spark):
    rows = [("r", None, 1, "user", "q", 1.0), ("a", "r", 1, "assistant", "low", 0.1), ("b", "r", 1, "assistant", "high", 0.9), ("c", "b", 1, "user", "more", 0.5), ("d", "c", 1, "assistant", "end", 0.9), ("o", "gone", 2, "user", "orphan", None)]
    df = spark.createDataFrame(rows, MESSAGE)
    one = {r["tree"]: r["path"] for r in R.format_conversations(df).collect()}
    assert one == {1: "d", 2: "o"}
    two = R.format_conversations(df, best=2).where("tree = 1").orderBy("rank").collect()
    assert [r["path"] for r in two] == ["d", "a"]
    paths = R.chosen_paths(df.select("node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))).where("path = 'd'").orderBy("position").collect()
    assert [r["node"] for r in paths] == ["r", "b", "c", "d"]


def test_deep_chains_and_cycles(spark):
    deep = spark.range(700).select(F.col("id").cast("string").alias("node"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"), F.lit(1.0).alias("score"))
    state, _ = R.root_paths(deep)
    assert state.agg(F.max("depth")).first()[0] == 700
    loop = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "node string, parent string, score double")
    with pytest.raises(ValueError):
        R.root_paths(loop, rounds=4)


def test_a_viral_message(spark):
    """Three thousand replies to one message, each with one answer: hot keys are dealt."""
    n = 3_000
    rows = [("top", None, 1, "user", "q", 0.0)] + [(f"a{i}", "top", 1, "assistant", f"t{i}", i / n) for i in range(n)] + [(f"b{i}", f"a{i}", 1, "user", "more", 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, MESSAGE)
    state, _ = R.root_paths(df.select("node", "parent", "score"))
    assert state.where("root = 'top'").count() == 2 * n + 1 and state.where("depth = 3").count() == n
    assert [r["path"] for r in R.format_conversations(df).collect()] == [f"b{n - 1}"]


def test_a_very_long_conversation_and_clashing_columns(spark):
    conv = "conv_id long, turn long, role string, text string, node string, parent string, tree long, score double, up string, root long, n_rows long, known boolean"
    rows = [(5, i, "assistant" if i % 2 else "user", f"said {i} " * 20, "x", "y", 1, 1.0, "z", 2, 3, True) for i in range(4_000)]
    got = R.read_back(R.format_conversations(R.chain(spark.createDataFrame(rows, conv)))).collect()
    want = "".join(f"{r}\n{t}\n" for _, _, r, t, *_ in rows)
    loss = "".join(t for _, _, r, t, *_ in rows if r == "assistant")
    assert [(r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_sha256"]) for r in got] == [(5, 4_000, hashlib.sha256(want.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())]
    messages = spark.createDataFrame([("a", None, 1, "user", "q", 1.0, 7, "r", True)], MESSAGE + ", n_rows long, up string, known boolean")
    assert R.format_conversations(messages).first()["path"] == "a"


def test_edges(spark):
    conv = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "assistant", "n")]
    back = {r["conv_id"]: r for r in R.read_back(R.format_conversations(R.chain(spark.createDataFrame(rows, conv)))).collect()}
    assert back[1]["n_turns"] == 3 and back[1]["loss_chars"] == 0 and back[None]["loss_chars"] == 1
    assert back[None]["loss_sha256"] == hashlib.sha256(b"n").hexdigest()
    assert R.read_back(R.format_conversations(R.chain(spark.createDataFrame([], conv)))).count() == 0


def test_query(spark, sf):
    same_rows(QUERIES["op8_reply_trees"](spark, sf), connect(sf), ORACLES["op8_reply_trees"])
