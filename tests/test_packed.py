import re

import pytest
from pyspark.sql import functions as F

from loomdial.operators.packed import infer_delimiters, split_packed, strategy_values

# enough plain lists for the delimiters to be inferred from
CORPUS = ["追问，提示", "追问、提示", "追问；提示", "追问/提示", "追问|提示", "追问+提示", "追问&提示", "追问\t提示", "追问\n提示", "追问　提示", "追问 提示", "追问和提示", "追问与提示", "追问以及提示", "1.追问 2.提示", "①追问②提示"] * 3

CASES = {
    "追问，提示, 类比": ["追问", "提示", "类比"],
    "追问,,提示,": ["追问", "提示"],
    '"追问（看图,读表）","提示"': ["追问（看图,读表）", "提示"],
    '"引导推理（""再想想""，看着黑板）"，类比': ['引导推理（"再想想"，看着黑板）', "类比"],
    "“提示（看图；读表）”、追问": ["提示（看图；读表）", "追问"],
    '["追问", "提示"]': ["追问", "提示"],
    "['追问','提示']": ["追问", "提示"],
    "1.追问 2.无效复读 3.提示": ["追问", "无效复读", "提示"],
    "(1)追问；(2)提示": ["追问", "提示"],
    "①追问②提示": ["追问", "提示"],
    "暗示1、追问、引导推理": ["暗示1", "追问", "引导推理"],
    "追问 提示": ["追问", "提示"],
    "追 问/情境设问": ["追 问", "情境设问"],
    "追 问 情境设问": ["追 问", "情境设问"],
    "追问（Follow-up questioning）、提示": ["追问（Follow-up questioning）", "提示"],
    "follow-up  questioning，提示": ["follow-up  questioning", "提示"],
    "追问:follow-up questioning;提示": ["追问:follow-up questioning", "提示"],
    "暗示~；提示": ["暗示~", "提示"],
    "追问、提示以及类比": ["追问", "提示", "类比"],
}
SINGLE = ["追 问", "follow-up questioning", "追问(follow-up questioning)", '"追问（看图；读表）"', "analogy-类比", "追问:follow-up questioning", "暗示~"]


def test_split_against_written_cases(spark):
    rows = [(i, v) for i, v in enumerate([*CASES, *SINGLE, *CORPUS, None, "", "  ", "，,"])]
    out = split_packed(spark.createDataFrame(rows, "id int, v string"), "v").collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["id"], r["pos"])):
        got.setdefault(r["id"], []).append(r["item_value"])
        assert r["n_values"] >= 1
    for i, (v, want) in enumerate(CASES.items()):
        assert got[i] == want, v
    for i, v in enumerate(SINGLE, len(CASES)):
        assert got[i] == [v.strip('"')], v
    assert max(got) < len(rows) - 4  # null, blank and separators alone give no row


def test_delimiters_are_inferred_per_source(spark):
    a = [("a", x) for x in ["apple tart/plum pie", "plum pie/fig jam/apple tart", "fig jam/plum pie"] * 3]
    b = [("b", x) for x in ["红茶-绿茶", "绿茶-白茶", "白茶-红茶"] * 3]
    df = spark.createDataFrame(a + b, "src string, v string")
    found = {r["source"]: set(r["accepted"]) for r in infer_delimiters(df, "v", "src").collect()}
    assert found == {"a": {"slash"}, "b": {"hyphen"}}
    out = split_packed(df, "v", "src").groupBy("src").agg(F.countDistinct("item_value").alias("n")).collect()
    assert {r["src"]: r["n"] for r in out} == {"a": 3, "b": 3}


def test_columns_that_clash_and_empty_table(spark):
    df = spark.createDataFrame([("x", "追问，提示")] * 3, "pos string, v string")
    assert [r["pos"] for r in split_packed(df, "v").limit(2).collect()] == [0, 1]
    assert split_packed(df.limit(0), "v").count() == 0


def test_long_value(spark):
    v = "，".join(["追问"] * 5000)
    out = split_packed(spark.createDataFrame([(v,)] * 3, "v string"), "v")
    assert out.count() == 15000


def test_whole_table_agrees_with_a_plain_scan(spark, data):
    """Values without quotes, brackets and spaces: a plain split at the marks is the truth."""
    v = strategy_values(spark.read.parquet(f"{data}/sessions.parquet"))
    got = {}
    for r in split_packed(v, "teaching_strategy").collect():
        got.setdefault((r["session_no"], r["ann_no"]), []).append((r["pos"], r["item_value"]))
    checked = 0
    for r in v.collect():
        s = r["teaching_strategy"]
        if re.search(r"[\s\"“'\[(（①1-9.　​]", s):
            continue
        want = [x for x in re.split("，|,|、|;|；|/|／|\\||｜|\\+|＋|&|和|与|以及", s) if x]
        assert [x for _, x in sorted(got.get((r["session_no"], r["ann_no"]), []))] == want, s
        checked += 1
    assert checked > 100


@pytest.mark.parametrize("value", ["追问", "，", "​"])
def test_values_alone(spark, value):
    out = split_packed(spark.createDataFrame([(value,)], "v string"), "v").collect()
    assert [r["item_value"] for r in out] == ([value] if value == "追问" else [])


def test_numbering_without_any_other_delimiter(spark):
    rows = [("a", "①追问②拆解问题"), ("a", "①提示②引导推理"), ("b", "(1)追问(2)提示"), ("b", "（1）拆解（2）举例")]
    df = spark.createDataFrame(rows, "src string, v string")
    assert {r["source"]: list(r["accepted"]) for r in infer_delimiters(df, "v", "src").collect()} == {"a": ["numbering"], "b": ["numbering"]}
    out = split_packed(df, "v", "src").where("src = 'a'").collect()
    assert {r["item_value"] for r in out} == {"追问", "拆解问题", "提示", "引导推理"}


def test_values_of_a_hundred_thousand_characters(spark):
    """Runs, quoted parts, blanks and Latin letters of any length: no stack that grows with the value, no time that grows with its square."""
    n = 100_000
    values = ["追" * n + "，" + "问" * n, '"' + "追，" * n + '"，提示', '"' + '追""' * n + '"；提示', "提示" + " " * n + "，追问", "a" * n + "追，提示", "（" * n + "，追问", "[" + "追" * n + "，提示]"]
    rows = [(i, v) for i, v in enumerate([*values, *CORPUS])]
    out = split_packed(spark.createDataFrame(rows, "id int, v string"), "v").where(f"id < {len(values)}").collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["id"], r["pos"])):
        got.setdefault(r["id"], []).append(r["item_value"])
    assert got == {
        0: ["追" * n, "问" * n], 1: ["追，" * n, "提示"], 2: ['追"' * n, "提示"], 3: ["提示", "追问"], 4: ["a" * n + "追", "提示"], 5: ["（" * n, "追问"], 6: ["追" * n, "提示"]
    }


def test_a_source_with_few_values_is_judged_by_all(spark):
    rows = [("many", v) for v in CORPUS] + [("few", "追问｜提示"), (None, "追问，提示"), ("own", "红茶-绿茶")] + [("own", "红茶-白茶")] * 40 + [("none", "追问")]
    out = split_packed(spark.createDataFrame(rows, "src string, v string"), "v", "src").collect()
    got = {}
    for r in out:
        got.setdefault(r["src"], set()).add(r["item_value"])
    assert got["few"] == got[None] == {"追问", "提示"} and got["own"] == {"红茶", "绿茶", "白茶"} and got["none"] == {"追问"}
