import pytest
from pyspark.sql import functions as F

from loomdial.operators import clean, dialogue, merge, pairs
from loomdial.sources.readers import TURN

T, S = "教师", "学生"


def reasons(spark, turns, rule):
    df = spark.createDataFrame([(1, [(r, c, None) for r, c in turns])], f"session_no bigint, dialogue array<{TURN}>")
    return df.select(rule(F.col("dialogue"))).first()[0]


@pytest.mark.parametrize(
    ("turns", "want"),
    [
        ([(S, "a"), (T, "b")], "too_short_turns"),
        ([(S, "a"), (T, " 　"), (T, "c")], "empty_content"),
        ([(S, "a"), (T, "b"), (T, "c")], "role_repetition"),
        ([("user", "a"), (T, "b"), (S, "c")], "invalid_role_user"),
        ([(S, "a"), (T, "b"), (S, "c")], None),
    ],
)
def test_format(spark, turns, want):
    assert reasons(spark, turns, clean.format_reason) == want


@pytest.mark.parametrize(
    ("turns", "want"),
    [
        ([(T, "三个字")], "teacher_too_short"),
        ([(T, "四个字啊")], None),
        ([(T, "长" * 800)], None),
        ([(T, "长" * 801)], "teacher_lecture_mode_too_long"),
        ([(S, "长" * 801)], "student_too_verbose"),
        ([(T, "所以答案是五"), (S, "x")], "leaked_answer_pattern"),
        ([(T, "综上所述可知"), (S, "x")], "leaked_answer_pattern"),
        ([(S, "x"), (T, "综上所述可知")], None),
    ],
)
def test_content(spark, turns, want):
    assert reasons(spark, turns, clean.content_reason) == want


def test_safety_ignores_case_and_students(spark):
    assert reasons(spark, [(T, "AS AN AI LANGUAGE MODEL I")], clean.safety_reason) == "model_refusal_or_identity"
    assert reasons(spark, [(S, "我无法回答")], clean.safety_reason) is None


@pytest.mark.parametrize(("n", "keep"), [(0, 0), (99, 99), (100, 100), (1000, 350)])
def test_top_share(spark, n, keep):
    df = spark.range(n).select(F.col("id"), (F.pmod("id", F.lit(7)) / 7).alias("q"))
    got = [r["id"] for r in clean.top_share(df, "q", "id").collect()]
    want = sorted(range(n), key=lambda i: (-(i % 7) / 7, i))[:keep]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("target", [3, 10, 25, 1000])
def test_balanced_top_against_a_loop(spark, target):
    rows = [(i, f"t{(i * i) % 9}", (i * 37 % 101) / 101) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, q double")
    got = sorted(r["id"] for r in clean.balanced_top(df, "g", "q", "id", target).collect())
    groups = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    if target >= len(groups):
        quota = {g: target // len(groups) + (i < target % len(groups)) for i, g in enumerate(sorted(groups))}
    else:
        best = sorted(groups, key=lambda g: (-groups[g][0][2], g))[:target]
        quota = {g: int(g in best) for g in groups}
    chosen = [r for g, rs in groups.items() for r in rs[: quota[g]]]
    rest = sorted((r for g, rs in groups.items() for r in rs[quota[g] :]), key=lambda r: (-r[2], r[0]))
    want = chosen + rest[: max(0, target - len(chosen))]
    assert got == sorted(r[0] for r in want)


@pytest.mark.parametrize(("n", "ratio"), [(0, 0.1), (7, 0.1), (1000, 0.25), (10, 1.0)])
def test_split_is_exact_and_stable(spark, n, ratio):
    df = spark.range(n).withColumnRenamed("id", "k")
    first = {r["k"]: r["split"] for r in pairs.uniform_split(df, "k", ratio).collect()}
    again = {r["k"]: r["split"] for r in pairs.uniform_split(df.repartition(3), "k", ratio).collect()}
    assert first == again and len(first) == n
    assert sum(v == "eval" for v in first.values()) == int(ratio * n)


def test_repeat_sample(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    counts = [r["count"] for r in pairs.repeat_sample(df, "k", 17).groupBy("k").count().collect()]
    assert sorted(counts) == [2, 2, 2, 2, 3, 3, 3]


def test_dpo_ties_nulls_and_single_candidates(spark):
    rows = [(1, "a", 0.5), (2, "a", 0.5), (3, "a", None), (4, "b", 0.9)]
    df = spark.createDataFrame(rows, "row_no bigint, g string, score double")
    got = pairs.to_dpo(df, ["g"], "score", ["row_no"]).collect()
    assert [(r["chosen_row_no"], r["rejected_row_no"], r["margin"]) for r in got] == [(1, 2, 0.0)]


def test_flat_and_nested_agree(spark, data):
    s = clean.once(spark.read.parquet(f"{data}/sessions.parquet"))
    flat = dialogue.to_flat(s).select("session_no", "turn_id", "completion", "score")
    again = dialogue.flatten_nested(dialogue.to_nested(s)).select("session_no", "turn_id", "completion", "score")
    assert flat.count() > 0 and flat.exceptAll(again).count() == 0 and again.exceptAll(flat).count() == 0


def test_parts_against_a_loop(spark):
    sizes = [4, 4, 4, 20, 1, 9, 1]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(sizes)], "f string, i int, s bigint")
    got = {r["i"]: r["part"] for r in merge.request_parts(df, "f", "i", "s", 10).collect()}
    used, part, want = 0, 0, {}
    for i, s in enumerate(sizes):
        if used and used + s > 10:
            part, used = part + 1, 0
        used += s
        want[i] = part
    assert got == want


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = merge.dense_index(df, ["k"]).orderBy("k").collect()
    assert [r["ix"] for r in got] == list(range(1000))


def test_batch_responses_last_line_wins_and_names_with_hyphens(spark):
    from loomdial.functions.canon import encode_name

    code = spark.range(1).select(encode_name(F.lit("a?>b-c.jsonl"))).first()[0]
    line = '{"custom_id": "req-%s-4-2", "response": {"status_code": %d, "body": {"choices": [{"message": {"content": "%s"}}]}}}'
    rows = [(0, line % (code, 500, "x")), (1, line % (code, 200, "y")), (2, "no json")]
    got = merge.batch_responses(spark.createDataFrame(rows, "ord int, value string")).collect()
    assert [(r["name"], r["dialogue"], r["pair"], r["content"], r["ok"]) for r in got] == [("a?>b-c.jsonl", 4, 2, "y", True)]


def test_outer_merge_keeps_rows_of_both_sides(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(2, 0.5), (3, None)], "k int, m double")
    got = {r["k"]: r["metrics_source"] for r in merge.outer_merge(a, b, ["k"], F.col("m").isNotNull(), F.lit(False)).collect()}
    assert got == {1: "none", 2: "uploaded", 3: "partial"}
