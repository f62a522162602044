from pyspark.sql import functions as F

from loomdial.operators import views
from loomdial.operators.dialogue import MESSAGES


def test_paired_responses(spark):
    df = spark.createDataFrame([([("user", " a "), ("user", "b"), ("user", " ")], {0: "x", 1: "  ", 2: "z"})], f"m {MESSAGES}, r map<int,string>")
    got = df.select(views.paired_responses(F.col("m"), F.col("r")).alias("d")).first()["d"]
    assert [(t["role"], t["content"]) for t in got] == [("学生", "a"), ("教师", "x")]


def test_uploaded_metrics_and_summary(spark):
    rows = [('[{"dialogue_id": "d", "metrics_results": {"IKT": {"score": 0.5, "display": "50%"}, "BP": 0.25}}]',), ('{"no": "array"}',)]
    got = {(r["row_index"], r["metric"]): r["score"] for r in views.uploaded_metrics(spark.createDataFrame(rows, "value string")).collect()}
    assert got == {(0, "IKT"): 0.5, (0, "BP"): 0.25}
    s = views.uploaded_summary(spark.createDataFrame([('{"total_dialogues_processed": 3, "average_scores": {"IKT": "50%"}}',)], "value string")).first()
    assert s["total"] == 3 and s["average_scores"] == {"IKT": "50%"}


def test_rewrites(spark):
    line = '{"custom_id": "%s", "response": {"status_code": %d, "body": {"choices": [{"message": {"content": "%s"}}]}}}'
    rows = [(0, line % ("rw-7", 200, "old")), (1, line % ("rw-7", 200, " new ")), (2, line % ("rw-8", 500, "x")), (3, line % ("other", 200, "x")), (4, line % ("rw-9", 200, " "))]
    got = views.rewrites(spark.createDataFrame(rows, "ord int, value string")).collect()
    assert [(r["pair_no"], r["rewrite"]) for r in got] == [(7, "new")]


def test_small_views(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.9)], "k string, s double")
    assert [r["k"] for r in views.best_first(df, "s", "k").collect()] == ["c", "a", "b"]
    assert [r[0] for r in df.select(views.with_end(F.col("k"), "</s>")).collect()] == ["a</s>", "b</s>", "c</s>"]
    assert spark.range(1).select(views.with_end(F.lit("x</s>"), "</s>")).first()[0] == "x</s>"
    assert [p["label"] for p in df.select(views.nonblank_pairs(["k", "s"]).alias("p")).collect()[1]["p"]] == ["k"]
    assert [r["k"] for r in views.by_locale(spark.createDataFrame([("b",), ("A",), ("a",)], "k string"), "k").collect()] == ["a", "A", "b"]
