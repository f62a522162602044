import pytest
from pyspark.sql import functions as F

from loomdial.llm.mixing import Mixture, capped_mean, poisson_steps
from loomdial.llm.sampling import label_key, session_sample

SESSIONS = "session_no bigint, student_type string, scenario string, topic_id string"
TARGETS = "target_id int, target_set string, student_type string, scenario string, topic_id string, target_permille int, min_rows int"


def test_label_key(spark):
    same = ["全优型", " 全优型", "全优型。", "全优型学生", "“全优型”", "全優型", "全 优型", "全优型的学生", "全优型　"]
    scenes = ["（5）学生回答正确并尝试延伸", "(5) 学生回答正确并尝试延伸", "⑤学生回答正确并尝试延伸", "场景5：学生回答正确并尝试延伸", "5、学生回答正确并尝试延伸", "（５）学生回答正确并尝试延伸", "回答正确并尝试延伸"]
    none = [None, "", " ", "未知", "未记录", "N/A"]
    for group, n in ((same, 1), (scenes, 1)):
        assert len({r[0] for r in spark.createDataFrame([(x,) for x in group], "v string").select(label_key(F.col("v"))).collect()}) == n
    assert {r[0] for r in spark.createDataFrame([(x,) for x in none], "v string").select(label_key(F.col("v"))).collect()} == {None}


def sessions(spark, n=500, hot=0.34):
    rows = [(i, "甲型" if i < n * hot else f"{'乙丙丁'[i % 3]}型", "x", f"topic_{i % 7}") for i in range(n)]
    return spark.createDataFrame(rows + rows[:50], SESSIONS)  # some are delivered again


def test_sample_meets_quotas_and_reports_shortfalls(spark):
    targets = spark.createDataFrame(
        [(1, "a", "甲", None, None, 900, 1), (2, "a", "乙型", None, None, 100, 5), (3, "a", "戊", None, None, 0, 2), (4, "b", None, "x", "topic_001", 1000, 1), (5, "c", None, None, None, 500, 1)], TARGETS
    )
    s = session_sample(sessions(spark), targets)
    report = {r["target_id"]: r for r in s.report().collect()}
    assert (report[1]["needed"], report[1]["available"], report[1]["short"]) == (90, 170, False)
    assert report[3]["available"] == 0 and report[3]["short"]
    assert report[5]["available"] == 500 and report[5]["taken"] == 50
    assert sorted(r["target_id"] for r in s.shortfalls().collect()) == [3, 4]
    rows = s.sample().collect()
    taken = {t: sum(r["target_id"] == t for r in rows) for t in report}
    assert taken == {t: r["taken"] for t, r in report.items()}
    assert len({(r["target_set"], r["session_no"]) for r in rows}) == len(rows)


def test_sample_is_uniform_and_stable(spark):
    targets = spark.createDataFrame([(1, "a", "甲", None, None, 500, 1)], TARGETS)
    a = {r["session_no"] for r in session_sample(sessions(spark), targets).sample().collect()}
    b = {r["session_no"] for r in session_sample(sessions(spark).repartition(5), targets).sample().collect()}
    assert a == b and len(a) == 50
    assert 50 < sum(a) / len(a) < 120  # of 0..169


def test_sample_of_nothing(spark):
    empty = spark.createDataFrame([], SESSIONS)
    targets = spark.createDataFrame([(1, "a", "甲", None, None, 500, 1)], TARGETS)
    assert [r["target_id"] for r in session_sample(empty, targets).shortfalls().collect()] == [1]
    assert session_sample(sessions(spark), targets.limit(0)).sample().count() == 0


@pytest.mark.parametrize(("mean", "cap"), [(0.3, 1), (0.9, 2), (1.7, 2), (2.5, 4), (0.0, 3)])
def test_poisson_inversion(mean, cap):
    steps = poisson_steps(mean, cap)
    got = sum(1 - s for s in steps)  # mean of the copies
    assert got == pytest.approx(mean, abs=1e-6) and steps == sorted(steps)
    assert poisson_steps(cap, cap) == [0.0] * cap
    assert capped_mean(50.0, cap) == pytest.approx(cap, abs=1e-6)


def test_mixture(spark):
    docs = spark.createDataFrame([(i, "big" if i < 3000 else "small" if i < 3300 else None, "w" * 10) for i in range(3400)], "doc_id bigint, source string, text string")
    weights = spark.createDataFrame([("big", 600, 2), ("small", 300, 2), ("absent", 100, 9)], "source string, weight_permille int, max_repeats int")
    m = Mixture(docs, weights, size=F.length("text").cast("bigint"))
    report = {r["source"]: r for r in m.report().collect()}
    assert {s for s, r in report.items() if r["short"]} == {"small", "absent"}
    assert report["small"]["mixed_tokens"] == 300 * 10 * 2 and report["small"]["most_copies"] == 2
    assert report["big"]["mixed_tokens"] == pytest.approx(0.6 * 33000, rel=0.1) and report["big"]["most_copies"] <= 2
    rows = m.mixture().collect()
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows) == sum(r["mixed_tokens"] for r in report.values()) / 10
    assert [r["mix_key"] for r in rows] == sorted(r["mix_key"] for r in rows)


def test_tokens_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", "你好 hello"), (4, "a", "字" * 400_001)], "doc_id bigint, source string, text string")
    weights = spark.createDataFrame([("a", 1000, 1)], "source string, weight_permille int, max_repeats int")
    got = {r["doc_id"]: r["n_tokens"] for r in Mixture(docs, weights).sized.collect()}
    assert got[1] == got[2] == 0 and got[3] > 0 and got[4] >= 100_000
    assert Mixture(docs.limit(0), weights).report().first()["mixed_tokens"] == 0


@pytest.mark.parametrize(("mean", "cap"), [(0.5, 4), (650.0, 2000), (900.0, 1000), (1500.0, 4000)])
def test_steps_reach_means_of_any_size(mean, cap):
    steps = poisson_steps(mean, cap)
    assert sum(1 - s for s in steps) == pytest.approx(mean, rel=1e-6)


def test_long_texts_have_the_tokens_of_the_whole():
    from loomdial.llm.mixing import PIECE, TOKENIZER, _encoding, pieces

    encode = _encoding(TOKENIZER).encode_ordinary
    base = "月亮绕着地球转，The moon's orbit takes 27.3 days...  为什么？don't guess!\n\n先想一想 "
    for t in (base * 9000, base[7:] + "甲乙丙丁" * 20000 + base * 5000, "", "短"):
        assert "".join(pieces(t)) == t and sum(len(encode(x)) for x in pieces(t)) == len(encode(t))
        assert len(t) < 2 * PIECE or len(list(pieces(t))) > 1
