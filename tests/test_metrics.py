"""Hand-worked metric values; F2 tells the families apart."""

import pytest

from loomdial.operators import metrics
from loomdial.sources.readers import ANNOTATION, TURN

T, S = "教师", "学生"
F1 = [(S, "", "", "", "错误回答", "", "理解"), (T, "引导推理", "追问", "", "", "L3", "")]
F2 = [
    (S, "", "", "否", "错误回答", "", "记忆（Remember）"),
    (T, "引出概念", "追问，提示", "是", "", "L2", ""),
    (S, "", "", "是", "清晰理解", "", "分析"),
    (T, "引发迁移", "无效复读", "是", "", "L3（推理）", ""),
    (S, "", "", "否", "模糊理解", "", "理解"),
    (T, "引导推理, 总结提升", "", "yes", "", "L3", ""),
    (S, "", "", "否", "高阶思考", "", "创造"),
]


def annotations(rows):
    return [(who, f"u{i}", intent, strategy, "", transfer, state, level, bloom) for i, (who, intent, strategy, transfer, state, level, bloom) in enumerate(rows)]


def frame(spark, rows, dialogue=None):
    return spark.createDataFrame([(1, rows, dialogue)], f"session_no bigint, annotations array<{ANNOTATION}>, dialogue array<{TURN}>")


@pytest.mark.parametrize(
    ("family", "rows", "want"),
    [
        *[(f, F1, (1, 0.125, 0, 0, 0.25, 1, 0, 0.30)) for f in "abc"],
        ("a", F2, (2 / 3, 0.375, 1, 1.0, 0.75, 2 / 3, 1, 0.8167)),
        ("b", F2, (2 / 3, 0.25, 1, 0.8, 0.5, 1 / 3, 1, 0.703333)),
        ("c", F2, (2 / 3, 0.375, 1, 0.8, 0.5, 1 / 3, 1, 0.715833)),
    ],
)
def test_hand_fixtures(spark, family, rows, want):
    row = getattr(metrics, f"session_metrics_{family}")(frame(spark, annotations(rows)), ["session_no"]).first()
    for name, x in zip([*metrics.METRICS, "total_score"], want):
        assert row[name] == pytest.approx(x, abs=1e-5), name


def test_sessions_without_annotations(spark):
    for empty in ([], None):
        df = frame(spark, empty)
        assert metrics.session_metrics_a(df, ["session_no"]).first()["total_score"] == 0.0
        assert metrics.session_metrics_b(df, ["session_no"]).count() == 0
        assert metrics.session_metrics_c(df, ["session_no"]).count() == 0


def test_only_students_and_no_errors(spark):
    row = metrics.session_metrics_a(frame(spark, annotations([(S, "", "", "", "清晰理解", "", "")])), ["session_no"]).first()
    assert (row["strategy_density"], row["ikt"], row["l3_guidance_rate"], row["cognitive_correction_rate"]) == (0, 0, 0, 1)


def test_turn_score_d(spark):
    rows = metrics.turn_scores_d(frame(spark, annotations(F2)), ["session_no"]).collect()
    assert {r["ann_no"]: r["total_score"] for r in rows}[5] == pytest.approx(0.6)
    echo = next(r for r in rows if r["ann_no"] == 3)
    assert echo["invalid_echo"] == 1 and echo["has_strategy"] == 0 and echo["l3"] == 0


def test_turn_score_e_takes_the_last_annotation_of_a_text(spark):
    a = annotations([(T, "", "", "", "", "", ""), (T, "引出概念", "追问", "是", "", "L3", "")])
    a = [(x[0], "同一句话！", *x[2:]) for x in a]
    df = frame(spark, a, [(T, "同一句 话", None), (S, "同一句话", None), (T, "另一句", None)])
    got = {r["turn_no"]: r["turn_score"] for r in metrics.turn_scores_e(df, ["session_no"]).collect()}
    assert got[0] == pytest.approx(0.35 + 0.15 + 0.10 / 8 + 0.15 + 0.15 / 4 + 0.10, abs=1e-4)
    assert got[1] is None and got[2] is None


def test_weights_sum_to_one():
    assert sum(metrics.WEIGHTS.values()) == pytest.approx(1)
    assert sum(metrics.TURN_WEIGHTS.values()) == pytest.approx(1)
