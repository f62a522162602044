"""Families of dialogue-quality metrics; they disagree on purpose and are never merged.

Sessions carry their annotations as an array in order, so every session metric is an expression over that array: no explode and no exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdial.functions.canon import (
    BLOOM_EXACT,
    bloom_level,
    canonical_intent,
    canonical_strategy,
    comma_items,
    is_student,
    is_teacher,
    is_truthy,
    py_strip,
    utterance_key,
)

WEIGHTS = {
    "strategy_density": 0.15,
    "strategy_variety": 0.10,
    "ikt": 0.15,
    "bloom_progression": 0.15,
    "structure_completeness": 0.15,
    "l3_guidance_rate": 0.10,
    "cognitive_correction_rate": 0.20,
}
METRICS = tuple(WEIGHTS)
TURN_WEIGHTS = {"has_strategy": 0.25, "new_strategy": 0.15, "transfer": 0.2, "new_intent": 0.2, "l3": 0.2}
REQUIRED_INTENTS = ("引出概念", "引导推理", "引发迁移", "总结提升")
STRATEGY_CLASSES, BLOOM_STEPS = 8, 5


def _ratio(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(otherwise))


def _distinct_size(arr: Column) -> Column:
    return F.size(F.array_distinct(F.array_compact(arr)))


def canonical_strategies(c: Column) -> Column:
    """Distinct strategy classes of a comma list."""
    return F.array_distinct(F.array_compact(F.transform(comma_items(c), canonical_strategy)))


def _corrections(states: Column, error, clear) -> Column:
    """Error states directly followed by a clear one."""
    at = F.sequence(F.lit(0), F.size(states) - 2)
    pairs = F.filter(at, lambda i: F.coalesce(error(F.get(states, i)) & clear(F.get(states, i + 1)), F.lit(False)))
    return F.when(F.size(states) >= 2, F.size(pairs)).otherwise(0)


def _with_total(df: DataFrame, scores: dict[str, Column], keep: list[str], round_to: int | None) -> DataFrame:
    df = df.select(*keep, *[c.cast("double").alias(k) for k, c in scores.items()])
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(k) for k, w in WEIGHTS.items()])
    return df.withColumn("total_score", total if round_to is None else F.round(total, round_to))


def _parts(df: DataFrame, teacher, student) -> DataFrame:
    return df.withColumns({"_t": F.filter("annotations", teacher), "_s": F.filter("annotations", student)})


def session_metrics_a(sessions: DataFrame, keep: list[str]) -> DataFrame:
    """Fuzzy matching. A session without annotations keeps a row with total 0.0 and null parts."""
    df = _parts(sessions, lambda x: is_teacher(x["speaker"]), lambda x: is_student(x["speaker"]))
    df = df.withColumns(
        {
            "_classes": F.transform("_t", lambda x: canonical_strategies(x["teaching_strategy"])),
            "_levels": F.filter(F.transform("_s", lambda x: bloom_level(x["cognitive_level"])), lambda x: x > 0),
            "_states": F.transform("_s", lambda x: F.coalesce(x["student_cognition_state"], F.lit("None"))),
            "_buckets": F.flatten(
                F.transform(
                    "_t",
                    lambda x: F.array_compact(
                        F.array(
                            F.when(canonical_intent(x["teacher_intent"]).isin("introduce", "guide_reasoning", "summarize_enhance"), canonical_intent(x["teacher_intent"])),
                            F.when(x["teacher_intent"].contains("迁移") | F.lower(x["teacher_intent"]).contains("transfer"), "transfer"),
                        )
                    ),
                )
            ),
        }
    )
    error = lambda s: s.rlike("错误|Incorrect|Error|Vague|模糊")
    clear = lambda s: s.rlike("清晰|Clear|高阶|Higher-order")
    n = F.size("_t")
    errors = F.size(F.filter("_states", error))
    scores = {
        "strategy_density": _ratio(F.size(F.filter("_classes", lambda x: F.size(x) > 0)), n),
        "strategy_variety": F.least(_distinct_size(F.flatten("_classes")) / STRATEGY_CLASSES, F.lit(1.0)),
        "ikt": F.least(_ratio(F.size(F.filter("_t", lambda x: is_truthy(x["discipline_transfer"]))), n), F.lit(1.0)),
        "bloom_progression": F.when(F.size("_levels") > 0, F.least((F.array_max("_levels") - F.array_min("_levels")) / BLOOM_STEPS, F.lit(1.0))).otherwise(0.0),
        "structure_completeness": _distinct_size(F.col("_buckets")) / 4,
        "l3_guidance_rate": _ratio(F.size(F.filter("_t", lambda x: x["teacher_guidance_level"].contains("L3"))), n),
        "cognitive_correction_rate": F.least(F.when(errors > 0, _corrections(F.col("_states"), error, clear) / errors).otherwise(1.0), F.lit(1.0)),
    }
    some = F.coalesce(F.size("annotations") > 0, F.lit(False))
    out = _with_total(df, {k: F.when(some, c) for k, c in scores.items()}, keep, 4)
    return out.withColumn("total_score", F.coalesce("total_score", F.lit(0.0)))


def _exact(sessions: DataFrame, keep: list[str], split_lists: bool) -> DataFrame:
    df = sessions.where(F.size("annotations") > 0)
    df = _parts(df, lambda x: F.coalesce(x["speaker"] == "教师", F.lit(False)), lambda x: F.coalesce(x["speaker"] == "学生", F.lit(False)))
    level = F.create_map(*[F.lit(v) for kv in BLOOM_EXACT.items() for v in kv])
    intent = (lambda x: py_strip(x["teacher_intent"])) if split_lists else (lambda x: x["teacher_intent"])
    df = df.withColumns(
        {
            "_levels": F.array_compact(F.transform("_s", lambda x: F.try_element_at(level, F.coalesce(x["cognitive_level"], F.lit(""))))),
            "_states": F.transform("_s", lambda x: x["student_cognition_state"]),
            "_used": F.flatten(F.transform("_t", lambda x: comma_items(x["teaching_strategy"]))) if split_lists else F.filter(F.transform("_t", lambda x: x["teaching_strategy"]), lambda x: x != ""),
        }
    )
    error = lambda s: s == "错误回答"
    n, errors = F.size("_t"), F.size(F.filter("_states", error))
    scores = {
        "strategy_density": _ratio(F.size(F.filter("_t", lambda x: x["teaching_strategy"] != "")), n),
        "strategy_variety": _distinct_size(F.col("_used")) / STRATEGY_CLASSES,
        "ikt": _ratio(F.size(F.filter("annotations", lambda x: x["discipline_transfer"] == "是")), n),
        "bloom_progression": F.when(F.size("_levels") > 0, (F.array_max("_levels") - F.array_min("_levels")) / BLOOM_STEPS).otherwise(0.0),
        "structure_completeness": F.size(F.array_intersect(F.transform("_t", intent), F.array(*[F.lit(x) for x in REQUIRED_INTENTS]))) / 4,
        "l3_guidance_rate": _ratio(F.size(F.filter("_t", lambda x: x["teacher_guidance_level"] == "L3")), n),
        "cognitive_correction_rate": F.when(errors > 0, _corrections(F.col("_states"), error, lambda s: s.isin("高阶思考", "清晰理解")) / errors).otherwise(1.0),
    }
    return _with_total(df, scores, keep, None)


def session_metrics_b(sessions: DataFrame, keep: list[str]) -> DataFrame:
    """Exact matching of whole values; transfer counts all speakers and may exceed 1. A session without annotations has no row."""
    return _exact(sessions, keep, split_lists=False)


def session_metrics_c(sessions: DataFrame, keep: list[str]) -> DataFrame:
    """As B, with comma lists of strategies split and intents trimmed."""
    return _exact(sessions, keep, split_lists=True)


def turn_scores_d(sessions: DataFrame, keep: list[str]) -> DataFrame:
    """ann_no and history-aware score of every teacher annotation; the history is the earlier part of the array, so no window is needed."""
    a = F.col("annotations")
    df = sessions.where(F.size(a) > 0).withColumns(
        {
            "_classes": F.transform(a, lambda x: F.when(is_teacher(x["speaker"]), canonical_strategies(x["teaching_strategy"])).otherwise(F.array().cast("array<string>"))),
            "_intents": F.transform(a, lambda x: F.when(is_teacher(x["speaker"]), canonical_intent(x["teacher_intent"]))),
        }
    )
    before = lambda arr, i: F.slice(arr, F.lit(1), i)
    row = lambda x, i: F.struct(
        i.alias("ann_no"),
        is_teacher(x["speaker"]).alias("teacher"),
        F.array_contains(F.get("_classes", i), "invalid_echo").alias("echo"),
        F.coalesce(x["teaching_strategy"] != "", F.lit(False)).alias("any_strategy"),
        (F.size(F.array_except(F.get("_classes", i), F.flatten(before(F.col("_classes"), i)))) > 0).alias("new_strategy"),
        is_truthy(x["discipline_transfer"]).alias("transfer"),
        (F.get("_intents", i).isNotNull() & ~F.coalesce(F.array_contains(F.array_compact(before(F.col("_intents"), i)), F.get("_intents", i)), F.lit(False))).alias("new_intent"),
        F.coalesce(x["teacher_guidance_level"].contains("L3"), F.lit(False)).alias("l3"),
    )
    df = df.select(*keep, F.explode(F.filter(F.transform(a, row), lambda r: r["teacher"])).alias("r")).select(*keep, "r.*")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    df = df.select(
        *keep, "ann_no", one(F.col("any_strategy") & ~F.col("echo")).alias("has_strategy"), one(F.col("new_strategy")).alias("new_strategy"), one(F.col("transfer")).alias("transfer"),
        one(F.col("new_intent")).alias("new_intent"), one(F.col("l3") & ~F.col("echo")).alias("l3"), one(F.col("echo")).alias("invalid_echo"),
    )
    total = reduce(lambda p, q: p + q, [F.lit(w) * F.col(k) for k, w in TURN_WEIGHTS.items()])
    return df.withColumn("total_score", F.round(F.when(F.col("invalid_echo") > 0, F.greatest(total - 0.15, F.lit(0.0))).otherwise(total), 4))


def turn_scores_e(sessions: DataFrame, keep: list[str]) -> DataFrame:
    """turn_no and context-free score of every dialogue turn; null for students and teacher turns that no annotation matches by text.

    The match is a lookup in the session's own annotations (the last one of a text wins), so nothing is joined across sessions.
    """
    df = sessions.where(F.size("annotations") > 0).select(
        *keep,
        F.reverse("annotations").alias("_last_first"),
        F.reverse(F.transform("annotations", lambda x: utterance_key(x["utterance"]))).alias("_keys"),
        # the key of a turn is taken once, before it is looked up
        F.transform("dialogue", lambda t: F.when(is_teacher(t["role"]), F.nullif(utterance_key(t["content"]), F.lit("")))).alias("_turns"),
    )
    found = lambda k: F.struct(F.get("_last_first", F.array_position("_keys", k).cast("int") - 1).alias("a"))
    df = df.select(*keep, F.posexplode(F.transform("_turns", found)).alias("turn_no", "x"))
    a = F.col("x.a")
    classes = F.size(canonical_strategies(a["teaching_strategy"]))
    intents = _distinct_size(F.transform(comma_items(a["teacher_intent"]), canonical_intent))
    score = (
        F.lit(0.15) * F.when(classes > 0, 1.0).otherwise(0.0)
        + F.lit(0.10) * F.least(classes / 8.0, F.lit(1.0))
        + F.lit(0.15) * F.when(a["discipline_transfer"].isin("是", "Yes"), 1.0).otherwise(0.0)
        + F.lit(0.15) * F.least(intents / 4.0, F.lit(1.0))
        + F.lit(0.10) * F.when(a["teacher_guidance_level"].contains("L3"), 1.0).otherwise(0.0)
    )
    return df.select(*keep, "turn_no", F.when(a.isNotNull(), F.round(F.lit(0.35) + score, 4)).alias("turn_score"))
