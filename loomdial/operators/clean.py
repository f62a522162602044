"""The cleaning funnel (first failing rule wins) and the selections behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdial.functions.canon import is_student, is_teacher, py_strip
from loomdial.operators.merge import dense_index
from loomdial.operators.metrics import session_metrics_a
from loomdial.session import cut

# Roles that the format rule admits, patterns that give an answer away, patterns of refusals.
ADMITTED_ROLES = ("学生", "教师", "teacher", "student")
LEAKS = ("答案(是|为)", "结果(是|为|等于)", "正确选项", "选[A-D]")
SUMMARY = "综上所述"
REFUSALS = ("作为(一|名|个).*(AI|模型|程序)", "As an AI language model", "我(无法|不能)回答", "违反.*(政策|规定)", "I cannot answer", "涉及.*(敏感|政治)", "截止日期是")
SHORTEST, LONGEST, LEAST_TURNS = 4, 800, 3


def once(df: DataFrame, key: str = "session_no") -> DataFrame:
    """One row per key: copies that were delivered again go. For narrow projections; rows are alike in all other columns."""
    return df.dropDuplicates([key])


def _first_reason(dialogue: Column, reason) -> Column:
    """The reason of the first turn that has one; reason(turn, place) gives its first failing check or null."""
    return F.try_element_at(F.array_compact(F.transform(dialogue, reason)), F.lit(1))


def format_reason(dialogue: Column) -> Column:
    last = lambda i: F.lower(F.get(dialogue, i - 1)["role"])

    def reason(t, i):
        role = F.lower(t["role"])
        return (
            F.when(~F.coalesce(role.isin(*ADMITTED_ROLES), F.lit(False)), F.concat(F.lit("invalid_role_"), F.coalesce(t["role"], F.lit(""))))
            .when(F.coalesce(py_strip(t["content"]), F.lit("")) == "", "empty_content")
            .when((i > 0) & (role == last(i)), "role_repetition")
        )

    return F.when(F.coalesce(F.size(dialogue), F.lit(0)) < LEAST_TURNS, "too_short_turns").otherwise(_first_reason(dialogue, reason))


def content_reason(dialogue: Column) -> Column:
    def reason(t, i):
        role, text = F.lower(t["role"]), py_strip(t["content"])
        n = F.length(text)
        leak = text.rlike("|".join(LEAKS)) | (text.contains(SUMMARY) & (i < F.size(dialogue) - 1))
        return (
            F.when(role.isin("教师", "teacher"), F.when(n < SHORTEST, "teacher_too_short").when(n > LONGEST, "teacher_lecture_mode_too_long").when(leak, "leaked_answer_pattern"))
            .when(role.isin("学生", "student") & (n > LONGEST), "student_too_verbose")
        )

    return _first_reason(dialogue, reason)


def safety_reason(dialogue: Column) -> Column:
    refused = F.exists(dialogue, lambda t: is_teacher(t["role"]) & t["content"].rlike("(?iu)" + "|".join(REFUSALS)))
    return F.when(refused, "model_refusal_or_identity")


def is_complete(a: Column) -> Column:
    """An annotation with a speaker, an utterance and what its speaker's role needs."""
    has = lambda name: F.coalesce(py_strip(a[name]) != "", F.lit(False))
    needed = (
        F.when(is_teacher(a["speaker"]), has("teacher_intent") | has("teaching_strategy") | has("teacher_guidance_level"))
        .when(is_student(a["speaker"]), has("student_cognition_state") | has("cognitive_level"))
        .otherwise(True)
    )
    return has("speaker") & has("utterance") & needed


def complete_annotations(annotations: Column) -> Column:
    return F.filter(annotations, is_complete)


def nonblank_turns(dialogue: Column) -> Column:
    return F.filter(dialogue, lambda t: F.coalesce(py_strip(t["content"]) != "", F.lit(False)))


def funnel(sessions: DataFrame, keep: list[str], gates: bool = True) -> DataFrame:
    """keep columns, reason ('pass' or the first failing rule), ikt, strategy_variety, total_score. One projection, no exchange.

    Order: format, content, safety, then metrics A over complete annotations, then the gates ikt > 0 and variety >= 0.5.
    """
    rules = F.coalesce(format_reason(F.col("dialogue")), content_reason(F.col("dialogue")), safety_reason(F.col("dialogue")))
    df = sessions.withColumn("_rule", rules).withColumn("annotations", complete_annotations(F.col("annotations")))
    df = session_metrics_a(df, [*keep, "_rule"])
    gate = F.when(F.coalesce(F.col("ikt"), F.lit(0.0)) <= 0, "ikt_zero").when(F.coalesce(F.col("strategy_variety"), F.lit(0.0)) < 0.5, "low_strategy_variety")
    reason = F.coalesce("_rule", gate, F.lit("pass")) if gates else F.coalesce("_rule", F.lit("pass"))
    return df.select(*keep, reason.alias("reason"), "ikt", "strategy_variety", "total_score")


def drop_counts(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


#: Bins of a score histogram, whatever the range of the score.
BINS = 4096


def top_share(df: DataFrame, score: str, order: str, share: float = 0.35, floor: int = 100) -> DataFrame:
    """The best max(int(n * share), min(n, floor)) rows; ties by order, null scores last.

    The bin of the k-th best row is found from a histogram of scores first. The rows of that bin, most of all where scores are tied,
    get a dense index over range partitions of score and order, so no task ranks them all.
    """
    low, high = df.agg(F.min(score), F.max(score)).first()
    width = (high - low) / (BINS - 1) if high is not None and high > low else 1.0
    bin_ = F.when(F.col(score).isNull(), -1).otherwise(F.least(F.lit(BINS - 1), F.floor((F.col(score) - F.lit(low)) / F.lit(width))))
    binned = df.withColumn("_bin", bin_.cast("int"))
    per = {r["_bin"]: r["n"] for r in binned.groupBy("_bin").agg(F.count("*").alias("n")).collect()}  # BINS + 1 rows at most
    n = sum(per.values())
    keep, upto, edge = max(int(n * share), min(n, floor)), 0, None
    for b in sorted(per, reverse=True):
        if upto + per[b] > keep:
            edge = b
            break
        upto += per[b]
    if edge is None:
        return df
    sure, tied = binned.where(F.col("_bin") > edge), binned.where(F.col("_bin") == edge).withColumn("_down", F.coalesce(-F.col(score), F.lit(0.0)))
    return sure.drop("_bin").unionByName(dense_index(tied, ["_down", order], "_ix").where(F.col("_ix") < keep - upto).drop("_bin", "_down", "_ix"))


def balanced_top(df: DataFrame, group: str, score: str, order: str, target: int) -> DataFrame:
    """target rows, spread over the groups, best first: an even quota (one more for the first groups by name), or the best groups with one each
    where there are fewer places than groups; free places go to the best of the rest."""
    within = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), order)
    groups = cut(df.groupBy(group).agg(F.max(score).alias("_best")))
    k = groups.count()
    if target >= k:  # no more groups than places: target rows at most are numbered
        first = F.row_number().over(Window.orderBy(group)) <= F.lit(target % k if k else 0)
        quotas = groups.select(group, (F.lit(target // k if k else 0) + first.cast("int")).alias("_quota"))
    else:  # the best groups, found by a distributed top-k
        quotas = groups.orderBy(F.desc_nulls_last("_best"), group).limit(target).select(group, F.lit(1).alias("_quota"))
    # quota and fill take at most 2 * target rows of a group: this literal limit is applied in every partition before the exchange, so a hot group stays small
    best = df.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= 2 * int(target))
    placed = best.join(quotas.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("_quota", F.coalesce("_quota", F.lit(0))).drop("_g")
    chosen = placed.where("_r <= _quota")
    rest = placed.where(f"_r > _quota and _r <= _quota + {int(target)}")
    missing = chosen.agg((F.lit(target) - F.count("*")).alias("_missing"))
    fill = rest.orderBy(F.col(score).desc_nulls_last(), order).limit(target).withColumn("_f", F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), order)))
    fill = fill.join(F.broadcast(missing)).where("_f <= _missing").drop("_f", "_missing")
    return chosen.unionByName(fill).drop("_r", "_quota")


def run_pipeline(sessions: DataFrame, target: int | None = None) -> DataFrame:
    """Cleaned and selected sessions: the funnel, then balanced_top for a target below the number left, all for a larger target, top_share without one."""
    passed = cut(once(funnel(sessions, ["session_no", "topic_id"]).where("reason = 'pass'")))  # narrow rows; the selection reads them twice
    if target is None:
        return top_share(passed, "total_score", "session_no")
    return balanced_top(passed, "topic_id", "total_score", "session_no", target)
