"""Smaller projections, parses and orders: summaries, paired responses, baseline pairs, uploaded metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdial.functions.canon import comma_items, is_finished, is_student, is_teacher, py_strip
from loomdial.operators.dialogue import MESSAGES, chat_messages
from loomdial.operators.merge import RESPONSE
from loomdial.sources.readers import metric_entry


def session_summary() -> dict[str, Column]:
    """Columns that describe a session: sizes, turns by speaker, strategies with their frequency, disciplines, levels, finished."""
    strategies = F.flatten(F.transform("annotations", lambda a: comma_items(a["teaching_strategy"])))
    values = lambda name: F.array_sort(F.array_distinct(F.filter(F.transform("annotations", lambda a: a[name]), lambda v: v != "")))
    return {
        "turns": F.size("dialogue"),
        "annotation_count": F.coalesce(F.size("annotations"), F.lit(0)),
        "teacher_turns": F.size(F.filter("dialogue", lambda t: is_teacher(t["role"]))),
        "student_turns": F.size(F.filter("dialogue", lambda t: is_student(t["role"]))),
        "strategy_count": F.coalesce(F.size(strategies), F.lit(0)),
        "strategy_kinds": F.coalesce(F.size(F.array_distinct(strategies)), F.lit(0)),
        "disciplines": F.coalesce(F.array_join(values("discipline"), ","), F.lit("")),
        "levels": F.coalesce(F.array_join(values("teacher_guidance_level"), ","), F.lit("")),
        "consistent": F.coalesce((F.size("dialogue") > 0) & (F.size("annotations") > 0), F.lit(False)),
        "finished": F.coalesce(F.exists("dialogue", lambda t: is_finished(t["content"])), F.lit(False)),
    }


def strategy_counts(annotations: Column) -> Column:
    """map strategy -> how often."""
    all_ = F.flatten(F.transform(annotations, lambda a: comma_items(a["teaching_strategy"])))
    return F.map_from_entries(F.transform(F.array_distinct(all_), lambda s: F.struct(s, F.size(F.filter(all_, lambda x: x == s)))))


def paired_responses(messages: Column, responses: Column) -> Column:
    """Student messages zipped with a map place -> answer: turns of the pairs in which both are not blank."""
    filled = lambda c: F.nullif(py_strip(c), F.lit(""))
    pair = lambda m, i: F.array(F.struct(F.lit("学生").alias("role"), filled(m["content"]).alias("content")), F.struct(F.lit("教师").alias("role"), filled(F.try_element_at(responses, i)).alias("content")))
    return F.flatten(F.filter(F.transform(messages, pair), lambda p: p[0]["content"].isNotNull() & p[1]["content"].isNotNull()))


def nonblank_pairs(columns: list[str]) -> Column:
    """array of (label, value) of the columns that are not blank."""
    return F.filter(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in columns]), lambda p: F.coalesce(py_strip(p["value"]) != "", F.lit(False)))


def row_title(dialogue: Column) -> Column:
    """First student text, else the first text, else ''."""
    first = lambda turns: F.try_element_at(turns, F.lit(1))["content"]
    return F.coalesce(first(F.filter(dialogue, lambda t: is_student(t["role"]))), first(dialogue), F.lit(""))


def with_end(c: Column, mark: str) -> Column:
    """With an end mark, once."""
    return F.when(c.endswith(mark), c).otherwise(F.concat(c, F.lit(mark)))


def short(c: Column, n: int = 50) -> Column:
    """Start of a text, with an ellipsis if it was longer."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def timestamp_token(c: Column) -> Column:
    """yyyyMMdd-HHmmss of a timestamp or of milliseconds."""
    return F.date_format(c, "yyyyMMdd-HHmmss")


def baseline_pairs(sessions: DataFrame, generated: DataFrame) -> DataFrame:
    """Preference pairs of recorded teacher turns (chosen, 1.0) and generated ones (rejected, 0.0): session_no, turn_id, prompt, chosen, rejected.

    generated: session_no, turn_id, rejected. Blank turns are left out of history; a teacher turn without history is history only; a turn that was not
    generated (null or blank) gives no pair.
    """
    filled = F.filter(chat_messages(F.col("dialogue")), lambda m: F.coalesce(py_strip(m["content"]) != "", F.lit(False)))
    base = sessions.select("session_no", filled.cast(MESSAGES).alias("_m"))
    places = F.filter(F.transform("_m", lambda m, i: F.when((m["role"] == "assistant") & (i > 0), i)), lambda i: i.isNotNull())
    rows = base.withColumn("turn_id", F.explode(places)).select("session_no", "turn_id", F.slice("_m", F.lit(1), F.col("turn_id")).alias("prompt"), F.get("_m", F.col("turn_id"))["content"].alias("chosen"))
    g = generated.where(py_strip(F.col("rejected")) != "").select("session_no", "turn_id", "rejected")
    return rows.join(g, ["session_no", "turn_id"]).withColumns({"score_chosen": F.lit(1.0), "score_rejected": F.lit(0.0), "margin": F.lit(1.0)})


def uploaded_metrics(records: DataFrame, value: str = "value") -> DataFrame:
    """row_index, dialogue_id, metric, score, display, raw_value of a JSON array of per-file metric records; what is no array gives no row."""
    parsed = F.from_json(value, "array<struct<dialogue_id:string,metrics_results:map<string,string>>>")
    rows = records.where(F.schema_of_variant(F.try_parse_json(value)).startswith("ARRAY")).select(F.posexplode(parsed).alias("row_index", "r"))
    return rows.select("row_index", "r.dialogue_id", F.explode("r.metrics_results").alias("metric", "entry")).select("row_index", "dialogue_id", "metric", metric_entry(F.col("entry")).alias("e")).select("row_index", "dialogue_id", "metric", "e.*")


def uploaded_summary(records: DataFrame, value: str = "value") -> DataFrame:
    """total and the texts of average_scores and average_raw_values of summary records."""
    s = F.from_json(value, "total_dialogues_processed bigint, average_scores map<string,string>, average_raw_values map<string,string>")
    return records.select(s.alias("s")).select(F.col("s.total_dialogues_processed").alias("total"), "s.average_scores", "s.average_raw_values")


def rewrites(lines: DataFrame, value: str = "value", order: str = "ord") -> DataFrame:
    """pair_no, rewrite of batch responses with ids rw-<number>; status 200 and a text that is not blank; the last line of an id wins."""
    r = lines.select(order, F.from_json(value, f"custom_id string, response {RESPONSE}").alias("j")).where(F.col("j.custom_id").rlike("^rw-[0-9]+$"))
    text = py_strip(F.try_element_at(F.col("j.response.body.choices"), F.lit(1))["message"]["content"])
    r = r.where((F.col("j.response.status_code") == 200) & (text != ""))
    return r.groupBy(F.expr("cast(substring(j.custom_id, 4) as bigint)").alias("pair_no")).agg(F.max_by(text, order).alias("rewrite"))


def best_first(df: DataFrame, score: str, *then: str) -> DataFrame:
    """By a score, missing ones last; ties by the other columns."""
    return df.orderBy(F.col(score).desc_nulls_last(), *then)


def by_locale(df: DataFrame, *columns: str) -> DataFrame:
    """In the order of the root collation."""
    return df.orderBy(*[F.collate(c, "UNICODE") for c in columns])


def most_recent(df: DataFrame, key: str, at: str, group: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(group or [])).agg(F.max_by(key, at).alias(key))
