"""Reshaping of dialogues: roles, histories, transcripts, nested and flat training layouts.

All of it works inside a session's arrays; a row per turn comes from one explode, and histories are slices, so there is no window and no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdial.functions.canon import chat_role, is_teacher, messages_hash, py_strip

MESSAGES = "array<struct<role:string,content:string>>"


def chat_messages(dialogue: Column) -> Column:
    """Messages with roles user and assistant."""
    return F.transform(dialogue, lambda t: F.struct(chat_role(t["role"]).alias("role"), t["content"].alias("content")))


def drop_system(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "system")


def transcript(messages: Column) -> Column:
    """Lines '**Role**: text'; null contents are empty."""
    line = lambda m: F.concat(F.lit("**"), F.initcap(m["role"]), F.lit("**: "), F.coalesce(m["content"], F.lit("")))
    return F.array_join(F.transform(messages, line), "\n")


def viewpoint(messages: Column, speaker: str) -> Column:
    """The history as one speaker sees it: own messages are assistant, the others' user; blank ones go."""
    mine = lambda m: F.struct(F.when(m["role"] == speaker, "assistant").otherwise("user").alias("role"), m["content"].alias("content"))
    return F.transform(F.filter(messages, lambda m: F.coalesce(py_strip(m["content"]) != "", F.lit(False))), mine)


def last_rounds(messages: Column, n: int = 10) -> Column:
    """System message(s) and the last n rounds, each a user message with what follows it; all others where there are no more than n rounds."""
    others = drop_system(messages)
    users = F.array_compact(F.transform(others, lambda m, i: F.when(m["role"] == "user", i + 1)))
    begin = F.coalesce(F.try_element_at(users, F.lit(-n)), F.lit(1)) if n > 0 else F.size(others) + 1
    return F.concat(F.filter(messages, lambda m: m["role"] == "system"), F.slice(others, begin, F.size(others)))


def next_role(messages: Column) -> Column:
    """Assistant after a user message, user otherwise."""
    return F.when(F.try_element_at(messages, F.lit(-1))["role"] == "user", "assistant").otherwise("user")


def first_exchange(dialogue: Column, topic_text: Column) -> Column:
    """struct(prompt, completion): the first non-empty user content and the first non-empty assistant content behind it; the topic where there is no prompt."""
    turns = chat_messages(dialogue)
    filled = lambda role: (lambda m: (m["role"] == role) & (F.coalesce(m["content"], F.lit("")) != ""))
    at = F.array_position(F.transform(turns, filled("user")), True)
    prompt = F.when(at > 0, F.get(turns, (at - 1).cast("int"))["content"])
    behind = F.slice(turns, (at + 1).cast("int"), F.greatest(F.lit(0), F.size(turns) - at.cast("int")))
    answer = F.when(at > 0, F.try_element_at(F.filter(behind, filled("assistant")), F.lit(1))["content"])
    return F.struct(F.coalesce(prompt, topic_text, F.lit("")).alias("prompt"), F.coalesce(answer, F.lit("")).alias("completion"))


def _without_keys(base: Column, other: Column) -> Column:
    return F.map_filter(base, lambda k, _v: ~F.array_contains(F.map_keys(other), k))


def overlay(*maps: Column) -> Column:
    """Union of maps, the later value of a key wins."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(_without_keys(out, m), m)
    return out


def session_metadata(source: str = "SID") -> Column:
    cols = ("student_type", "scenario", "topic_id", "student_id", "repeat_id")
    pairs = [F.lit("source"), F.lit(source)] + [x for c in cols for x in (F.lit(c), F.col(c))]
    return F.create_map(*pairs, F.lit("quality_score"), F.col("quality_score").cast("string"))


def conv_id() -> Column:
    return F.concat_ws("_", F.coalesce("topic_id", F.lit("None")), F.coalesce("student_id", F.lit("None")), F.coalesce("repeat_id", F.lit("None")), messages_hash(F.col("dialogue")))


def to_flat(sessions: DataFrame, use_quality_score: bool = True) -> DataFrame:
    """One row per assistant turn with a history. The history is a slice of the session's messages; its length is the turn_id."""
    base = sessions.select(
        "session_no", conv_id().alias("conv_id"), chat_messages(F.col("dialogue")).alias("_m"), F.col("dialogue.score").alias("_scores"),
        (F.col("quality_score") if use_quality_score else F.lit(1.0)).alias("_q"), first_exchange(F.col("dialogue"), F.col("topic_text")).alias("_x"), session_metadata().alias("single_turn_metadata"),
    )
    places = F.filter(F.transform("_m", lambda m, i: F.when((m["role"] == "assistant") & (i > 0), i)), lambda i: i.isNotNull())
    rows = base.withColumn("turn_id", F.explode(places))
    return rows.select(
        "session_no", "conv_id", F.slice("_m", F.lit(1), F.col("turn_id")).alias("prompt"), F.get("_m", F.col("turn_id"))["content"].alias("completion"),
        F.coalesce(F.get("_scores", F.col("turn_id")), "_q").alias("score"), F.col("_x.prompt").alias("single_turn_prompt"), F.col("_x.completion").alias("single_turn_completion"),
        "single_turn_metadata", "turn_id",
    )


def to_nested(sessions: DataFrame, use_quality_score: bool = True) -> DataFrame:
    """One row per session that has a sample: conv_id, the first exchange, metadata and turns[prompt, responses]."""
    q = F.col("quality_score") if use_quality_score else F.lit(1.0)
    base = sessions.select("session_no", conv_id().alias("conv_id"), chat_messages(F.col("dialogue")).alias("_m"), "dialogue", q.alias("_q"), first_exchange(F.col("dialogue"), F.col("topic_text")).alias("_x"), session_metadata().alias("single_turn_metadata"))
    turn = lambda t, i: F.when(
        is_teacher(t["role"]) & (i > 0),
        F.struct(F.slice("_m", F.lit(1), i).alias("prompt"), F.array(F.struct(t["content"].alias("completion"), F.coalesce(t["score"], F.col("_q")).alias("score"))).alias("responses")),
    )
    turns = F.filter(F.transform("dialogue", turn), lambda x: x.isNotNull())
    out = base.select("session_no", "conv_id", F.col("_x.prompt").alias("single_turn_prompt"), F.col("_x.completion").alias("single_turn_completion"), "single_turn_metadata", turns.alias("turns"))
    return out.where(F.size("turns") > 0)


def flatten_nested(nested: DataFrame, keep_id: bool = True) -> DataFrame:
    """Nested conversations to flat rows; keep_id=False numbers the conversations densely instead of keeping their ids."""
    if not keep_id:
        numbered = nested.select("conv_id").distinct().rdd.map(lambda r: r[0]).sortBy(lambda x: x).zipWithIndex().toDF("conv_id string, _no bigint")  # a dense index without one task
        nested = nested.join(numbered, "conv_id").withColumn("conv_id", F.col("_no").cast("string")).drop("_no")
    rest = [c for c in nested.columns if c != "turns"]
    t = nested.select(*rest, F.posexplode("turns").alias("turn_no", "t")).select(*rest, "turn_no", F.col("t.prompt").alias("prompt"), F.posexplode("t.responses").alias("response_no", "r"))
    return t.select(*rest, "turn_no", "response_no", "prompt", F.col("r.completion").alias("completion"), F.col("r.score").alias("score"), F.size("prompt").alias("turn_id"))


def group_responses(flat: DataFrame, order: str = "session_no") -> DataFrame:
    """(conv_id, turn_id) groups of flat rows: the first row's prompt and metadata, the responses in order."""
    first = lambda c: F.min_by(c, order).alias(c)
    ordered = F.sort_array(F.collect_list(F.struct(order, "completion", "score")))
    grouped = flat.groupBy("conv_id", "turn_id").agg(*[first(c) for c in ("prompt", "single_turn_prompt", "single_turn_completion", "single_turn_metadata")], ordered.alias("_r"))
    return grouped.withColumn("responses", F.transform("_r", lambda r: F.struct(r["completion"].alias("completion"), r["score"].alias("score")))).drop("_r")


def pair_windows(dialogue: Column) -> Column:
    """Consecutive pairs of turns; an odd last turn is dropped."""
    n = F.floor(F.size(dialogue) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(dialogue, i * 2 + 1, F.lit(2)))).otherwise(F.filter(F.array(dialogue), lambda x: F.lit(False)))


def inject_persona(messages: Column, personas: list[str], rank: Column) -> Column:
    """Replace the system message (or put one first) by the persona of the row's rank."""
    persona = F.element_at(F.array(*[F.lit(p) for p in personas]), (F.pmod(rank, F.lit(len(personas))) + 1).cast("int"))
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), persona.alias("content"))), drop_system(messages))


def aligned_annotations(dialogue: Column, annotations: Column) -> Column:
    """Turns with the annotation at the same place, null beyond the shorter."""
    return F.arrays_zip(dialogue.alias("turn"), annotations.alias("annotation"))


def patch_annotation(annotations: Column, place: int, values: dict[str, str]) -> Column:
    """Change fields of one annotation; speaker and utterance stay."""
    allowed = {k: v for k, v in values.items() if k not in ("speaker", "utterance")}
    changed = lambda x: x if not allowed else _with(x, allowed)
    return F.transform(annotations, lambda x, i: F.when(i == place, changed(x)).otherwise(x))


def _with(x: Column, values: dict[str, str]) -> Column:
    for k, v in values.items():
        x = x.withField(k, F.lit(v))
    return x
