"""Queries of the core library: name -> (spark, sf_dir) -> DataFrame. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomdial.functions import canon
from loomdial.operators import clean, dialogue, merge, metrics, pairs
from loomdial.operators.packed import split_packed, strategy_values
from loomdial.session import read

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _sessions(spark, d):
    return read(spark, d, "sessions")


def _rounded(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


SCORES = [*metrics.METRICS, "total_score"]


@query
def p3_found(spark, d):
    values = strategy_values(_sessions(spark, d))
    return split_packed(values, "teaching_strategy", "student", min_values=2).select("session_no", "ann_no", "pos", "item_value")


# --- metrics


@query
def session_metrics_a(spark, d):
    return _rounded(clean.once(metrics.session_metrics_a(_sessions(spark, d), ["session_no"])), SCORES)


@query
def session_metrics_b(spark, d):
    return _rounded(clean.once(metrics.session_metrics_b(_sessions(spark, d), ["session_no"])), SCORES)


@query
def session_metrics_c(spark, d):
    return _rounded(clean.once(metrics.session_metrics_c(_sessions(spark, d), ["session_no"])), SCORES)


@query
def turn_scores_d(spark, d):
    return metrics.turn_scores_d(_sessions(spark, d), ["session_no"]).dropDuplicates(["session_no", "ann_no"])


@query
def turn_scores_e(spark, d):
    return metrics.turn_scores_e(_sessions(spark, d), ["session_no"]).dropDuplicates(["session_no", "turn_no"])


@query
def last_turn_score(spark, d):
    """Score of the last teacher annotation with its history."""
    s = turn_scores_d(spark, d)
    return s.groupBy("session_no").agg(F.max_by("total_score", "ann_no").alias("total_score"))


@query
def metric_variant_gap(spark, d):
    """Mean of the three totals and of their differences; every session carries all three, so nothing is joined."""
    s = _sessions(spark, d).where(F.size("annotations") > 0)
    a = metrics.session_metrics_a(s, ["session_no", "annotations"]).select("session_no", "annotations", F.col("total_score").alias("a"))
    b = metrics.session_metrics_b(a, ["session_no", "annotations", "a"]).select("session_no", "annotations", "a", F.col("total_score").alias("b"))
    c = metrics.session_metrics_c(b, ["session_no", "a", "b"]).select("session_no", "a", "b", F.col("total_score").alias("c"))
    c = clean.once(c)
    return c.agg(F.count("*").alias("n"), F.round(F.avg("a"), 5).alias("mean_a"), F.round(F.avg("b"), 5).alias("mean_b"), F.round(F.avg("c"), 5).alias("mean_c"), F.round(F.avg(F.abs(F.col("b") - F.col("c"))), 5).alias("gap_b_c"))


@query
def metric_summary(spark, d):
    b = clean.once(metrics.session_metrics_b(_sessions(spark, d), ["session_no"]))
    return _rounded(merge.summary(b, SCORES), SCORES)


@query
def metric_summary_by_group(spark, d):
    b = clean.once(metrics.session_metrics_b(_sessions(spark, d), ["session_no", "topic_id"]))
    return _rounded(merge.summary(b, SCORES, ["topic_id"]), SCORES)


@query
def score_spread(spark, d):
    """Mean and sample deviation of the candidates' scores per conversation (AGG-07, AGG-08)."""
    f = read(spark, d, "flat_rows").select("row_no", "conv_id", "score").dropDuplicates(["row_no"])
    return _rounded(merge.mean_and_deviation(f, ["conv_id"], "score"), ["mean", "deviation"])


@query
def weighted_rewards(spark, d):
    """Reward as a weighted sum over a session's metric scores (AGG-06, JN-10)."""
    b = clean.once(metrics.session_metrics_b(_sessions(spark, d), ["session_no"]))
    return b.select("session_no", F.round(merge.weighted_reward(F.array("ikt", "bloom_progression", "l3_guidance_rate"), [0.5, 0.3, 0.2]), 6).alias("reward"))


@query
def metric_rows_long(spark, d):
    """The metrics of a session as rows (PRJ-33)."""
    b = clean.once(metrics.session_metrics_b(_sessions(spark, d), ["session_no"]))
    return b.unpivot(["session_no"], SCORES, "metric", "score").withColumn("score", F.round("score", 6))


# --- funnel and selection


@query
def drop_reasons_format(spark, d):
    s = _sessions(spark, d).select("session_no", F.coalesce(clean.format_reason(F.col("dialogue")), F.lit("pass")).alias("reason"))
    return clean.drop_counts(clean.once(s))


@query
def drop_reasons_content(spark, d):
    s = _sessions(spark, d).select("session_no", F.coalesce(clean.content_reason(F.col("dialogue")), F.lit("pass")).alias("reason"))
    return clean.drop_counts(clean.once(s))


@query
def drop_reasons_safety(spark, d):
    s = _sessions(spark, d).select("session_no", F.coalesce(clean.safety_reason(F.col("dialogue")), F.lit("pass")).alias("reason"))
    return clean.drop_counts(clean.once(s))


@query
def funnel_reasons(spark, d):
    return clean.once(clean.funnel(_sessions(spark, d), ["session_no"])).select("session_no", "reason")


@query
def annotations_complete(spark, d):
    s = _sessions(spark, d).select("session_no", F.size("annotations").alias("n"), F.size(clean.complete_annotations(F.col("annotations"))).alias("complete"))
    return clean.once(s.where("n > 0"))


@query
def nonblank_turns(spark, d):
    return clean.once(_sessions(spark, d).select("session_no", F.size("dialogue").alias("n"), F.size(clean.nonblank_turns(F.col("dialogue"))).alias("filled")))


@query
def quality_stats(spark, d):
    s = clean.once(_sessions(spark, d).select("session_no", "quality_score"))
    return s.agg(F.count("quality_score").alias("n"), F.min("quality_score").alias("least"), F.max("quality_score").alias("most"), F.round(F.avg("quality_score"), 6).alias("mean"))


@query
def top_percentile(spark, d):
    s = clean.once(_sessions(spark, d).select("session_no", "quality_score"))
    return clean.top_share(s, "quality_score", "session_no")


@query
def balanced_sample(spark, d):
    s = clean.once(_sessions(spark, d).where("topic_id is not null").select("session_no", "topic_id", "quality_score"))
    return clean.balanced_top(s, "topic_id", "quality_score", "session_no", 300).select("session_no", "topic_id")


@query
def pipeline(spark, d):
    """Clean and select in one go."""
    return clean.run_pipeline(_sessions(spark, d)).select("session_no", "total_score")


# --- conversion


@query
def role_normalize(spark, d):
    s = _sessions(spark, d).select("session_no", "dialogue")
    t = s.select("session_no", F.posexplode("dialogue").alias("turn_no", "t")).select("session_no", "turn_no", canon.chat_role(F.col("t.role")).alias("role"))
    return t.dropDuplicates(["session_no", "turn_no"]).groupBy("role").agg(F.count("*").alias("n"))


@query
def speaker_counts(spark, d):
    """Turns by speaker per session (PRJ-34)."""
    n = lambda p: F.size(F.filter("dialogue", lambda t: p(t["role"])))
    return clean.once(_sessions(spark, d).select("session_no", F.size("dialogue").alias("turns"), n(canon.is_teacher).alias("teacher"), n(canon.is_student).alias("student")))


@query
def transcript_digest(spark, d):
    """md5 of the rendered prompt without system messages."""
    text = dialogue.transcript(dialogue.drop_system(F.col("prompt")))
    return read(spark, d, "flat_rows").select("row_no", F.md5(text.cast("binary")).alias("digest")).dropDuplicates(["row_no"])


@query
def prefix_history(spark, d):
    """Flat rows made from sessions: history digest, length and score per sample."""
    flat = dialogue.to_flat(_sessions(spark, d))
    out = flat.select("session_no", "turn_id", canon.dialogue_digest(F.col("prompt")).alias("digest"), "score")
    return out.dropDuplicates(["session_no", "turn_id"])


@query
def first_exchange(spark, d):
    x = dialogue.first_exchange(F.col("dialogue"), F.col("topic_text"))
    return clean.once(_sessions(spark, d).select("session_no", x.alias("x")).select("session_no", "x.prompt", "x.completion"))


@query
def conv_id_hash(spark, d):
    return clean.once(_sessions(spark, d).select("session_no", dialogue.conv_id().alias("conv_id")))


@query
def nested_roundtrip(spark, d):
    """Nested and flattened again: samples and characters per session."""
    flat = dialogue.flatten_nested(dialogue.to_nested(_sessions(spark, d)))
    rows = flat.select("session_no", "turn_id", F.length("completion").alias("c")).dropDuplicates(["session_no", "turn_id"])
    return rows.groupBy("session_no").agg(F.count("*").alias("samples"), F.sum("c").alias("characters"))


@query
def grouped_responses(spark, d):
    """Flat rows grouped to turns with their responses in order."""
    f = read(spark, d, "flat_rows").dropDuplicates(["row_no"])
    return dialogue.group_responses(f, "row_no").select("conv_id", "turn_id", F.size("responses").alias("n"), F.md5(F.array_join(F.transform("responses", lambda r: F.coalesce(r["completion"], F.lit(""))), "|").cast("binary")).alias("digest"))


@query
def context_window(spark, d):
    m = dialogue.last_rounds(F.col("prompt"), 4)
    return read(spark, d, "flat_rows").select("row_no", F.size(m).alias("messages"), canon.dialogue_digest(m).alias("digest")).dropDuplicates(["row_no"])


@query
def viewpoint_messages(spark, d):
    v = dialogue.viewpoint(F.col("prompt"), "user")
    return read(spark, d, "flat_rows").select("row_no", canon.dialogue_digest(v).alias("digest"), dialogue.next_role(F.col("prompt")).alias("next_role")).dropDuplicates(["row_no"])


@query
def persona_inject(spark, d):
    m = dialogue.inject_persona(F.col("prompt"), ["gentle", "strict", "curious"], F.col("row_no"))
    return read(spark, d, "flat_rows").select("row_no", canon.dialogue_digest(m).alias("digest")).dropDuplicates(["row_no"])


@query
def pair_windows(spark, d):
    w = dialogue.pair_windows(F.col("dialogue"))
    s = clean.once(_sessions(spark, d).select("session_no", F.transform(w, lambda p: F.length(F.concat_ws("", p["content"]))).alias("w")))
    return s.select("session_no", F.posexplode("w").alias("pair_no", "characters"))


@query
def metadata_overlay(spark, d):
    m = dialogue.overlay(F.col("single_turn_metadata"), F.create_map(F.lit("source"), F.lit("merged"), F.lit("round"), F.lit("1")))
    out = read(spark, d, "flat_rows").select("row_no", F.try_element_at(m, F.lit("source")).alias("source"), F.try_element_at(m, F.lit("topic_id")).alias("topic"), F.size(m).alias("n"))
    return out.dropDuplicates(["row_no"])


# --- pairs, splits, samples


def _flat(spark, d, *cols):
    return read(spark, d, "flat_rows").select("row_no", *cols).dropDuplicates(["row_no"])


@query
def sft_best(spark, d):
    best = pairs.to_sft(_flat(spark, d, "conv_id", "turn_id", "prompt", "completion", "score"), "score", 0.3)
    return best.select("conv_id", "row_no", canon.dialogue_digest(F.col("messages")).alias("digest"))


@query
def dpo_from_flat(spark, d):
    return pairs.to_dpo(_flat(spark, d, "conv_id", "turn_id", "score"), ["conv_id", "turn_id"], "score", ["row_no"], 0.05).withColumn("margin", F.round("margin", 6))


@query
def dpo_from_lineitem(spark, d):
    """Best against the rest at scale: orders as groups, extended prices as scores."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    li = read(spark, d, "lineitem").select("l_orderkey", *keys)
    p = pairs.to_dpo(li, ["l_orderkey"], "l_extendedprice", keys[:4], 1000.0)
    return p.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.max("score_chosen").alias("best"), F.round(F.sum("margin"), 2).alias("margin"))


@query
def inputs_dedup(spark, d):
    return pairs.to_inputs(_flat(spark, d, "conv_id", "turn_id", "prompt", "single_turn_prompt")).select("conv_id", "turn_id", "row_no", canon.dialogue_digest(F.col("prompt")).alias("digest"))


@query
def uniform_split(spark, d):
    return pairs.uniform_split(read(spark, d, "documents").select("doc_id"), "doc_id", 0.1).select("doc_id", "split")


@query
def split_sizes(spark, d):
    return uniform_split(spark, d).groupBy("split").agg(F.count("*").alias("n"))


@query
def sample_without_replacement(spark, d):
    return pairs.sample_exact(read(spark, d, "documents").select("doc_id", "source"), "doc_id", 200, 7)


@query
def repeat_sample(spark, d):
    return pairs.repeat_sample(read(spark, d, "topics").select("topic_id"), "topic_id", 1000, 11).groupBy("topic_id").agg(F.count("*").alias("copies"))


@query
def mix_external(spark, d):
    """External answers so that they make up a tenth of conversations (MTH-02, SRT-10, SET-01, AGG-15)."""
    f = _flat(spark, d, "conv_id", "single_turn_metadata").withColumn("source", F.coalesce(F.try_element_at("single_turn_metadata", F.lit("source")), F.lit("unknown"))).drop("single_turn_metadata")
    own, other = f.where("source = 'SID'"), f.where("source <> 'SID'")
    n = own.agg(F.countDistinct("conv_id")).first()[0]
    mixed = own.unionByName(pairs.sample_exact(other, "row_no", pairs.mix_size(n, 0.1)))
    return mixed.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


# --- joins and merges


@query
def outer_merge(spark, d):
    s = clean.once(_sessions(spark, d).select("session_no", "topic_id"))
    m = clean.once(metrics.session_metrics_b(_sessions(spark, d), ["session_no"])).where("session_no % 3 <> 0")  # a part of the rows has no upload here
    out = merge.outer_merge(s, m.select("session_no", "total_score", "ikt"), ["session_no"], F.col("total_score") >= 0.3, F.col("topic_id").isNull())
    return out.groupBy("metrics_source", "has_row", "has_metrics").agg(F.count("*").alias("n"))


@query
def count_mismatch(spark, d):
    f = _flat(spark, d, "conv_id")
    p = _flat(spark, d, "conv_id", "score").where("score is not null")
    return merge.count_mismatches(f, p, ["conv_id"])


@query
def missing_summary(spark, d):
    docs = read(spark, d, "documents")
    up = docs.where("n_chars is not null").groupBy("source").agg(F.count("*").alias("n"))
    comp = docs.where("source is not null").groupBy("source").agg(F.sum(F.lit(1)).alias("n"))
    return merge.fill_missing_summaries(up.where("n >= 100 and source is not null"), comp, "source")


@query
def merge_rewrites(spark, d):
    p = read(spark, d, "dpo_pairs").select("pair_no", "chosen").dropDuplicates(["pair_no"])
    r = p.where("pair_no % 4 = 1").select("pair_no", F.concat(F.lit(" rewritten "), F.col("pair_no").cast("string")).alias("rewrite"))
    return merge.merge_rewrites(p, r).select("pair_no", F.md5(F.coalesce("chosen", F.lit("")).cast("binary")).alias("chosen"), F.col("original_chosen").isNotNull().alias("rewritten"))


@query
def dim_lookup(spark, d):
    """Nations of a region with customers, by small dimensions (JN-06, JN-07)."""
    n = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region").where("r_name in ('ASIA', 'EUROPE')")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read(spark, d, "customer").join(merge.small_side(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query
def topic_distribution(spark, d):
    s = clean.once(_sessions(spark, d).select("session_no", F.coalesce("student_type", F.lit("unknown")).alias("student_type"), "topic_id"))
    return s.groupBy("student_type").agg(F.count("*").alias("n"), F.countDistinct("topic_id").alias("topics"))


@query
def strategy_frequency(spark, d):
    a = _sessions(spark, d).select("session_no", F.posexplode(F.col("annotations.teaching_strategy")).alias("ann_no", "v")).dropDuplicates(["session_no", "ann_no"])
    return a.select(F.explode(canon.comma_items(F.col("v"))).alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n"))


@query
def canonical_labels(spark, d):
    """Annotation labels by canonical class (STR-01..03)."""
    a = _sessions(spark, d).select("session_no", F.posexplode("annotations").alias("ann_no", "a")).select("session_no", "ann_no", "a.teaching_strategy", "a.teacher_intent", "a.cognitive_level")
    a = a.dropDuplicates(["session_no", "ann_no"])
    return a.groupBy(
        F.coalesce(canon.canonical_strategy(F.col("teaching_strategy")), F.lit("-")).alias("strategy"), F.coalesce(canon.canonical_intent(F.col("teacher_intent")), F.lit("-")).alias("intent"), canon.bloom_level(F.col("cognitive_level")).alias("bloom")
    ).agg(F.count("*").alias("n"))


@query
def correction_rate(spark, d):
    """Errors directly followed by a click or purchase of the same user (WIN-03 on events)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").select("user_id", "event_type", F.lead("event_type").over(w).alias("next"))
    errors = F.count_if(F.col("event_type") == "error")
    fixed = F.count_if((F.col("event_type") == "error") & F.col("next").isin("click", "purchase"))
    return e.groupBy("user_id").agg(errors.alias("errors"), fixed.alias("corrected"))


@query
def props_json(spark, d):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(v).alias("k"), F.count_if(v.isNull()).alias("bad"))


@query
def text_stats(spark, d):
    t = F.length("text")
    return read(spark, d, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.sum(t).alias("characters"), F.floor(F.sum(t) / 2).alias("tokens"), F.max(t).alias("longest"))


@query
def filename_codec(spark, d):
    x = F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.col("doc_id").cast("string"), F.lit("?>.jsonl"))
    i = canon.parse_request_id(canon.request_id(x, F.col("doc_id"), F.lit(3)))
    return read(spark, d, "documents").select("doc_id", canon.encode_name(x).alias("code"), (i["name"] == x).alias("same"), i["dialogue"].alias("dialogue"), i["pair"].alias("pair"))


@query
def digests(spark, d):
    """md5 of prompts and the rolling hash of topics."""
    f = _flat(spark, d, "single_turn_prompt").select("row_no", F.md5(F.coalesce("single_turn_prompt", F.lit("")).cast("binary")).alias("digest"))
    return f


@query
def rolling_hashes(spark, d):
    return read(spark, d, "topics").select("topic_id", canon.rolling_hash(F.col("topic")).alias("hash"))


@query
def keyword_search(spark, d):
    return merge.keyword_search(read(spark, d, "documents").select("doc_id", "source", "lang", "text"), ["source", "lang", "text"], "Biology").select("doc_id")


@query
def request_parts(spark, d):
    r = read(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"))
    return merge.request_parts(r, "source", "doc_id", "bytes", 30_000)


@query
def round_robin(spark, d):
    """Dense index, model in turn, contiguous shard and alternate prompt (WIN-12..15)."""
    t = merge.dense_index(read(spark, d, "documents").select("doc_id"), ["doc_id"])
    n = t.agg(F.count("*").alias("_n"))
    t = t.join(F.broadcast(n))
    return t.select("doc_id", "ix", F.pmod("ix", F.lit(4)).alias("model"), merge.shard(F.col("ix"), F.col("_n"), 7).alias("shard"), (F.col("ix") < F.floor(F.col("_n") * F.lit(0.25))).alias("alternate"))


@query
def generation_grid(spark, d):
    """topics x 5 students x 2 repeats, with a student type by hash (JN-15, SRT-14); an expansion of each row, not a join."""
    t = read(spark, d, "topics").select("topic_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("student")).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(2))))
    return t.withColumn("style", F.pmod(F.conv(F.left(F.md5(F.concat_ws(":", "topic_id", "student", "repeat").cast("binary")), F.lit(6)), 16, 10).cast("bigint"), F.lit(3)))


@query
def finished_sessions(spark, d):
    s = _sessions(spark, d).select("session_no", F.exists("dialogue", lambda t: canon.is_finished(t["content"])).alias("finished"), F.md5(canon.display_text(F.element_at("dialogue", -1)["content"]).cast("binary")).alias("last"))
    return clean.once(s)


@query
def path_and_model_names(spark, d):
    x = F.concat(F.lit("\\final\\G0"), F.pmod("doc_id", F.lit(15)).cast("string"), F.lit("\\"), F.coalesce("source", F.lit("none")), F.lit(".jsonl"))
    m = F.concat(F.lit("g0"), F.pmod("doc_id", F.lit(15)).cast("string"))
    return read(spark, d, "documents").select("doc_id", canon.strip_suffix(canon.base_name(x), ".jsonl").alias("file"), canon.model_name(m).alias("model"), canon.is_ablation(m).alias("ablation"), canon.is_junk_path(x).alias("junk"))


@query
def display_scores(spark, d):
    s = F.concat(F.col("l_linenumber").cast("string"), F.lit(".5%"))
    return read(spark, d, "lineitem").groupBy(s.alias("display"), canon.score_from_display(s).alias("score")).agg(F.count("*").alias("n"))


@query
def chart_axis(spark, d):
    return metric_summary_by_group(spark, d).agg(F.max("total_score").alias("best"), merge.axis_top(F.max("total_score")).alias("top"))


# --- functions without SQL, simulation


@query
def lenient_json(spark, d):
    """Sloppy JSON made from event rows, read again."""
    from loomdial.functions.lenient import first_array_text
    from loomdial.functions.lenient import lenient_json as read_json

    sloppy = F.concat(F.lit("answer: {'kind': '"), F.col("event_type"), F.lit("', 'n': "), F.col("event_id").cast("string"), F.lit(", flag: TRUE, list: [1, 2,],} thanks"))
    e = read(spark, d, "events").select("event_type", "event_id", read_json(sloppy).alias("j"), first_array_text(sloppy).alias("a"))
    return e.groupBy(F.get_json_object("j", "$.kind").alias("kind"), "a").agg(F.count("*").alias("n"), F.sum(F.get_json_object("j", "$.n").cast("bigint")).alias("total"))


@query
def simulate_rounds(spark, d):
    from loomdial.streaming.simulate import simulate

    s = clean.once(_sessions(spark, d).select("session_no", F.slice(dialogue.chat_messages(F.col("dialogue")), 1, 1).alias("history")))
    return simulate(s.withColumnRenamed("session_no", "id")).groupBy("active", F.size("history").alias("messages")).agg(F.count("*").alias("n"))


@query
def synthesize_candidates(spark, d):
    from loomdial.functions.registry import get
    from loomdial.streaming.simulate import echo_responder, synthesize

    s = clean.once(_sessions(spark, d).select("session_no", F.slice(dialogue.chat_messages(F.col("dialogue")), 1, 1).alias("history"))).withColumnRenamed("session_no", "id")
    out = synthesize(s, echo_responder, lambda _h, texts: get("length")(texts))
    return out.groupBy("turn_id", "candidate_no", "chosen").agg(F.count("*").alias("n"))


@query
def annotate_udf(spark, d):
    """Answers scored once per distinct text by a registered metric (UDF-01..05, STM-07)."""
    from loomdial.functions.registry import score_once

    f = _flat(spark, d, "completion")
    return score_once(f, "completion", "strip->question").groupBy("score").agg(F.count("*").alias("n"))


# --- summaries and small views


@query
def session_summaries(spark, d):
    from loomdial.operators.views import session_summary

    return clean.once(_sessions(spark, d).select("session_no", *[c.alias(k) for k, c in session_summary().items()]))


@query
def baseline_pairs(spark, d):
    """Recorded against generated teacher turns; the generated text here is a fixed stub on two of three turns."""
    from loomdial.operators.views import baseline_pairs as make

    s = clean.once(_sessions(spark, d).select("session_no", "dialogue"))
    stub = s.select("session_no", F.posexplode("dialogue").alias("turn_id", "t")).select("session_no", "turn_id", F.when(F.col("turn_id") % 3 > 0, "stub").alias("rejected"))
    return make(s, stub).select("session_no", "turn_id", canon.dialogue_digest(F.col("prompt")).alias("digest"), F.md5(F.col("chosen").cast("binary")).alias("chosen"), "margin")


@query
def row_titles(spark, d):
    from loomdial.operators.views import row_title, short

    return clean.once(_sessions(spark, d).select("session_no", short(row_title(F.col("dialogue")), 20).alias("title")))


@query
def latest_delivery(spark, d):
    from loomdial.operators.views import most_recent

    return most_recent(_sessions(spark, d).where("topic_id is not null"), "session_no", "ingested_at", ["topic_id"])
