"""Canonical forms of labels, hashes, codecs and display strings, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword patterns per class, tried in this order on lower-case text.
BLOOM_PATTERNS = (
    (6, "创造|生成|create|generate"),
    (5, "评价|评估|evaluate"),
    (4, "分析|分解|analyze|synthesis"),
    (3, "应用|apply|practice"),
    (2, "理解|understand|explain|interpret"),
    (1, "记忆|记住|remember|recall|identify"),
)
INTENT_PATTERNS = (
    ("introduce", "引入|引出|介绍|introduce|present|initiate|开始"),
    ("check_understanding", "检测|检查|理解|核实|understand|verify|check|assess"),
    ("guide_reasoning", "引导|推理|推导|思考|guide|reason|deduce|infer|analyze"),
    ("summarize_enhance", "总结|汇总|提升|归纳|consolidate|summarize|enhance|conclude"),
)
STRATEGY_PATTERNS = (
    ("invalid_echo", "无效复读|复读|echo|parrot|repeat"),
    ("scenario_questioning", "情境|场景|scenario|context|situate"),
    ("follow_up_questioning", "追问|续问|follow.?up|extend|further|probe"),
    ("analogies", "类比|比喻|analogies?|metaphor|simile"),
    ("hints", "提示|暗示|启发|hints?|cue|clue|suggestion"),
    ("break_down", "拆解|分解|拆分|break.?down|decompose|simplify"),
    ("encourage_responses", "鼓励|激励|正向|encourage|praise|affirm|respond"),
    ("corrective_feedback", "纠正|正误|反馈|纠|corrective?|feedback|error|wrong|incorrect"),
    ("reasoning_guidance", "引导|引发|迁移|思考|导向|guide|reason|transfer|think|infer"),
)
BLOOM_EXACT = {"记忆": 1, "理解": 2, "应用": 3, "分析": 4, "评价": 5, "创造": 6}
TRUTHY = ("是", "yes", "true", "1")
TEACHER_ROLES = ("教师", "teacher", "assistant")
STUDENT_ROLES = ("学生", "student", "user")


def py_strip(c: Column) -> Column:
    """Trim Unicode white space, but not zero-width characters."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _first_match(c: Column, patterns, default) -> Column:
    text = F.lower(c)
    case = None
    for value, pattern in patterns:
        case = F.when(text.rlike(pattern), value) if case is None else case.when(text.rlike(pattern), value)
    return case if default is None else case.otherwise(default)


def bloom_level(c: Column) -> Column:
    """1 to 6, 0 for null, blank and unknown."""
    return F.coalesce(_first_match(c, BLOOM_PATTERNS, 0), F.lit(0))


def canonical_intent(c: Column) -> Column:
    return _first_match(c, INTENT_PATTERNS, None)


def canonical_strategy(c: Column) -> Column:
    return _first_match(c, STRATEGY_PATTERNS, None)


def comma_items(c: Column) -> Column:
    """Items between commas of either width, trimmed, blanks dropped; null gives an empty array."""
    return F.filter(F.transform(F.split(F.translate(F.coalesce(c, F.lit("")), "，", ","), ","), py_strip), lambda x: x != "")


def is_truthy(c: Column) -> Column:
    return F.coalesce(F.lower(py_strip(c)).isin(*TRUTHY), F.lit(False))


def is_teacher(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin(*TEACHER_ROLES), F.lit(False))


def is_student(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin(*STUDENT_ROLES), F.lit(False))


def chat_role(c: Column) -> Column:
    """user or assistant; unknown and null roles are user."""
    return F.when(is_teacher(c), "assistant").otherwise("user")


def utterance_key(c: Column) -> Column:
    """Han characters, letters and digits only, case kept; null gives ''."""
    return F.coalesce(F.regexp_replace(c, "[^一-龥a-zA-Z0-9]", ""), F.lit(""))


def json_string(c: Column) -> Column:
    """A JSON string literal with non-ASCII characters kept."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))


def messages_hash(messages: Column, length: int = 8) -> Column:
    """Start of the md5 of the messages as JSON with sorted keys and ', ' and ': ' between."""
    one = lambda m: F.concat(F.lit('{"content": '), F.coalesce(json_string(m["content"]), F.lit("null")), F.lit(', "role": '), F.coalesce(json_string(m["role"]), F.lit("null")), F.lit("}"))
    return F.substring(F.md5(F.concat(F.lit("["), F.array_join(F.transform(messages, one), ", "), F.lit("]")).cast("binary")), 1, length)


def dialogue_digest(messages: Column) -> Column:
    """md5 of role:content joined by ||."""
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["content"], F.lit("")))), "||").cast("binary"))


def rolling_hash(c: Column) -> Column:
    """Absolute value of the 31-polynomial hash of the UTF-16 units in 32 bits, in base 36."""
    code = lambda x: F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("bigint")  # noqa: E731  two units beyond the basic plane
    step = lambda acc, x: F.when(code(x) < 65536, (acc * 31 + code(x)) % 4294967296).otherwise(
        ((acc * 31 + F.shiftright(code(x), 16)) * 31 + code(x) % 65536) % 4294967296
    )
    unsigned = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("bigint"), step)
    return F.lower(F.conv(F.abs(F.when(unsigned >= 2147483648, unsigned - 4294967296).otherwise(unsigned)).cast("string"), 10, 36))


def encode_name(c: Column) -> Column:
    """URL-safe base64 of a file name."""
    return F.translate(F.base64(c.cast("binary")), "+/\n\r", "-_")


def decode_name(c: Column) -> Column:
    return F.unbase64(F.translate(c, "-_", "+/")).cast("string")


def request_id(name: Column, dialogue: Column, pair: Column) -> Column:
    return F.concat(F.lit("req-"), encode_name(name), F.lit("-"), dialogue.cast("string"), F.lit("-"), pair.cast("string"))


REQUEST_ID = r"^req-(.+)-([0-9]+)-([0-9]+)$"


def parse_request_id(c: Column) -> Column:
    """struct(name, dialogue, pair); anchored at the end, so that names whose code holds '-' survive. Not an id: null."""
    part = lambda i: F.regexp_extract(c, REQUEST_ID, i)
    return F.when(c.rlike(REQUEST_ID), F.struct(decode_name(part(1)).alias("name"), part(2).cast("int").alias("dialogue"), part(3).cast("int").alias("pair")))


def strip_state_label(c: Column) -> Column:
    """Without a leading label like （2）... and its line."""
    return py_strip(F.regexp_replace(c, "^（[0-9]+）[^\n]*\n", ""))


def percent(c: Column) -> Column:
    return F.format_string("%.2f%%", c * 100)


def score_from_display(c: Column) -> Column:
    """'35.00%' -> 0.35, '0.7' -> 0.7, blank or no number -> 0."""
    t = F.trim(c)
    bare = F.regexp_extract(t, r"^[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0)
    value = F.when(bare != "", bare).cast("double")
    return F.coalesce(F.when(t.endswith("%"), value / 100).otherwise(value), F.lit(0.0))


def normal_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+", "")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(normal_path(c), "/"), -1)


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 2_000_000_000)).otherwise(c)


def model_name(c: Column) -> Column:
    """G010 -> g10; dpo5 -> dpo_5; others trimmed."""
    t = F.trim(c)
    number = F.regexp_extract(t, r"^[gG]0*([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("g"), number)).otherwise(F.regexp_replace(t, r"^dpo(?=[0-9])", "dpo_"))


def is_ablation(c: Column) -> Column:
    return model_name(c).rlike("^[gG](?:[1-9]|1[01])$")


def is_junk_path(c: Column) -> Column:
    n = normal_path(c)
    return (n == "") | n.endswith("/") | n.contains(":Zone.Identifier") | F.arrays_overlap(F.split(n, "/"), F.array(F.lit("__MACOSX"), F.lit(".DS_Store")))


def clean_url(c: Column) -> Column:
    """Base of a chat endpoint; blank: null."""
    return F.nullif(F.rtrim(F.split(py_strip(c), "/chat/completions", 2)[0], F.lit("/")), F.lit(""))


def parse_flag(c: Column) -> Column:
    """true or false; other words: null."""
    t = F.lower(py_strip(c))
    return F.when(t.isin("1", "y", "yes", "true", "on"), True).when(t.isin("0", "n", "no", "false", "off"), False)


def toggle_item(c: Column, item: str) -> Column:
    """Remove an item from a comma list or add it at the end."""
    items = comma_items(c)
    return F.array_join(F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, F.lit(item))), ",")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


MARKER = "[结束]"


def is_finished(c: Column, marker: str = MARKER) -> Column:
    return F.coalesce(c.contains(marker), F.lit(False))


def display_text(c: Column, marker: str = MARKER, fallback: str = "（对话已结束）") -> Column:
    """Without the completion marker; the fallback where nothing is left."""
    return F.coalesce(F.nullif(py_strip(F.replace(c, F.lit(marker), F.lit(""))), F.lit("")), F.lit(fallback))
