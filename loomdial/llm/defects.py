"""Defects of prompt and response pairs: ordered rules over Columns, one pass, nothing exchanged but the defects found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdial.functions.text import HAN, half_width

#: The order of the rules; where a single type is asked for, the first that holds counts.
ORDER = ("empty", "refusal", "copied_question", "other_language", "truncated")

# Texts that stand for no answer (lower case, half width, without blanks and marks).
NO_ANSWER = ("na", "none", "null", "nil", "nan", "br", "br/", "空", "无", "结束", "教师", "老师", "助教", "teacher", "assistant", "tutor", "todo", "tbd", "待补", "end")

# Phrases by which an answer declines, as regular expressions, by language.
REFUSALS_ZH = (
    r"无法(?:处理|继续|回答|提供|协助|满足|讨论|就)",
    r"(?:没法|没办法)(?:回答|讨论|继续|提供)",
    r"没有办法就.{1,40}(?:回应|回答|评论)",
    r"(?:我|恕我?)不(?:便|能|想|会|宜)(?:讨论|继续|回答|评论|谈|透露|协助|对.{1,40}发表)",
    r"不便(?:讨论|回答|评论|透露)",
    r"(?:选择|这个我|恕)不(?:予)?(?:回答|作答|回应)",
    r"恕难从命|无可奉告|爱莫能助",
    r"拒绝(?:提供|回答|讨论)",
    r"不予(?:解答|回答|回应|讨论)",
    r"不能谈的",
    r"超出了?我(?:能谈|可以谈|能回答|可讨论)?的?(?:服务|能力|职责|权限|讨论)?(?:的)?范围",
    r"帮不了你|做不到，|这个要求我做不到",
    r"不具备(?:讨论|判断|评价|回答).{0,40}(?:能力|资格)",
    r"系统设定不允许|不允许我(?:往下说|回答|讨论)",
    r"(?:设计|设定)成不(?:碰|谈|讨论|回答)",
    r"不在可(?:讨论|回答)之列|不在讨论范围",
    r"不适合(?:评论|讨论|回答)这",
)
REFUSALS_EN = (
    r"(?:unable|not able) to (?:discuss|help|answer|assist|provide|continue|respond|talk|go into|comment|engage)",
    r"(?:can[’']?t|cannot|can not|won[’']?t|will not|could not|may not) (?:help|assist|answer|discuss|provide|continue|respond|comment|talk|go into|engage|speak)",
    r"(?:must|have to|need to|will) (?:decline|refuse|pass on)|(?:decline|refuse) to (?:talk|answer|discuss|say|help)",
    r"guidelines (?:rule out|forbid|prohibit|do not)|policy (?:rules out|forbids|prohibits)",
    r"no answer can be given|(?:outside|beyond)(?: of)? what i(?: am|[’']m) (?:allowed|permitted|able)|not (?:something|a topic) i can|am not (?:allowed|permitted|qualified) to",
    r"designed not to|not in a position to",
)
REFUSALS_LATIN = (
    r"no puedo (?:ayudar|responder|hablar|contestar)|lo siento, (?:pero )?no",
    r"je ne (?:peux|suis) pas (?:répondre|aider|en mesure|autorisé)|je refuse",
    r"(?:kann|darf) ich (?:leider )?nicht|ich kann (?:dir |ihnen )?(?:dabei |das )?nicht (?:helfen|beantworten)",
)
REFUSALS_SCRIPTS = (
    r"お答え(?:できません|しかねます)|対応できません|回答できません",
    r"(?:답변|도와)[^.]{0,10}(?:없습니다|어렵습니다|수 없)",
    r"не могу (?:ответить|помочь|обсуждать)",
)
REFUSALS_OTHER = REFUSALS_LATIN + REFUSALS_SCRIPTS

# Frequent words by which Latin-script languages are told apart.
WORDS_EN = "the a an is are was of to you your what and in how would which does this it that one if who why with we i my let about from not at"
WORDS_FOREIGN = (
    "el la los las una uno que pero se es en por para con del más qué crees cambia mira intenta mantener "
    "le les une des est pas tu du et dans pour avec cette ce de regarde essaie garder seule pourquoi "
    "der die das und ist nicht eine einen nur bitte dir dass zu mit warum schau sich ändert ein diesmal fest o os um uma não il che di per"
)

# How a question names the language it wants.
ASKS = {
    "en": r"用英[语文]|译成英[语文]|翻译成英[语文]|英文回答|(?i)\bin english\b|into english",
    "zh": r"用(?:中文|汉语|普通话)|译成(?:中文|汉语)|中文回答|(?i)\bin (?:chinese|mandarin)\b|into chinese",
    "ja": r"用日[语文]|译成日[语文]|(?i)\bin(?:to)? japanese\b",
    "ko": r"用韩[语文]|译成韩[语文]|(?i)\bin(?:to)? korean\b",
    "ru": r"用俄[语文]|译成俄[语文]|(?i)\bin(?:to)? russian\b",
    "latin": r"用(?:法|德|西班牙|意大利|葡萄牙)[语文]|译成(?:法|德|西班牙|意大利|葡萄牙)[语文]|(?i)\bin(?:to)? (?:french|german|spanish|italian|portuguese)\b",
}


#: What every alternative of a list of phrases holds, whatever it is: tests that let the other texts pass by at less cost.
NEEDS_ZH, NEEDS_LATIN, NEEDS_OTHER = "[无没不恕爱拒超]", "[a-z’'] [a-z]", "[\u3040-\u30FF\uAC00-\uD7A3\u0400-\u04FF]"
#: What the alternatives of REFUSALS_ZH begin with.
BEGINS_ZH = "[无没我恕不选这爱拒超帮做系设]"


def _count(c: Column, chars: str) -> Column:
    """Characters of a class, found by runs."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]+", ""))


def language_columns(df: DataFrame, col: str, to: str) -> DataFrame:
    """Add the language of a text: zh, en, ja, ko, ru, latin (another language in Latin script), other, or null where there are no letters.

    The counts are columns of their own, so that each is taken once; words are only looked at in texts of Latin script.
    """
    c, rest = F.col(col), F.col("_rest")
    df = df.withColumn("_rest", F.regexp_replace(c, f"[{HAN}]+", ""))  # short for a Chinese text, so that the other counts are cheap
    df = df.withColumns(
        {
            "_han": F.length(c) - F.length(rest),
            "_ascii": F.octet_length(rest) == F.length(rest),
            "_strange": (F.octet_length(rest) > F.length(rest)) & rest.rlike(r"[^\x00-ɏ\u2000-\u206F\u3000-\u303F\u4E00-\u9FA5\uFF00-\uFFEF]"),
        }
    )
    # without Han and strange letters it only counts whether there are three Latin ones
    three = F.when(rest.rlike("[A-Za-zÀ-ɏ][^A-Za-zÀ-ɏ]*+[A-Za-zÀ-ɏ][^A-Za-zÀ-ɏ]*+[A-Za-zÀ-ɏ]"), 3).otherwise(0)
    df = df.withColumn("_latin", F.when((F.col("_han") == 0) & ~F.col("_strange"), three).otherwise(_count(rest, "A-Za-zÀ-ɏ")))
    mostly_han = (F.col("_han") > 0) & (F.col("_han") * 4 >= F.col("_latin"))
    df = df.withColumn("_words", F.when(~mostly_han & (F.col("_latin") > 2), F.array_distinct(F.split(F.lower(c), r"[^\p{L}]+"))))
    among = lambda ws: F.size(F.filter("_words", lambda w: w.isin(*dict.fromkeys(ws.split()))))
    foreign = among(WORDS_FOREIGN) + F.when(F.col("_ascii"), 0).otherwise(2 * _count(c, "áéíóúñ¿¡çàèùâêîôûäöüßœÁÉÍÓÚÑÇÀÈÄÖÜ"))
    latin = F.when(foreign > among(WORDS_EN), "latin").otherwise("en")
    letters = F.col("_han") + F.col("_latin")
    kana, hangul, cyrillic = _count(c, "\u3040-\u30FF"), _count(c, "\uAC00-\uD7A3"), _count(c, "\u0400-\u04FF")
    strange = (
        F.when((kana > 0) & (kana * 8 >= letters), "ja").when((hangul > 0) & (hangul * 4 >= letters), "ko").when((cyrillic > 0) & (cyrillic * 2 >= letters), "ru")
    )
    plain = F.when(mostly_han, "zh").when(F.col("_latin") > 2, latin)
    other = F.when(F.length(F.regexp_replace(c, r"[^\p{L}]+", "")) > 2, "other")
    found = F.when(F.col("_strange"), F.coalesce(strange, plain, other)).otherwise(plain)
    return df.withColumn(to, found).drop("_rest", "_han", "_latin", "_strange", "_words", "_ascii")


def _key(c: Column) -> Column:
    """What is left for comparing: letters and digits, half width, lower case, 我 and 你 alike."""
    bare = F.translate(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), "你您", "我我")
    return F.when(c.rlike("[Ａ-Ｚａ-ｚ０-９]"), F.lower(half_width(bare))).otherwise(bare)


def is_empty(a: Column, key: Column) -> Column:
    """key: the _key() of the answer. Null, no letter or digit, or a word that stands for no answer."""
    return a.isNull() | (key == "") | key.isin(*NO_ANSWER)


def is_refusal(text: Column) -> Column:
    """text: the answer in lower case."""
    return (
        (text.rlike(NEEDS_ZH) & text.rlike(f"(?={BEGINS_ZH})(?:{'|'.join(REFUSALS_ZH)})"))
        | (text.rlike(NEEDS_LATIN) & text.rlike("|".join(REFUSALS_EN + REFUSALS_LATIN)))
        | (text.rlike(NEEDS_OTHER) & text.rlike("|".join(REFUSALS_SCRIPTS)))
    )


def _is_copy(df: DataFrame, q: str, a: str) -> DataFrame:
    """Add _copy: the answer is the question, once or several times, behind a lead-in or not, up to a fifth of its characters changed.

    _kq and _ka are the keys of the two. A lead-in is the beginning up to a colon, within one sentence. The rule is the same for texts of any
    length; a question has four letters or digits at least.
    """
    lead = F.regexp_extract(F.col(a), r"^[^：:。！？!?；;\n]++[：:]", 0)
    df = df.withColumns({"_n": F.length("_kq"), "_m": F.length("_ka"), "_lead": F.when(F.col(a).contains("：") | F.col(a).contains(":"), F.length(_key(lead))).otherwise(0)})
    n = F.col("_n")

    def near(x: Column, length: Column, times: Column) -> Column:
        most = F.ceil(n * times * 0.22).cast("int")
        return (F.abs(length - n * times) <= most) & (F.call_function("levenshtein", F.repeat("_kq", times), x, most) >= 0)  # a band of the table only

    def copied(x: Column, length: Column) -> Column:
        """Once is the common case; other counts of repetitions are tried where a cheap bound allows: a character that the question has not is an edit."""
        once = F.when(F.abs(length - n) <= F.ceil(n * 0.22), (F.col("_kq") == x) | near(x, length, F.lit(1))).otherwise(False)
        low, high = F.greatest(F.lit(2), F.floor(length / (n * 1.22)).cast("int")), F.ceil(length / (n * 0.78)).cast("int")
        strange = F.length(F.call_function("translate", x, F.col("_kq"), F.lit("")))
        # each edit changes one of the blocks of three characters at most; the others stand in the question, or where it meets itself
        blocks = F.regexp_extract_all(x, F.lit("..."), F.lit(0))
        known = F.size(F.filter(blocks, lambda w: F.contains(F.repeat("_kq", F.lit(2)), w)))
        often = F.exists(F.sequence(low, high), lambda t: near(x, length, t))
        edits = F.ceil(n * high * 0.22)
        often = F.when(F.floor(length / 3) - known <= edits, often).otherwise(False)
        return once | F.when((length > n * 1.22) & (strange <= edits), often).otherwise(False)

    behind = F.when(F.col("_lead") > 0, copied(F.expr("substring(_ka, _lead + 1)"), F.col("_m") - F.col("_lead"))).otherwise(False)
    copy = F.when(n >= 4, copied(F.col("_ka"), F.col("_m")) | behind).otherwise(False)
    return df.withColumn("_copy", F.coalesce(copy, F.lit(False))).drop("_n", "_m", "_lead")


_MARKS, _CLOSERS, _PARTICLES = "。！？!?；;～~", "”’\"'）)》」】]*", "吗呢吧啊呀嘛哦"


def _end(a: Column) -> Column:
    """The answer without blanks, an end marker in brackets, a closing tag or a gloss behind the sentence end."""
    bare = lambda x: F.rtrim(x, F.lit(" \t\n\r\x0b\x0c\xa0\u2028\u2029\u3000\u200b\u200c\u200d\u2060\ufeff"))
    end = bare(a)
    unmarked = bare(F.regexp_replace(end, r"(?:[\[【](?:结束|END|end)[\]】]|</?[a-z]+ ?/?>)$", ""))
    without_gloss = bare(F.regexp_replace(end, r"[（(][^（()）]*+[）)]$", ""))
    last = F.right(end, F.lit(1))
    closed = F.when(last.isin(")", "）"), F.when(F.right(without_gloss, F.lit(1)).isin(*"。！？!?."), without_gloss).otherwise(end)).otherwise(unmarked)
    return F.when(last.isin("]", "】", ">", ")", "）"), closed).otherwise(end)


def is_truncated(a: Column, t: Column) -> Column:
    """a: the answer, t: its _end(). No sentence end, a colon, comma or dots at the end, or a bracket or quotation mark left open.

    A Chinese answer that ends in a question particle is complete without its mark; an end marker in brackets or a gloss behind the end does not count.
    """
    n = lambda p: F.length(F.replace(a, F.lit(p), F.lit("")))  # noqa: E731  the more of p, the shorter
    marked = reduce(lambda x, y: x | y, [a.contains(m) for m in "（(“《「"])
    open_mark = F.when(marked, (n("（") + n("(") < n("）") + n(")")) | (n("“") < n("”")) | (n("《") < n("》")) | (n("「") < n("」"))).otherwise(False)
    ends = F.right(F.rtrim(t, F.lit(_CLOSERS)), F.lit(2))
    complete = F.right(ends, F.lit(1)).isin(*_MARKS) | ends.rlike(r"^[^.…]\.$") | F.right(t, F.lit(1)).isin(*_PARTICLES)
    return (t != "") & (open_mark | ~complete)


def with_question(df: DataFrame, question: str = "q") -> DataFrame:
    """Add what the rules need to know of the question: _kq, its key, and _lq, its language."""
    return language_columns(df.withColumn("_kq", _key(F.col(question))), question, "_lq")


def with_defects(df: DataFrame, question: str = "q", answer: str = "a") -> DataFrame:
    """Add defects: array<string> of every defect that the answer shows, in the order of the rules.

    A null question is compared with nothing: only emptiness, refusal and truncation are found. An empty answer shows nothing else.
    """
    if "_kq" not in df.columns:
        df = with_question(df, question)
    df = df.withColumns({"_ka": _key(F.col(answer)), "_low": F.lower(F.col(answer)), "_end": _end(F.col(answer))})
    df = df.withColumn("_empty", is_empty(F.col(answer), F.col("_ka")))
    df = _is_copy(language_columns(df, answer, "_la"), question, answer)
    q = F.col(question)
    asked = reduce(lambda x, y: x | y, [(F.col("_la") == code) & q.rlike(p) for code, p in ASKS.items()])
    other = F.when(F.col("_lq") != F.col("_la"), ~asked).otherwise(False)
    full = ~F.col("_empty")
    found = [
        F.when(F.col("_empty"), "empty"),
        F.when(full & is_refusal(F.col("_low")), "refusal"),
        F.when(full & F.col("_copy"), "copied_question"),
        F.when(full & F.coalesce(other, F.lit(False)), "other_language"),
        F.when(full & is_truncated(F.col(answer), F.col("_end")), "truncated"),
    ]
    return df.withColumn("defects", F.array_compact(F.array(*found))).drop("_empty", "_low", "_end", "_lq", "_la", "_copy", "_kq", "_ka")


def last_question(prompt: Column) -> Column:
    """Content of the last user message; null where there is none."""
    users = F.filter(prompt, lambda m: F.lower(F.trim(m["role"])).isin("user", "student", "human", "学生"))
    return F.try_element_at(users, F.lit(-1))["content"]


def answer_defects(flat_rows: DataFrame, dpo_pairs: DataFrame) -> DataFrame:
    """table_name, row_no, field_name, defects (all, ordered) of every defective answer; a row delivered again counts once."""
    f = flat_rows.select(F.lit("flat_rows").alias("table_name"), "row_no", F.lit("completion").alias("field_name"), last_question(F.col("prompt")).alias("q"), F.col("completion").alias("a"))
    # the question of a pair is looked at once, before its two answers are taken apart
    d = with_question(dpo_pairs.select(F.col("pair_no").alias("row_no"), "chosen", "rejected", last_question(F.col("prompt")).alias("q")))
    d = d.select(
        F.lit("dpo_pairs").alias("table_name"), "row_no", "q", "_kq", "_lq", F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("a")) for c in ("chosen", "rejected")])).alias("x")
    ).select("table_name", "row_no", "x.field_name", "q", "x.a", "_kq", "_lq")
    found = with_defects(with_question(f).unionByName(d)).select("table_name", "row_no", "field_name", "defects", F.monotonically_increasing_id().alias("_place"))
    # _place keeps the filter above the projection; pushed down, it would have every rule evaluated twice
    return found.where("size(defects) > 0 and _place >= 0").drop("_place").dropDuplicates(["table_name", "row_no", "field_name"])
