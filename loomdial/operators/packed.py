"""Several values packed in one field: infer the delimiters of each source, split, explode with position.

Everything is built from regular expressions on Columns, so it runs in the JVM: one small aggregation
over the values infers the delimiters (its result is one row per source), a projection splits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdial.functions.text import HAN, id_key, strip
from loomdial.session import cut

# Candidate delimiters, by name, as the inside of a regular-expression character class.
CANDIDATES = {
    "comma": ",，",
    "enumeration_comma": "、",
    "semicolon": ";；",
    "slash": "/／",
    "bar": "|｜",
    "plus": "+＋",
    "ampersand": "&＆",
    "tab": "\\t",
    "newline": "\\n\\r",
    "wide_space": "\\u3000",
    "space": "\\uE001",
    "numbering": "\\uE002",
    "and_he": "和",
    "and_yu": "与",
    "and_yiji": "\\uE000",
    "hyphen": "\\-",
    "colon": ":：",
    "tilde": "~～",
}

# a doubled quotation mark within quotes ends one quoted part and begins the next
_QUOTED = r'"[^"]*+"|“[^”]*”|(?<=^|[\[,，;；\s])\'[^\']*\'(?=$|[\],，;；\s])'
_BRACKETED = r"（[^（）]*）|\([^()]*\)|【[^【】]*】"
_NUMBER = r"(?:[0-9]+[.、)）]|[(（][0-9]+[)）]|[①-⑳])"


def _mask(c: Column) -> Column:
    """Give multi-character separators a private character each: 以及, a space between two names, a space or nothing before numbering; hyphens within words are hidden."""
    c = F.regexp_replace(strip(c), r"^\[(.*)\]$", "$1")
    c = F.regexp_replace(c, "以及", "\ue000")
    c = F.regexp_replace(c, "(?<=[A-Za-z])-(?=[A-Za-z])", "\ue004")  # a hyphen within a word
    c = F.regexp_replace(c, rf"(?<=^|\s)([0-9]+)、(?=[{HAN}])", "$1.")
    c = F.regexp_replace(c, rf"(?<=\S)(?:[ ]+(?=[0-9]+[.)）]\s*[{HAN}A-Za-z])|(?=[①-⑳])|[ ]*(?=[(（][0-9]+[)）]))", "\ue002")
    c = F.regexp_replace(c, rf"(?<=[{HAN}])[ ]{{2,}}(?=[{HAN}])", "\ue001")
    return F.regexp_replace(c, rf"(?<=[{HAN}][{HAN}]|[{HAN}][)）】”\"]|^[{HAN}] [{HAN}])[ ](?=[{HAN}])", "\ue001")


def _unmask(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, "\ue000", "以及"), "\ue001\ue004", " -")


def _unit_pattern(char_class: str) -> str:
    """A run of quoted parts, bracketed parts and other characters that are no delimiter.

    A run ends at a delimiter anyway, so it is matched possessively: nothing is tried again, and the stack does not grow with the value.
    """
    return rf"(?:{_QUOTED}|{_BRACKETED}|[^{char_class}])++"


def _clean_pieces(pieces: Column) -> Column:
    """Without blanks, numbering and quotes; separators alone are dropped. In steps, so that no expression is repeated within another."""
    pieces = F.transform(pieces, lambda x: strip(_unmask(x)))
    pieces = F.transform(pieces, lambda x: strip(F.regexp_replace(x, rf"^{_NUMBER}\s*(?=\S)", "")))
    pieces = F.transform(
        pieces,
        lambda x: F.when(x.rlike(r'(?s)^".+"$'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"')))
        .when(x.rlike(r"(?s)^(?:“.*”|'.*')$"), F.substring(x, F.lit(2), F.length(x) - 2))
        .when(x == '"', F.lit(""))
        .otherwise(x),
    )
    return F.filter(F.transform(pieces, strip), _is_value)


def _is_value(piece: Column) -> Column:
    """Not empty and more than separators."""
    return piece.rlike(r"[^,，、;；/／|｜+＋&＆\s]")


@dataclass(frozen=True)
class PackedFieldRules:
    """How delimiters are inferred.

    A candidate's score in a source is the share of splits whose pieces are all of one type (Han or Latin writing, two
    characters or more) times the consistency of the piece count (mean / (mean + deviation)). It is accepted at min_score,
    if it splits at least min_support values. What all sources show counts as much as prior splits of the source's own,
    so that a source with few values is judged by all of them and one with many by itself.
    """

    min_score: float = 0.5
    min_support: float = 1
    prior: float = 5
    candidates: dict[str, str] = field(default_factory=lambda: dict(CANDIDATES))


def split_masked(masked: Column, char_class: str | Column) -> Column:
    """array<string> of the pieces of a masked value; the pieces are as written, without blanks, quotes and numbering."""
    pattern = F.lit(_unit_pattern(char_class)) if isinstance(char_class, str) else char_class
    return _clean_pieces(F.regexp_extract_all(masked, pattern, F.lit(0)))


def delimiter_statistics(df: DataFrame, value: str, source: str | None = None, rules: PackedFieldRules = PackedFieldRules()) -> DataFrame:
    """One row per source with packed values: for every candidate the values it splits (_n), those regularly (_regular), the sum (_sum) and sum of squares (_square) of their pieces."""
    key = F.col(source) if source else F.lit("all")
    packed = F.col("_value").rlike(f"[{''.join(rules.candidates.values())} 以①-⑳]|[(（][0-9]+[)）]")  # what _mask() makes a delimiter of, too
    distinct = df.select(key.alias("_source"), F.col(value).alias("_value")).where(packed).groupBy("_source", "_value").agg(F.count("*").alias("_w"))
    masked = distinct.select("_source", "_w", _mask(F.col("_value")).alias("_m"))
    whole = lambda x: ~x.rlike(r"^[,，、;；/／|｜]")  # noqa: E731  another delimiter right behind this one: this one ends a name
    kinds, checks, aggs = {}, {}, []
    # the kind of a piece: h Han, l Latin, e nothing but quotes and brackets, x anything else
    kind = lambda x: (
        F.when(x == "", "e")
        .when(~whole(x), "x")
        .when(x.rlike("[A-Za-z]"), F.when(~x.rlike(f"[{HAN}]") & x.rlike("[A-Za-z].*[A-Za-z]"), "l").otherwise("x"))
        .otherwise(F.when(x.rlike(rf"^[^{HAN}]?[{HAN}]?$"), "x").otherwise("h"))
    )
    for name, chars in rules.candidates.items():
        found = F.filter(F.transform(F.regexp_extract_all("_m", F.lit(_unit_pattern(chars)), F.lit(0)), strip), lambda x: x != "")
        bare = F.transform(found, lambda x: F.regexp_replace(x, rf"{_QUOTED}|[（(].*|^{_NUMBER}", ""))
        kinds[f"{name}_kinds"] = F.when(F.col("_m").rlike(f"[{chars}]"), F.array_join(F.transform(bare, kind), ""))
        checks[f"{name}_count"] = F.expr(f"if(length({name}_kinds) >= 2, length({name}_kinds), null)")
        checks[f"{name}_ok"] = F.expr(f"length({name}_kinds) >= 2 and {name}_kinds rlike '^([he]+|[le]+)$'")
        n = f"{name}_count"
        aggs += [F.expr(x) for x in (
            f"coalesce(sum(if({n} is not null, _w, 0)), 0) as {name}_n", f"coalesce(sum(if({name}_ok, _w, 0)), 0) as {name}_regular",
            f"coalesce(sum({n} * _w), 0) as {name}_sum", f"coalesce(sum(double({n}) * {n} * _w), 0d) as {name}_square",
        )]
    masked = masked.withColumns(kinds).withColumns(checks).drop(*kinds, "_m")
    return masked.groupBy("_source").agg(*aggs)


def _score(name: str, pooled: dict, rules: PackedFieldRules) -> str:
    """SQL of a candidate's score in each source, with the pooled statistics as prior splits; null where nothing is split."""
    share = rules.prior / pooled[f"{name}_n"]
    n, regular, total, square = [f"({name}_{x} + {float(pooled[f'{name}_{x}']) * share!r}D)" for x in ("n", "regular", "sum", "square")]
    return f"try_divide({regular} * {total}, {n} * ({total} + sqrt(greatest(0D, {square} * {n} - {total} * {total}))))"


def _inferred(df: DataFrame, value: str, source: str | None, rules: PackedFieldRules) -> tuple[DataFrame, str]:
    """infer_delimiters() and the class for a source that has no row in it: what all sources together show."""
    stats = cut(delimiter_statistics(df, value, source, rules))
    pooled = stats.agg(*[F.expr(f"coalesce(sum({c}), 0) as {c}") for c in stats.columns[1:]]).first().asDict()
    names = [name for name in rules.candidates if pooled[f"{name}_n"] >= max(1, rules.min_support)]
    good = [f"if({_score(name, pooled, rules)} >= {rules.min_score}, '{name}', null)" for name in names]
    shown = [f"if({name}_n > 0, '{name}', null)" for name in names]
    classes = F.create_map(*[F.lit(x) for kv in rules.candidates.items() for x in kv])
    judged = stats.selectExpr("_source as source", f"array_compact(cast(array({', '.join(good)}) as array<string>)) as _good", f"array_compact(cast(array({', '.join(shown)}) as array<string>)) as _shown")
    found = judged.select("source", F.array_intersect("_good", "_shown").alias("accepted"), F.array_join(F.transform("_good", lambda x: classes[x]), "").alias("char_class"))
    usual = ""
    for name in names:
        n, total = pooled[f"{name}_n"], pooled[f"{name}_sum"]
        deviation = math.sqrt(max(0.0, pooled[f"{name}_square"] * n - total * total))  # times n, as the sum is the mean times n
        if pooled[f"{name}_regular"] * total / (n * (total + deviation)) >= rules.min_score:
            usual += rules.candidates[name]
    return found, usual


def infer_delimiters(df: DataFrame, value: str, source: str | None = None, rules: PackedFieldRules = PackedFieldRules()) -> DataFrame:
    """One row per source: source, accepted (the candidates that its own values show), char_class (what it is split at, those that only other sources show too).

    A source whose values hold no candidate has no row.
    """
    return _inferred(df, value, source, rules)[0]


#: A table of the sources that differ from the rest is sent to every task only up to this many; beyond it is joined by shuffle.
MAX_BROADCAST_SOURCES = 20_000
_NOTHING = "\\uE003"


def split_packed(df: DataFrame, value: str, source: str | None = None, rules: PackedFieldRules = PackedFieldRules(), min_values: int = 1) -> DataFrame:
    """Add n_values and one row per value with pos (from 0) and item_value.

    Separators within quotes or brackets belong to the value; the delimiters are those inferred for the row's source (a null
    source is one of its own). Most sources accept the same delimiters, so only those that differ from the whole are joined.
    A null or blank value gives no row; a value with no delimiter one row at position 0; a column named pos,
    item_value or n_values in the input is replaced. min_values=2 keeps packed values only.
    """
    out = [c for c in df.columns if c not in ("pos", "item_value", "n_values")]
    df = df.select(*out)
    found, usual = _inferred(df, value, source, rules)
    usual = usual or _NOTHING
    plain = F.array(F.regexp_replace(strip(F.col(value)), r"^\[(.*)\]$", "$1"))
    split = lambda chars: F.when(F.col("_m").rlike(f"[{chars}]"), split_masked(F.col("_m"), chars)).otherwise(_clean_pieces(plain))
    masked = df.withColumn("_m", _mask(F.col(value)))
    others = found.select(F.col("source").alias("_source"), F.when(F.col("char_class") == "", _NOTHING).otherwise(F.col("char_class")).alias("_class")).where(F.col("_class") != usual)
    n_others = others.limit(MAX_BROADCAST_SOURCES + 1).count() if source else 0
    if n_others:
        masked = masked.join(F.broadcast(others) if n_others <= MAX_BROADCAST_SOURCES else others, F.col(source).eqNullSafe(F.col("_source")), "left")
        own = F.concat(F.lit(_unit_pattern("\0").split("\0")[0]), F.col("_class"), F.lit(_unit_pattern("\0").split("\0")[1]))
        pieces = F.when(F.col("_class").isNull(), split(usual)).otherwise(split_masked(F.col("_m"), own))
    else:
        pieces = split(usual)
    return (
        masked.withColumn("_pieces", pieces)
        .withColumn("n_values", F.size("_pieces"))
        .where(F.col("n_values") >= min_values)
        .select(*out, "n_values", F.posexplode("_pieces").alias("pos", "item_value"))
    )


def strategy_values(sessions: DataFrame) -> DataFrame:
    """session_no, ann_no, student, teaching_strategy of the non-blank strategies; a session delivered again counts once.

    student, the key of student_id (null where blank or where there is no such column), is the source of the values. Only the narrow columns are exchanged, not the annotations.
    """
    student = id_key(F.col("student_id")) if "student_id" in sessions.columns else F.lit(None).cast("string")
    return (
        sessions.select("session_no", student.alias("student"), F.posexplode(F.col("annotations.teaching_strategy")).alias("ann_no", "teaching_strategy"))
        .where(F.col("teaching_strategy").rlike(r"(?U)\S"))
        .dropDuplicates(["session_no", "ann_no", "teaching_strategy"])
    )
