"""Map freely typed values to the closest entry of a reference list.

A trie holds every name of every entry (labels and aliases). A Levenshtein automaton, the row of edit distances
(adjacent transpositions count one) carried down the trie, returns all entries within a length-dependent distance;
subtrees whose best possible distance exceeds the limit are never entered. The search runs in Arrow batches on
the rows to be mapped, each distinct value of a task once, so there is no exchange and no join.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdial.functions.text import SIMPLIFIED, TRADITIONAL, strip
from loomdial.operators.packed import split_packed, strategy_values

#: Names searched at once. A longer list is searched in blocks of this many names, each broadcast on its own.
MAX_NAMES = 20_000

_SIMPLE = str.maketrans(TRADITIONAL, SIMPLIFIED)
_HAN = re.compile("[一-鿿]")

# Words that people put before or after a label without changing what it means.
BEFORE = ("主要是", "主要", "尝试", "进行", "采用", "使用", "运用了")
AFTER = ("为主", "课堂", "法", "等")


def normal(value: str) -> str:
    """One spelling: width, case, traditional characters, zero-width characters, underscores and repeated blanks."""
    v = unicodedata.normalize("NFKC", value).lower().translate(_SIMPLE).replace("_", " ")
    v = "".join(c for c in v if unicodedata.category(c) != "Cf")
    v = re.sub(r"\s+", " ", v).strip()
    return re.sub(r"(?<=[一-鿿]) | (?=[一-鿿])", "", v) if _HAN.search(v) else v


def forms(value: str) -> list[str]:
    """The spellings under which a value is looked up: as a whole, then without gloss, decoration and set phrases."""
    whole = normal(value)
    outside = re.sub(r"\([^()]*\)|\[[^\[\]]*\]|【[^【】]*】", " ", whole)
    inside = re.findall(r"[(\[【]([^()\[\]【】]*)[)\]】]", whole)
    found = [whole]
    for part in [outside, *inside, *re.split(r"[:：]|(?<=[一-鿿])-|-(?=[一-鿿])", outside)]:
        bare = re.sub(r"^[^\w]+|[^\w]+$", "", part)
        found += [bare, re.sub(r"(?<=[^\d\s])\d+$", "", bare)]
        if _HAN.search(bare):
            short = re.sub(r"\d+$", "", bare)
            for b in BEFORE:
                short = short.removeprefix(b)
            for a in AFTER:
                if len(short) - len(a) >= 2:
                    short = short.removesuffix(a)
            found.append(short)
    return [f for f in dict.fromkeys(found) if f]


def limit(length: int) -> int:
    """Edits allowed for a name of this many characters."""
    return 0 if length < 2 else 1 if length < 12 else 2


class Trie:
    """Entries by name; search() walks the automaton."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.root: dict = {}
        for name, entry in entries:
            node = self.root
            for c in name:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((entry, len(name)))

    def search(self, word: str) -> dict[int, int]:
        """entry -> distance, of all entries with a name within limit() of the word."""
        n, most, found = len(word), limit(len(word) + 2), {}
        stack = [(c, child, "", None, list(range(n + 1))) for c, child in self.root.items() if c]
        while stack:
            c, node, last, before, row = stack.pop()
            new = [row[0] + 1]
            for i in range(1, n + 1):
                d = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (word[i - 1] != c))
                if before is not None and i > 1 and word[i - 1] == last and word[i - 2] == c:
                    d = min(d, before[i - 2] + 1)
                new.append(d)
            for entry, length in node.get("", ()):
                if new[n] <= limit(min(length, n) if max(length, n) < 12 else max(length, n)):
                    found[entry] = min(found.get(entry, 99), new[n])
            if min(new) <= most or min(row) <= most:
                stack += [(x, child, c, row, new) for x, child in node.items() if x]
        return found


def lookup(tries: dict[str, Trie], field: str, value: str) -> tuple[int, int, bool]:
    """Distance, entry and whether several entries are equally close (then the entry is 0). Nothing found: (99, 0, False)."""
    trie = tries.get(field)
    if trie is None:
        return 99, 0, False
    best: tuple[int, set[int]] = (99, set())
    for form in forms(value):
        found = trie.search(form)
        if not found:
            continue
        least = min(found.values())
        if least < best[0]:
            best = (least, {e for e, d in found.items() if d == least})
        if least == 0:
            break
    return best[0], (next(iter(best[1])) if len(best[1]) == 1 else 0), len(best[1]) > 1


def map_to_entries(df: DataFrame, vocabulary: DataFrame, field: str, value: str) -> DataFrame:
    """Add vocab_id: the entry of the row's field that its value means, 0 for none or for several equally close.

    vocabulary has vocab_id, field_name, label_zh, label_en and aliases. A null value or an unknown field gives 0; an
    empty vocabulary gives 0 everywhere; a column vocab_id in the input is replaced.
    """
    names = vocabulary.select(
        "field_name", "vocab_id", F.explode(F.array_compact(F.concat(F.array("label_zh", "label_en"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name")
    ).where("field_name is not null and vocab_id is not null")
    blocks = -(-names.count() // MAX_NAMES)
    out = df.drop("vocab_id")
    parts = []
    for b in range(blocks):
        rows = names.where(F.pmod(F.xxhash64("field_name", "vocab_id"), F.lit(blocks)) == b).collect()
        by_field: dict[str, list] = {}
        for r in rows:
            by_field.setdefault(r["field_name"], []).append((normal(r["name"]), r["vocab_id"]))
        tries = {f: Trie(e) for f, e in by_field.items()}

        @F.pandas_udf("distance int, entry int, tie boolean")
        def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            # each distinct value of a task is searched once
            cached = lru_cache(100_000)(lambda a, b: (99, 0, False) if a is None or b is None else lookup(tries, a, b))
            for f, v in batches:
                yield pd.DataFrame([cached(a, b) for a, b in zip(f, v)], columns=["distance", "entry", "tie"])

        out = out.withColumn(f"_block{b}", search(F.col(field), F.col(value)))
        parts.append(F.col(f"_block{b}"))
    if not parts:
        return out.withColumn("vocab_id", F.lit(0))
    least = F.array_min(F.array(*[p["distance"] for p in parts]))
    closest = F.filter(F.array(*parts), lambda p: p["distance"] == least)
    entry = F.when((F.size(closest) == 1) & ~closest[0]["tie"] & (least < 99), closest[0]["entry"]).otherwise(0)
    return out.withColumn("vocab_id", entry).drop(*[f"_block{b}" for b in range(blocks)])


FIELDS = ("teacher_intent", "cognitive_level", "student_cognition_state")


def typed_values(sessions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """session_no, ann_no, field_name, pos, value of the values that are neither blank nor exactly a label_zh of their field.

    teaching_strategy is split first; the others stand whole at position 0. A session delivered again counts once.
    """
    a = sessions.select("session_no", F.posexplode("annotations").alias("ann_no", "a"))
    unquoted = lambda c: F.regexp_replace(strip(F.regexp_replace(strip(c), r"^[\"“”'‘’]+|[\"“”'‘’]+$", "")), r'""', '"')
    # labels of each field as a literal map: a reference list of labels, bounded by the check below
    labels = [(r[0], r[1]) for r in vocabulary.select("field_name", "label_zh").where("field_name is not null").distinct().limit(MAX_NAMES + 1).collect()]
    small = len(labels) <= MAX_NAMES
    is_label = lambda c, f: c.isin([x for g, x in labels if g == f]) if small and any(g == f for g, _ in labels) else F.lit(False)
    plain = (
        a.select("session_no", "ann_no", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), unquoted(F.col(f"a.{f}")).alias("value")) for f in FIELDS])).alias("x"))
        .select("session_no", "ann_no", "x.field_name", F.lit(0).alias("pos"), "x.value")
        .where("value <> ''")
    )
    exact = F.lit(False)
    for f in FIELDS:
        exact = exact | ((F.col("field_name") == f) & is_label(F.col("value"), f))
    plain = plain.where(~exact).dropDuplicates(["session_no", "ann_no", "field_name", "value"])
    strategies = split_packed(strategy_values(sessions), "teaching_strategy", "student").select(
        "session_no", "ann_no", F.lit("teaching_strategy").alias("field_name"), "pos", F.col("item_value").alias("value")
    )
    values = plain.unionByName(strategies.where(~is_label(F.col("value"), "teaching_strategy")))
    if not small:
        exact_rows = vocabulary.select("field_name", F.col("label_zh").alias("value")).distinct()
        values = values.join(exact_rows, ["field_name", "value"], "left_anti")
    return values


def canonical_values(sessions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """session_no, ann_no, field_name, pos, value, vocab_id of every value that is not already an exact label."""
    return map_to_entries(typed_values(sessions, vocabulary), vocabulary, "field_name", "value")


def unmatched_values(sessions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """field_name, value, n: the values that fit no entry, with how often they occur."""
    return canonical_values(sessions, vocabulary).where("vocab_id = 0").groupBy("field_name", "value").agg(F.count("*").alias("n"))
