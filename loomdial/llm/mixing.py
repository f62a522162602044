"""Mix sources to target weights by Poisson replication."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdial.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Sources are planned on the driver; the table of weights may have so many rows.
MAX_SOURCES = 100_000
#: Longer texts are tokenized in pieces of about so many characters, cut where no token can lie across.
PIECE = 200_000
_MARKS = "。！？，；：、.!?,;:"

# Fixed value: the splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that end with a mark before a letter: the splitting pattern never joins the two. Without such a place it stays whole."""
    at = 0
    while len(text) - at > PIECE:
        end = next((i for i in range(at + PIECE, len(text)) if text[i - 1] in _MARKS and text[i].isalpha()), len(text))
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a text; 0 for null and empty ones."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(tokenizer).encode_ordinary
        return pd.Series([sum(len(encode(x)) for x in pieces(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def _poisson(rate: float, cap: int) -> list[float]:
    """Probabilities of 0..cap-1; in logarithms, so that large rates do not vanish."""
    if rate <= 0:
        return [1.0] + [0.0] * (cap - 1) if cap else []
    log = math.log(rate)
    return [math.exp(k * log - rate - math.lgamma(k + 1)) for k in range(cap)]


def capped_mean(rate: float, cap: int) -> float:
    """Mean of min(Poisson(rate), cap)."""
    left, mean = 1.0, 0.0
    for p in _poisson(rate, cap):
        left -= p
        mean += max(left, 0.0)
    return mean


def poisson_steps(mean: float, cap: int) -> list[float]:
    """Cumulative probabilities of 0..cap-1 copies such that the capped count has this mean; all 0 (cap copies) where the mean is the cap."""
    if mean >= cap:
        return [0.0] * cap
    low, high = 0.0, 700.0
    while capped_mean(high, cap) < mean and high < 1e9:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if capped_mean(mid, cap) < mean else (low, mid)
    total, steps = 0.0, []
    for p in _poisson(high, cap):
        total += p
        steps.append(min(total, 1.0))
    return steps


class Mixture:
    """documents (id, source, text) combined so that each source gives weight_permille of the size of all listed sources.

    Rows with a null source or one not listed are left out; an id counts once for each row (ids are unique); texts that are null or empty
    have no tokens. A listed source without documents has 0 tokens. weights: source, weight_permille, max_repeats (null or below 1: 0).
    """

    def __init__(self, documents: DataFrame, weights: DataFrame, id_col: str = "doc_id", size: Column | None = None, seed: int = 23, tokenizer: str = TOKENIZER):
        spark = documents.sparkSession
        self.id_col = id_col
        rows = weights.select("source", "weight_permille", F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).where("source is not null").limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} weights")
        schema = "source string, weight_permille bigint, max_repeats bigint"
        listed = spark.createDataFrame([(r[0], int(r[1] or 0), max(0, int(r[2]))) for r in rows], schema)
        kept = documents.join(F.broadcast(listed.select("source")), "source", "left_semi")
        self.sized = cut(kept.select(id_col, "source", (token_count(F.col("text"), tokenizer) if size is None else size).alias("n_tokens")))
        tokens = {r[0]: r[1] for r in self.sized.groupBy("source").agg(F.sum("n_tokens")).collect()}  # at most as many as weights
        total, plan = sum(tokens.values()), []
        for r in listed.collect():
            own, target = tokens.get(r[0], 0), r[1] * total
            short = own * r[2] * 1000 < target
            mean = float(r[2]) if short else (target / 1000 / own if own else 0.0)
            plan.append((r[0], r[1], r[2], own, target / 1000, mean, bool(short), total, poisson_steps(mean, r[2])))
        self.plan = spark.createDataFrame(
            plan, "source string, weight_permille bigint, max_repeats bigint, source_tokens bigint, target_tokens double, mean_repeats double, short boolean, total_tokens bigint, steps array<double>"
        )
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) * F.lit(2.0**-53)
        counted = self.sized.join(F.broadcast(self.plan.select("source", "steps")), "source").withColumn("copies", F.size(F.filter("steps", lambda s: u >= s)))
        self.copies = counted.drop("steps")
        self.seed = seed

    def mixture(self) -> DataFrame:
        """One row per copy in a global random order: rows are ordered by mix_key within range partitions."""
        out = self.copies.where("copies > 0").select(self.id_col, "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy_no"))
        out = out.withColumn("mix_key", F.xxhash64(F.lit(self.seed + 1), self.id_col, "copy_no"))
        return out.repartitionByRange("mix_key").sortWithinPartitions("mix_key")

    def report(self) -> DataFrame:
        """Each listed source with its target, the tokens in the mixture, the share of all tokens of the mixture and whether it falls short: every document is in it as often as it may be, and yet the tokens are fewer than wanted."""
        got = self.copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"), F.min("copies").alias("least_copies"))
        all_tokens = got.agg(F.sum("mixed_tokens").alias("_all"))
        drawn_short = (F.coalesce("least_copies", F.col("max_repeats")) == F.col("max_repeats")) & (F.coalesce("mixed_tokens", F.lit(0)) * 1000 < F.col("weight_permille") * F.col("total_tokens"))
        return (
            self.plan.drop("steps")
            .join(F.broadcast(got), "source", "left")
            .join(F.broadcast(all_tokens))
            .select(
                "source", "weight_permille", "max_repeats", "source_tokens", "target_tokens", "mean_repeats", F.coalesce(drawn_short, F.lit(False)).alias("short"),
                F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
                F.coalesce(F.try_divide(F.col("mixed_tokens") * 1000.0, F.col("_all")), F.lit(0.0)).alias("reached_permille"),
            )
        )

    def shortfalls(self) -> DataFrame:
        """The sources that fall short in the mixture drawn."""
        return self.report().where("short").select("source")
