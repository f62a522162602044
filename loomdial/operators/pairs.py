"""Fine-tuning, preference and input layouts from flat rows; exact splits without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_rows(flat: DataFrame, order: str = "row_no", carry: tuple[str, ...] = ("prompt", "completion", "score")) -> DataFrame:
    """Per conversation the row of the highest turn, then score; the first in order wins a tie. A partial aggregate, so a hot conversation does not gather."""
    rank = F.struct("turn_id", F.coalesce("score", F.lit(float("-inf"))).alias("s"), (-F.col(order)).alias("o"))
    return flat.groupBy("conv_id").agg(F.max_by(F.struct(order, "turn_id", *carry), rank).alias("r")).select("conv_id", "r.*")


def to_sft(flat: DataFrame, lower_bound_metric: str | None = None, lower_bound: float = 0.0) -> DataFrame:
    """Messages of the best row of each conversation, with the answer added; the metric is a column or a dotted path, null drops the row."""
    extra = (lower_bound_metric.split(".")[0],) if lower_bound_metric else ()
    best = best_rows(flat, carry=tuple(dict.fromkeys(("prompt", "completion", "score", *extra))))
    if lower_bound_metric:
        best = best.where(F.col(lower_bound_metric) >= lower_bound)
    answer = F.array(F.struct(F.lit("assistant").alias("role"), F.col("completion").alias("content")))
    return best.select("conv_id", "row_no", F.concat("prompt", answer).alias("messages"))


def to_dpo(candidates: DataFrame, group: list[str], score: str, order: list[str], minimum_gap: float = 0.0) -> DataFrame:
    """Best against every other candidate of a group: group, chosen_ and rejected_ order columns, score_chosen, score_rejected, margin.

    The best row is a partial aggregate joined back, so a group of a third of all rows is never sorted in one task (the join splits it). Groups of one
    candidate give nothing; null scores are left out; the first in order wins a tie.
    """
    c = candidates.where(F.col(score).isNotNull())
    first = F.struct(*[F.col(o).alias(f"chosen_{o}") for o in order], F.col(score).alias("score_chosen"))
    best = c.groupBy(*group).agg(F.max(score).alias("_top")).join(c, group).where(F.col(score) == F.col("_top")).groupBy(*group).agg(F.min(first).alias("_best"))
    rows = c.join(best, group)
    same = [F.col(o).eqNullSafe(F.col(f"_best.chosen_{o}")) for o in order]
    is_best = same[0]
    for s in same[1:]:
        is_best = is_best & s
    out = rows.where(~is_best).select(*group, "_best.*", *[F.col(o).alias(f"rejected_{o}") for o in order], F.col(score).alias("score_rejected"))
    return out.withColumn("margin", F.col("score_chosen") - F.col("score_rejected")).where(F.col("margin") >= minimum_gap)


def to_inputs(flat: DataFrame, order: str = "row_no") -> DataFrame:
    """First row of each (conv_id, turn_id)."""
    return flat.groupBy("conv_id", "turn_id").agg(F.min(order).alias(order), F.min_by("prompt", order).alias("prompt"), F.min_by("single_turn_prompt", order).alias("single_turn_prompt"))


def hash_rank(key: Column, seed: int) -> Column:
    """Order for seeded shuffles, samples and splits: md5 of seed:key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def first_by_hash(df: DataFrame, key: str, k: Column, seed: int = 42) -> DataFrame:
    """Add selected: whether the row is among the first k by hash. Only the hash prefix that holds the k-th row is ranked; k may use _total, the number of rows."""
    h = df.withColumn("_h", hash_rank(F.col(key), seed)).withColumn("_p", F.left("_h", F.lit(3)))
    per = h.groupBy("_p").agg(F.count("*").alias("_n"))  # at most 4096 rows
    per = per.select("_p", "_n", F.sum("_n").over(Window.partitionBy()).alias("_total"), F.sum("_n").over(Window.orderBy("_p")).alias("_upto")).withColumn("_k", k)
    marked = h.join(F.broadcast(per), "_p")
    edge = (F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))
    ranked = marked.where(edge).withColumn("selected", rank <= F.col("_k") - (F.col("_upto") - F.col("_n")))
    plain = marked.where(~edge).withColumn("selected", F.col("_upto") <= F.col("_k"))
    return plain.unionByName(ranked).drop("_h", "_p", "_n", "_total", "_upto", "_k")


def uniform_split(df: DataFrame, key: str, eval_ratio: float = 0.1, n_eval: int | None = None, seed: int = 42) -> DataFrame:
    """Add split: exactly n_eval (or int(ratio * n)) rows are eval, the others train."""
    k = F.least(F.lit(n_eval), F.col("_total")) if n_eval is not None else F.greatest(F.lit(0), F.least(F.floor(F.lit(eval_ratio) * F.col("_total")), F.col("_total")))
    return first_by_hash(df, key, k, seed).withColumn("split", F.when(F.col("selected"), "eval").otherwise("train")).drop("selected")


def sample_exact(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement."""
    return first_by_hash(df, key, F.lit(k), seed).where("selected").drop("selected")


def mix_size(n: int, ratio: float) -> int:
    """Rows of the other source so that they make up ratio of the mixture."""
    import math

    return math.ceil(n * ratio / (1 - ratio)) if 0 <= ratio < 1 else 0


def repeat_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows; each row floor(k / n) times and the first k mod n by hash once more."""
    counted = first_by_hash(df, key, F.lit(k) % F.greatest(F.col("_total"), F.lit(1)), seed)
    n = df.agg(F.count("*").alias("_n"))
    times = F.floor(F.lit(k) / F.col("_n")).cast("int") + F.col("selected").cast("int")
    return counted.join(F.broadcast(n)).withColumn("_times", times).where("_times > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop("_times", "_n", "selected")
