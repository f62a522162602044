"""Merging of externally produced results, summaries and comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loomdial.functions.canon import is_ablation, model_name, parse_request_id, percent, py_strip
from loomdial.session import cut

RESPONSE = "struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>"
#: Dimension tables are broadcast up to this many rows, else joined by shuffle.
MAX_BROADCAST_ROWS = 100_000


def small_side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def batch_responses(lines: DataFrame, value: str = "value", order: str = "ord") -> DataFrame:
    """custom_id, name, dialogue, pair, content, ok of batch-response lines; the last line of an id wins. Lines that are no JSON object are left out."""
    r = lines.select(order, F.from_json(value, f"custom_id string, response {RESPONSE}").alias("j")).where("j.custom_id is not null")
    r = r.groupBy(F.col("j.custom_id").alias("custom_id")).agg(F.max_by(F.col("j.response"), order).alias("response"))
    content = F.try_element_at(F.col("response.body.choices"), F.lit(1))["message"]["content"]
    ok = (F.col("response.status_code") == 200) & (F.coalesce(py_strip(content), F.lit("")) != "")
    return r.select("custom_id", parse_request_id(F.col("custom_id")).alias("id"), content.alias("content"), F.coalesce(ok, F.lit(False)).alias("ok")).select("custom_id", "id.*", "content", "ok")


def response_counts(responses: DataFrame) -> DataFrame:
    return responses.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def merge_pair_results(pairs: DataFrame, results: DataFrame, keys: list[str], pair: str, value: str) -> DataFrame:
    """Per dialogue (keys without pair) the values of its pairs in order, pairs without a result skipped: keys, values, n_missing."""
    joined = pairs.join(results, [*keys, pair], "left")
    ordered = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(pair, value))))
    return joined.groupBy(*keys).agg(ordered.alias("_v"), F.count_if(F.col(value).isNull()).alias("n_missing")).withColumn("values", F.transform("_v", lambda x: x[value])).drop("_v")


def merge_rewrites(pairs: DataFrame, rewrites: DataFrame, key: str = "pair_no") -> DataFrame:
    """Pairs with chosen replaced by its rewrite; original_chosen is kept only where one exists."""
    r = rewrites.select(key, F.nullif(py_strip(F.col("rewrite")), F.lit("")).alias("_rewrite"))
    joined = pairs.join(r, key, "left")
    return joined.withColumn("original_chosen", F.when(F.col("_rewrite").isNotNull(), F.col("chosen"))).withColumn("chosen", F.coalesce("_rewrite", "chosen")).drop("_rewrite")


def outer_merge(rows: DataFrame, metrics: DataFrame, keys: list[str], complete: Column, computed: Column) -> DataFrame:
    """Full outer join of rows with uploaded metrics: source is uploaded (complete), computed, partial or none."""
    l = rows.withColumn("_row", F.lit(True))  # noqa: E741
    r = metrics.withColumn("_metric", F.lit(True))
    source = F.when(complete, "uploaded").when(computed, "computed").when(F.col("_metric"), "partial").otherwise("none")
    return l.join(r, keys, "full_outer").withColumn("metrics_source", source).withColumn("has_row", F.col("_row").isNotNull()).withColumn("has_metrics", F.col("_metric").isNotNull()).drop("_row", "_metric")


def count_mismatches(rows: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows, n_metrics where the counts differ."""
    a, b = rows.groupBy(*keys).agg(F.count("*").alias("n_rows")), metrics.groupBy(*keys).agg(F.count("*").alias("n_metrics"))
    j = a.join(b, keys, "full_outer").select(*keys, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_metrics", F.lit(0)).alias("n_metrics"))
    return j.where("n_rows <> n_metrics")


def fill_missing_summaries(uploaded: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Uploaded summaries and, for keys without one, the computed."""
    return uploaded.unionByName(computed.join(uploaded.select(key), key, "left_anti"))


def summary(metrics: DataFrame, scores: list[str], group: list[str] | None = None) -> DataFrame:
    """Mean of each score over the rows that have it, and the number of rows."""
    aggs = [F.count("*").alias("n"), *[F.avg(s).alias(s) for s in scores]]
    return metrics.groupBy(*group).agg(*aggs) if group else metrics.agg(*aggs)


def summary_display(summary_: DataFrame, scores: list[str], total: str = "total_score") -> DataFrame:
    """Percentages with two digits; the total with four."""
    return summary_.select(*[F.format_string("%.4f", s).alias(s) if s == total else percent(F.col(s)).alias(s) for s in scores])


def mean_and_deviation(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """Mean and sample deviation; 0 for fewer than two rows."""
    return df.groupBy(*group).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.coalesce(F.when(F.count(score) > 1, F.stddev_samp(score)), F.lit(0.0)).alias("deviation"))


def weighted_reward(scores: Column, weights: list[float]) -> Column:
    """Sum of weight times score; missing scores count 0. As many weights as scores."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(scores, w, lambda s, x: F.coalesce(s, F.lit(0.0)) * x), F.lit(0.0), lambda a, x: a + x)


def design_table(design: DataFrame, summaries: DataFrame, scores: list[str], how: str = "left") -> DataFrame:
    """Static designs with the summary of the model of that name, in design order; '--' where there is none."""
    s = summaries.select(F.lower(model_name(F.col("model"))).alias("_m"), *scores)
    j = small_side(design).join(s, F.lower(F.col("group")) == F.col("_m"), how)
    return j.select("ord", "group", *[F.coalesce(F.format_string("%.4f", c), F.lit("--")).alias(c) for c in scores]).orderBy("ord")


def other_summaries(summaries: DataFrame) -> DataFrame:
    """Summaries of models that are no ablation group, best first."""
    return summaries.where(~is_ablation(F.col("model"))).orderBy(F.col("total_score").desc_nulls_last(), "model")


def axis_top(best: Column) -> Column:
    """Upper end of a chart axis: the next quarter, 1 at least."""
    return F.greatest(F.lit(1.0), F.ceil(best * 4) / 4)


def keyword_search(df: DataFrame, columns: list[str], word: str) -> DataFrame:
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(word.lower()))


def request_parts(requests: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """group, order, size and part: requests in order fill parts of up to limit bytes; one larger than that has a part of its own.

    The running total starts again at each part, so a group (file) is read in order by one task, groups in parallel. Rows stream past in
    sorted partitions; only numbers are carried from batch to batch, and a part is found by one binary search. A null size counts as 0.
    """
    rows = requests.select(group, order, size)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, used, part = None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            codes = pd.factorize(batch[group], use_na_sentinel=False)[0]
            sizes = batch[size].fillna(0).to_numpy(dtype=np.int64)
            begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            parts = np.zeros(len(batch), dtype=np.int32)
            for at, end in zip(begins, [*begins[1:], len(batch)]):
                name = batch[group].iat[at]
                name = (True, None) if pd.isna(name) else (False, name)
                if name != last:
                    last, used, part = name, 0, 0
                total = np.concatenate([[0], np.cumsum(sizes[at:end])])
                k, n = 0, end - at
                while k < n:
                    fits = int(np.searchsorted(total, total[k] + limit - used, "right")) - 1
                    if fits <= k:
                        if used > 0:
                            part, used = part + 1, 0
                            continue
                        fits = k + 1
                    parts[at + k : at + fits] = part
                    used += int(total[fits] - total[k])
                    k = fits
            yield batch.assign(part=parts)

    fields = [rows.schema[c] for c in (group, order, size)]
    return rows.repartition(group).sortWithinPartitions(group, order).mapInPandas(scan, StructType([*fields, StructField("part", IntegerType())]))


def shard(index: Column, n: Column, shards: int) -> Column:
    """Contiguous shards; the last takes the remainder."""
    return F.least(F.floor(index / F.greatest(F.lit(1), F.floor(n / shards))), F.lit(shards - 1)).cast("int")


def dense_index(df: DataFrame, order: list[str], name: str = "ix") -> DataFrame:
    """0-based index in the given order without one task for all rows: ranks within range partitions, offset by the partitions before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    base = cut(ranged.withColumn("_in", F.col("_mono") - F.shiftleft(F.col("_pid").cast("bigint"), 33)))  # read twice: ranges must not be drawn anew
    counts = base.groupBy("_pid").agg(F.count("*").alias("_c"))  # one row per partition
    offset = counts.select("_pid", (F.sum("_c").over(Window.orderBy("_pid")) - F.col("_c")).alias("_offset"))
    return base.join(F.broadcast(offset), "_pid").withColumn(name, F.col("_in") + F.col("_offset")).drop("_pid", "_mono", "_in", "_offset")
