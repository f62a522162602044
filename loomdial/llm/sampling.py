"""Samples that match target category proportions.

Every row has a hash priority; the reservoir of a category is its rows of lowest priority. One aggregation keeps the
reservoirs as histograms of priorities (mergeable by addition, BUCKETS counters a category whatever its size), so the
same pass gives the final counts and the cut-off that trims each reservoir to its quota. Rows below the cut-off bucket are
taken as they stream by; the one cut-off bucket is divided once more, and only rows of the last one are ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdial.functions.text import BLANK, HAN, half_width, id_key, simplified
from loomdial.session import cut

BUCKETS_LOG2 = 12
#: Targets are broadcast up to this many rows, else joined by shuffle.
MAX_BROADCAST_TARGETS = 50_000

# Labels that name no category.
UNKNOWN = ("未知", "未记录", "不详", "无", "暂无", "未填", "未定", "unknown", "na", "none", "null")


def label_key(c: Column) -> Column:
    """Key of a hand-written label: width, case, traditional characters, blanks, marks, leading numbering and the frame
    words 场景 / 学生 / 型 around the name do not count. Null, blank and 'not known' give null."""
    k = F.regexp_replace(simplified(F.lower(half_width(c))), rf"{BLANK}+", "")
    k = F.regexp_replace(k, r"^[“”\"'‘’\[【]*(?:场景|scenario)?(?:[(（]?[0-9]{1,2}[)）]?[.、:：,，]?|[①-⑳])(?=.)", "")
    k = F.regexp_replace(k, rf"[^{HAN}a-z0-9]", "")
    k = F.regexp_replace(F.regexp_replace(F.regexp_replace(k, "(?:类型)?的?(?:学生|student)$", ""), "^(?:学生|student)(?=.)", ""), "(?<=.)型$", "")
    return F.when(~k.isin(*UNKNOWN, ""), k)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST_TARGETS + 1).count() <= MAX_BROADCAST_TARGETS else df


class TargetSample:
    """A sample of rows for each set of targets.

    rows: the id column and the category columns. targets: target_id, target_set, the category columns (null: any value),
    target_permille, min_rows. keys: category column -> function that gives the key under which two labels are the same.
    The sample of a set has floor(rows * share) rows; a target needs max(min_rows, ceil(permille * size / 1000)) and gets
    what it needs or all there is. Ids delivered again count once, null ids not at all; a label that is null, blank or
    unknown belongs to no category; with no rows every target with a need is short.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, id_col: str, keys: dict, share: tuple[int, int] = (1, 5), seed: int = 17):
        cats = list(keys)
        self.id_col = id_col
        once = rows.where(F.col(id_col).isNotNull()).select(id_col, *cats).dropDuplicates([id_col])
        priority = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1)
        keyed = once.select(F.col(id_col).alias("_id"), priority.alias("_priority"), *[keys[c](F.col(c)).alias(c) for c in cats])
        t = targets.select("target_id", "target_set", "target_permille", "min_rows", *[keys[c](F.col(c)).alias(c) for c in cats], F.array(*[F.col(c).isNotNull() for c in cats]).alias("_uses"))
        # a row is looked up once for each combination of category columns that targets use
        shapes = [r[0] for r in t.select("_uses").distinct().collect()]  # at most 2 ** len(cats)
        joined = lambda uses: F.concat_ws("\u0001", F.array_join(F.array(*[F.lit(str(u)) for u in uses]), ","), *[F.col(c) for c, u in zip(cats, uses) if u])
        complete = lambda uses: F.coalesce(F.lit(True) if not any(uses) else F.forall(F.array(*[F.col(c).isNotNull() for c, u in zip(cats, uses) if u]), lambda x: x), F.lit(False))
        key = F.array_compact(F.array(F.lit("*"), *[F.when(complete(u), joined(u)) for u in shapes]))
        t_key = F.coalesce(*[F.when(F.col("_uses") == F.array(*[F.lit(x) for x in u]), joined(u)) for u in shapes], F.lit(None)) if shapes else F.lit("")
        self.targets = t.withColumn("_key", t_key)
        spark = rows.sparkSession
        entries = self.targets.where("_key is not null").select("_key", "target_id")
        entries = entries.unionByName(spark.createDataFrame([("*", None)], entries.schema))  # the row '*' counts all rows
        self.members = (
            keyed.select("_id", "_priority", F.shiftright("_priority", 63 - BUCKETS_LOG2).alias("_bucket"), F.explode(key).alias("_key")).join(_small(entries), "_key").drop("_key")
        )
        # the one pass over the rows: reservoirs of all partitions merged, at most 2 ** BUCKETS_LOG2 counters a target
        histogram = cut(self.members.groupBy("target_id", "_bucket").agg(F.count("*").alias("n")))
        self.reservoirs = histogram.where("target_id is not null")
        counts = histogram.groupBy("target_id").agg(F.sum("n").alias("available"))
        total = counts.where("target_id is null").select(F.col("available").alias("_total")).agg(F.coalesce(F.max("_total"), F.lit(0)).alias("_total"))
        size = F.floor(F.col("_total") * share[0] / share[1])
        need = F.greatest(F.col("min_rows"), F.ceil(F.col("target_permille") * F.col("sample_size") / 1000.0))
        self.plan = (
            self.targets.drop("_uses", "_key", *cats)
            .join(counts.where("target_id is not null"), "target_id", "left")
            .join(F.broadcast(total))  # one row
            .withColumn("sample_size", size)
            .withColumn("available", F.coalesce("available", F.lit(0)))
            .withColumn("needed", need.cast("bigint"))
            .withColumn("taken", F.least("needed", "available"))
            .withColumn("short", F.col("available") < F.col("needed"))
            .drop("_total")
        )

    def report(self) -> DataFrame:
        """Each target with what it needs, what there is, what it gets and the share reached in its set's sample."""
        in_set = Window.partitionBy("target_set")
        return self.plan.withColumn("reached_permille", F.round(F.try_divide(F.col("taken") * 1000.0, F.sum("taken").over(in_set)), 3))

    def shortfalls(self) -> DataFrame:
        return self.plan.where("short")

    @staticmethod
    def _edge(histogram: DataFrame, wanted: DataFrame) -> DataFrame:
        """Of each target the bucket in which the trim falls (_last) and how many of its rows are taken (_rest); wanted has target_id, target_set, _want."""
        upto = Window.partitionBy("target_id").orderBy("_bucket")
        reached = histogram.withColumn("_upto", F.sum("n").over(upto)).join(wanted, "target_id").where("_upto - n < _want")
        return reached.groupBy("target_id", "target_set").agg(F.max("_bucket").alias("_last"), F.max_by(F.col("_want") - (F.col("_upto") - F.col("n")), "_bucket").alias("_rest"))

    def sample(self) -> DataFrame:
        """target_set, target_id and the id of every sampled row.

        The bucket at the trim is divided by the next BUCKETS_LOG2 bits of the priority in the same way, so that a task ranks one in 2 ** 24 rows of a category only.
        """
        placed, taken = self.members.where("target_id is not null").drop("_bucket"), []
        wanted, histogram = self.plan.select("target_id", "target_set", F.col("taken").alias("_want")), self.reservoirs
        for level in (1, 2):
            bucket = F.shiftright("_priority", 63 - level * BUCKETS_LOG2)
            if level > 1:
                placed = placed.select("target_id", "_id", "_priority")
                histogram = placed.groupBy("target_id", bucket.alias("_bucket")).agg(F.count("*").alias("n"))
            edge = cut(self._edge(histogram, wanted))  # a row a target
            met = placed.withColumn("_bucket", bucket).join(_small(edge), "target_id").where("_bucket <= _last")
            taken.append(met.where("_bucket < _last").select("target_set", "target_id", "_id"))
            placed, wanted = met.where("_bucket = _last"), edge.select("target_id", "target_set", F.col("_rest").alias("_want"))
        rank = F.row_number().over(Window.partitionBy("target_id").orderBy("_priority", "_id"))
        taken.append(placed.withColumn("_rank", rank).where("_rank <= _rest").select("target_set", "target_id", "_id"))
        return reduce(DataFrame.unionByName, taken).withColumnRenamed("_id", self.id_col)


def session_sample(sessions: DataFrame, targets: DataFrame) -> TargetSample:
    return TargetSample(sessions, targets, "session_no", {"student_type": label_key, "scenario": label_key, "topic_id": id_key})
