"""Scans of JSON, JSON Lines, Parquet, archives and result trees; every row keeps its file and place."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdial.functions.canon import is_junk_path, normal_path

MESSAGE = "struct<role:string,content:string>"
TURN = "struct<role:string,content:string,score:double>"
ANNOTATION = "struct<speaker:string,utterance:string,teacher_intent:string,teaching_strategy:string,discipline:string,discipline_transfer:string,student_cognition_state:string,teacher_guidance_level:string,cognitive_level:string>"
SESSION = f"student_id string, student_type string, scenario string, topic_id string, topic_text string, repeat_id string, dialogue array<{TURN}>, annotations array<{ANNOTATION}>, quality_score double"
NESTED = f"conv_id string, single_turn_prompt string, single_turn_completion string, single_turn_metadata map<string,string>, turns array<struct<prompt:array<{MESSAGE}>,responses:array<struct<completion:string,score:double>>>>"
FLAT = f"prompt array<{MESSAGE}>, completion string, conv_id string, score double, single_turn_prompt string, single_turn_completion string, single_turn_metadata map<string,string>, turn_id int"
DPO = f"prompt array<{MESSAGE}>, chosen string, rejected string, score_chosen double, score_rejected double, margin double"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_lines(spark: SparkSession, path: str, pattern: str = "*.{json,jsonl,JSON,JSONL}") -> DataFrame:
    """file, ord, value of every line below a path; dot files are skipped, a missing path is empty. ord orders the lines of a file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, ord bigint, value string")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    # a file's splits are whole ranges of bytes; within a split the running id follows the lines
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select(F.col("_metadata.file_path").alias("file"), (F.shiftleft(F.col("_metadata.file_block_start"), 0) + within).alias("ord"), "value")


def parse_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): objects by schema, and bad lines as file, ord, reason (json_errors or schema_error), start. Blank lines are neither."""
    v = lines.where(F.trim("value") != "").withColumn("_v", F.try_parse_json("value"))
    kind = F.when(F.col("_v").isNull(), "json_errors").when(~F.schema_of_variant("_v").startswith("OBJECT"), "schema_error")
    v = v.withColumn("_reason", kind)
    rows = v.where("_reason is null").select("file", "ord", F.from_json("value", schema).alias("r")).select("file", "ord", "r.*")
    return rows, v.where("_reason is not null").select("file", "ord", F.col("_reason").alias("reason"), F.left("value", F.lit(500)).alias("start"))


def whole_file_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of files without a bad line: one bad line drops its file."""
    rows, rejects = parse_lines(lines, schema)
    return rows.join(rejects.where("reason = 'json_errors'").select("file").distinct(), "file", "left_anti")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A .json file with an array or one object, .jsonl lines, a folder of them, or Parquet: one reader by the path's form."""
    if path.lower().endswith(".jsonl"):
        return parse_lines(scan_lines(spark, path), schema)[0].drop("file", "ord")
    if path.lower().endswith(".json"):
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    names = [f.getPath().getName() for f in spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))]
    if any(n.endswith(".parquet") for n in names):
        return spark.read.parquet(path)
    return parse_lines(scan_lines(spark, path), schema)[0].drop("file", "ord")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions with defaults: missing texts are '', missing arrays empty, quality 0."""
    df = read_documents(spark, path, SESSION)
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("student_id", "student_type", "scenario", "topic_id", "topic_text", "repeat_id")]
    arrays = [F.filter(F.coalesce("dialogue", F.array().cast(f"array<{TURN}>")), lambda t: (F.trim(t["role"]) != "") & t["content"].isNotNull()).alias("dialogue"), F.coalesce("annotations", F.array().cast(f"array<{ANNOTATION}>")).alias("annotations")]
    return df.select(*filled, *arrays, F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"))


def shape(df: DataFrame) -> str:
    """nested, flat, dpo or single_turn by the columns; missing columns raise."""
    have = set(df.columns)
    for name, needs in (("dpo", {"prompt", "chosen", "rejected"}), ("nested", {"turns"}), ("flat", {"prompt", "completion", "conv_id", "score", "single_turn_prompt", "single_turn_completion", "single_turn_metadata"}), ("single_turn", {"prompt", "completion"})):
        if needs <= have:
            return name
    raise ValueError(f"columns {sorted(have)} fit no known shape")


def with_turn_id(flat: DataFrame) -> DataFrame:
    return flat.withColumn("turn_id", F.coalesce("turn_id", F.size("prompt")) if "turn_id" in flat.columns else F.size("prompt"))


def pack_metadata(df: DataFrame, keep: tuple[str, ...] = ("prompt", "completion", "split")) -> DataFrame:
    """single_turn_prompt, single_turn_completion, single_turn_metadata (a struct of the other columns) and split if there is one."""
    rest = [c for c in df.columns if c not in keep]
    out = [F.col("prompt").alias("single_turn_prompt"), F.col("completion").alias("single_turn_completion"), (F.struct(*rest) if rest else F.struct(F.lit(None).cast("string").alias("none"))).alias("single_turn_metadata")]
    return df.select(*out, *[c for c in ("split",) if c in df.columns])


def external_answers(df: DataFrame, source: str) -> DataFrame:
    """instruction, input, output rows to flat rows; empty, shorter than 10 and longer than 4000 characters go. The id is a digest, not random."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    question = F.when(text("input") != "", F.concat_ws("\n", text("instruction"), text("input"))).otherwise(text("instruction"))
    df = df.withColumns({"_q": question, "_a": text("output")}).where((F.col("_q") != "") & F.length("_a").between(10, 4000))
    return df.select(
        F.array(F.struct(F.lit("user").alias("role"), F.col("_q").alias("content"))).alias("prompt"), F.col("_a").alias("completion"),
        F.concat_ws("_", F.lit(source), F.left(F.md5(F.concat_ws("\u0001", "_q", "_a").cast("binary")), F.lit(8))).alias("conv_id"), F.lit(1.0).alias("score"), F.lit(1).alias("turn_id"),
        F.col("_q").alias("single_turn_prompt"), F.col("_a").alias("single_turn_completion"), F.create_map(F.lit("source"), F.lit(source)).alias("single_turn_metadata"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def nonblank_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count() if exists(spark, path) else 0


def tree_kind(path: Column) -> Column:
    """struct(kind, model, file) of a result path: the last 'final' or 'metrics' folder counts; other paths are null."""
    p = normal_path(path)
    final = r"^(?:.*/)?final/([^/]+)/([^/]+)\.jsonl$"
    detail = r"^(?:.*/)?metrics/([^/]+)_per_file_metrics/([^/]+)_metrics\.json$"
    summary = r"^(?:.*/)?metrics/([^/]+)\.json$"
    row = lambda kind, rx, two: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(p, rx, 1).alias("model"), (F.regexp_extract(p, rx, 2) if two else F.lit("")).alias("file"))
    return F.when(is_junk_path(path), None).when(p.rlike(final), row("final", final, True)).when(p.rlike(detail), row("detail", detail, True)).when(p.rlike(summary), row("summary", summary, False))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, path, text of the entries of ZIP files; archives are opened one at a time in the tasks."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for e in z.infolist():
                        if not e.is_dir():
                            yield pd.DataFrame({"archive": [name], "path": [e.filename], "text": [z.read(e).decode("utf-8", "replace")]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(unzip, "archive string, path string, text string")


def final_rows(entries: DataFrame) -> DataFrame:
    """model, file, row_index (of valid rows), record of the 'final' entries of an archive."""
    e = entries.withColumn("_k", tree_kind(F.col("path"))).where("_k.kind = 'final'")
    lines = e.select("_k.model", "_k.file", F.filter(F.split("text", "\n"), lambda x: F.try_parse_json(x).isNotNull() & (F.trim(x) != "")).alias("_l"))
    return lines.select("model", "file", F.posexplode("_l").alias("row_index", "record"))


def metric_entry(c: Column) -> Column:
    """struct(score, display, raw_value) of a metric written as object, number or text."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    text = F.try_variant_get(v, "$", "string")
    share = F.when(text.endswith("%"), F.try_to_number(F.regexp_replace(text, "%$", ""), F.lit("999999.9999")).cast("double") / 100).otherwise(number)
    score = F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$.score", "double")).otherwise(share)
    return F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$.display", "string")).otherwise(text).alias("display"), F.try_variant_get(v, "$.raw_value", "double").alias("raw_value"))
