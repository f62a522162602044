"""Session defaults and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "loomdial", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # else every Column call takes milliseconds to note its call site
        **conf,
    }.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder from spark.checkpoint.dir; only where it is unset (one machine) use a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="loomdial-")
        atexit.register(shutil.rmtree, shared, True)
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from it: cuts the lineage and survives the loss of an executor.

    Unlike a checkpoint the table tells the planner its true size; the sizes that a checkpoint hands on are products of those of all
    joins before it, and in loops grow without bound.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for data whose partitions must stay as they are."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by cut() that nothing reads any more."""
    for df in tables:
        file = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["_cut_path"])
        file.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(file, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
