"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with the settings every query assumes (UTC, adaptive execution)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quartzline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a local session that has none a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: a folder that all executors share is needed")
    return os.path.join(tempfile.gettempdir(), "quartzline-shared")


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def counted(df: DataFrame, label: str, **more: Column) -> DataFrame:
    """written(), counting the rows on the way: rows() of the table needs no job. more: further aggregates of df, found in .observed."""
    seen = Observation()
    back = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in more.items()]), label)
    back.observed = seen.get
    return back


def rows(df: DataFrame) -> int:
    """The number of rows; of a table of counted() it is known."""
    return vars(df)["observed"]["rows"] if "observed" in vars(df) else df.count()


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() whose successors have been written; nothing that still reads them may be left."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
