"""Features that grow with their bars: each append computes the new rows alone, from the last rows of each series and the ends of its means."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzline.operators.features import REACH, exponential_parts, rolling_features
from quartzline.operators.windows import chunked
from quartzline.session import discard, shared_dir, written
from quartzline.sources.market import file_system
from quartzline.streaming.market import VERSIONS, versions

#: The tables of an append: its features, the last bars of each series, and the ends of the means and of the means of means.
FEATURES, TAIL, MEANS, SIGNALS = "features", "tail", "means", "signals"
STATE = (TAIL, MEANS, SIGNALS)


def commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(version, folder) of the appends that were committed, ascending."""
    whole = versions(spark, f"{root}/commits")[1]
    if not whole:
        return []
    found = spark.read.schema("version long, folder string").json([f"{root}/commits/{v}" for v in whole])
    return sorted((r.version, r.folder) for r in found.collect())


def appended(spark: SparkSession, root: str) -> DataFrame | None:
    """The features of all committed appends; None before the first."""
    done = commits(spark, root)
    return spark.read.parquet(*[f"{root}/parts/{folder}/{FEATURES}" for _, folder in done]) if done else None


def of_series(df: DataFrame, series: DataFrame, how: str) -> DataFrame:
    """A semi or anti join on the series; null is a series."""
    return df.join(series.select(F.col("series").alias("__s")), F.col("series").eqNullSafe(F.col("__s")), how)


def in_time(bars: DataFrame, tail: DataFrame, late: str) -> DataFrame:
    """The bars after the last one of their series in tail. Others, and bars without a time in a series that has some, are dropped or an error, as late says."""
    at = tail.groupBy("series").agg(F.max("ts").alias("__until"), F.lit(True).alias("__known")).withColumnRenamed("series", "__s")
    after = F.col("__known").isNull() | F.coalesce(F.col("ts") > F.col("__until"), F.col("ts").isNotNull() & F.col("__until").isNull())
    d = bars.join(at, F.col("series").eqNullSafe(F.col("__s")), "left").withColumn("__after", after)
    if late == "fail":
        n = d.where(~F.col("__after")).count()
        if n:
            raise ValueError(f"{n} bars are no later than those that stand; build their features anew")
    return d.where("__after").select(*bars.columns)


def advanced(bars: DataFrame, state: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """The features of bars that follow those of state, and the state after them; then the tables to discard once these are written.

    The features are those of build_features() over all bars so far: windows reach back to the rows of tail, and means go on from their ends. Series
    without new bars cost nothing and keep their state. Rows of a null ts come first in their series, so they may only come with its first bars.
    """
    columns = bars.columns
    d = bars.withColumn("__old", F.lit(False))
    if state:
        here = bars.select("series").distinct()
        d = d.unionByName(of_series(state[TAIL], here, "left_semi").withColumn("__old", F.lit(True)))
    d = written(d, "advance")
    parts, means, signals = exponential_parts(d, (state[MEANS], state[SIGNALS]) if state else None)
    out = {FEATURES: rolling_features(parts).where("NOT __old").drop("__old"), MEANS: means, SIGNALS: signals}
    rows = written(means.select(F.col("series").alias("__s"), "rows"), "rows")
    last = chunked(d, 0).join(rows, F.col("series").eqNullSafe(F.col("__s"))).where(F.col("__rn") >= F.col("rows") - REACH)
    out[TAIL] = last.select(*columns)
    for k in (MEANS, SIGNALS):  # positions count from the first row of the tail
        held = F.least(F.col("rows"), F.lit(REACH))
        out[k] = out[k].select(*[(F.col(c) - F.col("rows") + held if c.endswith("_last") else held if c == "rows" else F.col(c)).alias(c) for c in out[k].columns])
    if state:
        out |= {k: out[k].unionByName(of_series(state[k], here, "left_anti")) for k in STATE}
    return out, [d, rows]


def append(bars: DataFrame, root: str, late: str = "fail") -> int | None:
    """Computes the features of new bars and commits them below root; returns the version, or None where no bar is new.

    bars: series, ts and the columns of a bar, in any order. A bar at or before the last one of its series is an error (late="fail") or dropped
    (late="drop", so that repeating an append adds nothing). A commit is one row, written last: a writer that is lost before leaves what stood.
    One writer at a time. Only the last states stay.
    """
    if late not in ("fail", "drop"):
        raise ValueError(f"late is fail or drop, not {late}")
    spark, done = bars.sparkSession, commits(bars.sparkSession, root)
    state = None
    if done:
        state = {k: spark.read.parquet(f"{root}/parts/{done[-1][1]}/{k}") for k in STATE}
        bars = in_time(bars, state[TAIL], late)
    bars = written(bars, "new-bars")
    if bars.isEmpty():
        discard(bars)
        return None
    version = (versions(spark, f"{root}/commits")[0] or [-1])[-1] + 1
    folder = f"{version}-{uuid.uuid4().hex}"
    tables, read = advanced(bars, state)
    for k, table in tables.items():
        table.write.parquet(f"{root}/parts/{folder}/{k}")
    discard(bars, *read)
    commit = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"))
    commit.coalesce(1).write.json(f"{root}/commits/{version}")
    for _, old in done[: -(VERSIONS - 1)]:
        for k in STATE:
            at, fs = file_system(spark, f"{root}/parts/{old}/{k}")
            fs.delete(at, True)
    return version


def keep_features(bars: DataFrame, root: str, checkpoint: str | None = None):
    """Starts a query that appends the features of each batch of final bars (as of hourly_bars()); repeated batches and lost checkpoints add nothing twice."""
    name = hashlib.sha256(root.encode()).hexdigest()[:16]
    checkpoint = checkpoint or f"{shared_dir(bars.sparkSession)}/features-{name}"

    def add(batch: DataFrame, epoch: int) -> None:
        append(batch, root, "drop")

    return bars.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
