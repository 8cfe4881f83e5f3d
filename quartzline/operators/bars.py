"""Ticks and minute bars to clean hourly bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzline.functions.exprs import ohlc_valid

BAR = ("open", "high", "low", "close", "volume", "minute_count")


def require(df: DataFrame, columns) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def keep_last(df: DataFrame, keys=("series", "ts"), order: str = "seq") -> DataFrame:
    """One row for each key, the last in input order; max_by combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return best.select(*keys, "__row.*")


def resample(df: DataFrame, every: str = "1 hour", by=("series",), ts: str = "ts", o="open", h="high", low="low", c="close", volume: str | None = "volume", order: Column | None = None) -> DataFrame:
    """Bars labelled by their left edge; empty buckets have no row. Missing prices are skipped, all-missing volume stays missing.

    order breaks ties of ts for the first and last price.
    """
    order = F.col(ts) if order is None else order
    d = df.groupBy(*by, F.window(ts, every).alias("__w")).agg(
        F.min_by(o, F.when(F.col(o).isNotNull(), order)).alias("open"),
        F.max(h).alias("high"),
        F.min(low).alias("low"),
        F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias("close"),
        (F.sum(volume) if volume else F.count(c).cast("double")).alias("volume"),
        F.count(c).alias("minute_count"),
    )
    return d.select(*by, F.col("__w.start").alias("ts"), *BAR).dropna(subset=["open", "high", "low", "close"])


def tag_rows(df: DataFrame, by=("series",), order: str = "seq", ms: str = "ms", start_ms: int | None = None, end_ms: int | None = None, block: str | None = None) -> DataFrame:
    """Adds tag: out_of_range, duplicate, malformed or written.

    Among rows of valid prices time must strictly increase. As the running maximum over valid rows equals that over accepted rows, one
    window decides. A row at or below it is a duplicate even where its prices are bad. Where block names a column by which order sorts
    first, such as the file, each block has a task of its own and the maximum of earlier blocks comes from a table of one row a block.
    """
    inside = F.lit(True)
    if start_ms is not None:
        inside = inside & (F.col(ms) >= start_ms)
    if end_ms is not None:
        inside = inside & (F.col(ms) < end_ms)
    valid = ohlc_valid(F.col("open"), F.col("high"), F.col("low"), F.col("close")) & inside
    until = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    if block is None:
        before = F.max(F.when(valid, F.col(ms))).over(until(*by).orderBy(order))
    else:
        tops = df.groupBy(*by, block).agg(F.max(F.when(valid, F.col(ms))).alias("__top"))
        tops = tops.select(*by, block, F.max("__top").over(until(*by).orderBy(block)).alias("__top"))
        df = df.join(tops, [*by, block])
        before = F.greatest("__top", F.max(F.when(valid, F.col(ms))).over(until(*by, block).orderBy(order)))
    tag = F.when(F.col(ms).isNull(), "malformed").when(~inside, "out_of_range").when(F.col(ms) <= before, "duplicate").when(~valid, "malformed").otherwise("written")
    return df.withColumn("tag", tag).drop("__top")


def tag_report(tagged: DataFrame, by=("series",), ms: str = "ms") -> DataFrame:
    ok = F.col("tag") == "written"
    return tagged.groupBy(*by).agg(
        F.count_if(ok).alias("rows_written"), F.count_if(F.col("tag") == "duplicate").alias("duplicates"), F.count_if(F.col("tag") == "malformed").alias("malformed"),
        F.min(F.when(ok, F.col(ms))).alias("first_ms"), F.max(F.when(ok, F.col(ms))).alias("last_ms"),
        F.countDistinct(F.when(ok, F.to_date(F.timestamp_millis(ms)))).alias("days_with_data"),
    )


def epoch_unit_factor(df: DataFrame, by=("series",), ts: str = "timestamp") -> DataFrame:
    """Per file: 1000 where the median timestamp is in seconds, else 1."""
    return df.groupBy(*by).agg(F.when(F.median(ts) < 10_000_000_000, 1000).otherwise(1).cast("long").alias("to_ms"))
