"""Structured Streaming forms of the market operators: late-safe bars, latest quotes, rate limiting."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quartzline.session import shared_dir
from quartzline.sources.market import file_system


def hourly_bars(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Append-mode hourly bars of a stream (series, ts, price): a bar is final once the watermark has passed its end."""
    d = ticks.withWatermark("ts", late).groupBy("series", F.window("ts", "1 hour").alias("w"))
    d = d.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("price").cast("double").alias("volume"), F.count("price").alias("minute_count"))
    return d.select("series", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "minute_count")


def distinct_ticks(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["series", "ts"])


def rate_limited(requests: DataFrame, limit: int, seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """Allowed flags of a stream (client, us, id); state holds the accepted times of one window per client and goes once the watermark has passed them.

    Only the requests' own times count, so a replay decides as the first run did and as the batch form does. Requests that are later than late are
    dropped, and those of a client within one batch are put in order together: a batch must be bounded by the source (maxFilesPerTrigger, maxOffsetsPerTrigger).
    """

    window = seconds * 1_000_000

    def decide(key, frames, state):
        if state.hasTimedOut:  # the watermark is a window past the last accepted time
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = sorted((int(us), ident) for pdf in frames for us, ident in zip(pdf["us"], pdf["id"], strict=True))
        out = []
        for us, _ in rows:
            near = [t for t in held if us - window < t <= us]
            out.append(len(near) < limit)
            if out[-1]:
                held.append(us)
        last = max([*held, *(us for us, _ in rows)])
        held = [t for t in held if t > last - window]
        state.update((held,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "us": [r[0] for r in rows], "id": [r[1] for r in rows], "allowed": out})

    timed = requests.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    return timed.groupBy("client").applyInPandasWithState(decide, "client string, us long, id long, allowed boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


#: Versions of a table that stay, so that readers of an old one can end.
VERSIONS = 3


def versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """(all version numbers below path, those that were written to the end), ascending."""
    at, fs = file_system(spark, path)
    found = sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []
    return found, [v for v in found if fs.exists(file_system(spark, f"{path}/{v}/_SUCCESS")[0])]


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a table of keep_latest(); None before the first."""
    whole = versions(spark, path)[1]
    return spark.read.parquet(f"{path}/{whole[-1]}") if whole else None


def keep_latest(quotes: DataFrame, path: str, checkpoint: str | None = None):
    """Starts a query that keeps the last quote of each series in a table; each batch adds a version of it, and old versions go.

    A batch builds on the newest whole version, whichever run wrote it, so neither a repeated batch nor a lost checkpoint forgets a quote. A version that
    a lost writer left unfinished is never read.
    """
    name = hashlib.sha256(path.encode()).hexdigest()[:16]
    checkpoint = checkpoint or f"{shared_dir(quotes.sparkSession)}/latest-quotes-{name}"  # one for each table

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        every, whole = versions(spark, path)
        seen = batch.unionByName(spark.read.parquet(f"{path}/{whole[-1]}").select(*batch.columns)) if whole else batch
        best = seen.groupBy("series").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "series"]), "ts").alias("q")).select("series", "q.*")
        best.write.parquet(f"{path}/{every[-1] + 1 if every else epoch}")
        for old in [v for v in every if v not in whole[-(VERSIONS - 1) :]]:
            at, fs = file_system(spark, f"{path}/{old}")
            fs.delete(at, True)

    return quotes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).start()
