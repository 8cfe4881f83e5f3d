"""Market data sources and sinks: CSV bars, packed daily files, zipped archives, manifests, order books and reports."""

from __future__ import annotations

import hmac
import io
import lzma
import re
import uuid
import zipfile
from datetime import date
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import quartzline
from quartzline.functions.exprs import epoch_ms, finite, fixed_offset_utc, iso_seconds, number, ohlc_valid, usd_per_kg, usd_per_kg_exact
from quartzline.operators.bars import epoch_unit_factor, keep_last, require, tag_rows

cloudpickle.register_pickle_by_value(quartzline)
PRICES = ("open", "high", "low", "close")
NORMALISED = ("timestamp_utc", "timestamp_ms", "open_usd_per_kg", "high_usd_per_kg", "low_usd_per_kg", "close_usd_per_kg", "volume_source_units", "metal", "source_symbol", "source", "price_side", "price_unit")
# The instruments, their symbols and kinds.
INSTRUMENTS = (("gold", "XAU/USD", "metal"), ("silver", "XAG/USD", "metal"), ("palladium", "XPD/USD", "metal"), ("platinum", "XPT/USD", "metal"), ("udx", "UDX/USD", "index"), ("spx", "SPX/USD", "index"), ("wti", "WTI/USD", "commodity"))


def instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INSTRUMENTS, "series string, symbol string, kind string")


def with_instrument(df: DataFrame) -> DataFrame:
    """Adds symbol and kind; a series that is no instrument ends the job."""
    d = df.join(F.broadcast(instruments(df.sparkSession)), "series", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown instrument "), F.coalesce("series", F.lit("null"))))
    return d.withColumn("symbol", F.when(F.col("symbol").isNotNull(), F.col("symbol")).otherwise(unknown.cast("string")))


def read_csv(spark: SparkSession, path, header: bool = True, sep: str = ",") -> DataFrame:
    """All columns as text with trimmed lower-case names, and seq: the order of rows within and across files."""
    d = spark.read.csv(path, header=header, sep=sep, encoding="UTF-8")
    d = d.toDF(*[c.lstrip("﻿").strip().lower() for c in d.columns])
    return d.withColumn("seq", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")))


def priced(d: DataFrame) -> DataFrame:
    """Rows with a time and all prices, the last of each time."""
    return keep_last(d.dropna(subset=["ts", *PRICES])).drop("seq")


def raw_minutes(spark: SparkSession, path, series: str) -> DataFrame:
    """Provider-native minute bars: absent volume is zero, rows without a time or a price are dropped, then the last of a time is kept.

    Times are epoch seconds in files whose median is small, milliseconds in others. No row with a time is an error.
    """
    d = require(read_csv(spark, path), ("timestamp", *PRICES))
    volume = number(F.col("volume")) if "volume" in d.columns else F.lit(0.0)
    d = d.select(F.col("seq.file").alias("file"), number(F.col("timestamp")).alias("timestamp"), *[number(F.col(c)).alias(c) for c in PRICES], F.coalesce(volume, F.lit(0.0)).alias("volume"), "seq").dropna(subset=["timestamp"])
    units = epoch_unit_factor(d, by=("file",)).cache()
    if units.isEmpty():
        raise ValueError(f"{series}: no valid timestamps")
    d = d.join(F.broadcast(units), "file")  # one row a file
    return priced(d.select(F.lit(series).alias("series"), F.timestamp_millis((F.col("timestamp") * F.col("to_ms")).cast("long")).alias("ts"), *PRICES, "volume", "seq"))


def metal_minutes(spark: SparkSession, path, series: str) -> DataFrame:
    """raw_minutes() of a metal, in USD per kilogram."""
    return raw_minutes(spark, path, series).withColumns({c: usd_per_kg(F.col(c)) for c in PRICES})


def normalised_minutes(spark: SparkSession, path, series: str) -> DataFrame:
    """Minute bars in USD per kilogram; the last row of a time counts, and only then rows without a price are dropped."""
    d = require(read_csv(spark, path), [f"{c}_usd_per_kg" for c in PRICES])
    volume = number(F.col("volume_source_units")) if "volume_source_units" in d.columns else F.lit(0.0)
    d = d.select(F.lit(series).alias("series"), F.col("timestamp_utc").try_cast("timestamp").alias("ts"), *[number(F.col(f"{c}_usd_per_kg")).alias(c) for c in PRICES], F.coalesce(volume, F.lit(0.0)).alias("volume"), "seq")
    return keep_last(d.dropna(subset=["ts"])).drop("seq").dropna(subset=list(PRICES))


def hourly_bars(spark: SparkSession, path, series: str) -> DataFrame:
    d = require(read_csv(spark, path), ("timestamp_utc", *PRICES, "volume", "minute_count"))
    d = d.select(F.lit(series).alias("series"), F.col("timestamp_utc").try_cast("timestamp").alias("ts"), *[number(F.col(c)).alias(c) for c in (*PRICES, "volume")], F.col("minute_count").try_cast("long").alias("minute_count"), "seq")
    return keep_last(d.dropna(subset=["ts"])).drop("seq").dropna(subset=list(PRICES))


def context_bars(spark: SparkSession, path, series: str) -> DataFrame:
    d = require(read_csv(spark, path), ("timestamp_utc", "close"))
    d = d.select(F.lit(series).alias("series"), F.col("timestamp_utc").try_cast("timestamp").alias("ts"), number(F.col("close")).alias("close"), "seq")
    d = keep_last(d.dropna(subset=["ts"])).drop("seq").dropna(subset=["close"])
    if d.isEmpty():
        raise ValueError(f"{series}: no rows with a close")
    return d


def normalise(raw: DataFrame, metal: str, symbol: str, source: str, side: str = "BID") -> DataFrame:
    """The 12 normalised columns from tagged raw rows (timestamp ms and price texts)."""
    ms = epoch_ms(F.col("timestamp").try_cast("double"))
    return raw.select(
        iso_seconds(ms).alias("timestamp_utc"), ms.alias("timestamp_ms"), *[usd_per_kg_exact(F.col(c)).alias(f"{c}_usd_per_kg") for c in PRICES],
        F.col("volume").cast("string").alias("volume_source_units"), F.lit(metal).alias("metal"), F.lit(symbol).alias("source_symbol"), F.lit(source).alias("source"), F.lit(side).alias("price_side"), F.lit("USD/kg").alias("price_unit"),
    ).dropna(subset=[f"{c}_usd_per_kg" for c in PRICES])


RECORD = np.dtype([("sec", ">i4"), ("open", ">i4"), ("close", ">i4"), ("low", ">i4"), ("high", ">i4"), ("volume", ">f4")])


def decode_day(payload: bytes, day: date, factor: float = 1000.0) -> pd.DataFrame:
    """One day's packed minute records. A single bad record fails the day."""
    raw = lzma.decompress(payload) if payload else b""
    if len(raw) % RECORD.itemsize:
        raise ValueError(f"{day}: {len(raw)} bytes are no whole records")
    x = np.frombuffer(raw, RECORD)
    out = pd.DataFrame({c: x[c].astype("float64") / factor for c in PRICES})
    out.insert(0, "ms", pd.Timestamp(day, tz="UTC").value // 1_000_000 + x["sec"].astype("int64") * 1000)
    out["volume"] = x["volume"].astype("float64") * 1e6
    good = bool(((x["sec"] >= 0) & (x["sec"] < 86_400)).all() and np.isfinite(out[[*PRICES, "volume"]].to_numpy()).all())
    good = good and bool(((out.low <= out.high) & out.open.between(out.low, out.high) & out.close.between(out.low, out.high)).all())
    if not good:
        raise ValueError(f"{day}: a record is out of range")
    return out


DAY = r"(\d{4}-\d{2}-\d{2})[^/]*$"


def day_files(spark: SparkSession, path: str, start: date | None = None, end: date | None = None) -> list[str]:
    """The files YYYY-MM-DD.* of a folder or glob whose day lies in [start, end), by their names alone."""
    at, fs = file_system(spark, path)
    found = []
    for f in fs.globStatus(at) or []:
        found += [g.getPath().toString() for g in fs.listStatus(f.getPath())] if f.isDirectory() else [f.getPath().toString()]
    days = {f: m[1] for f in found if (m := re.search(DAY, f))}
    return sorted(f for f, day in days.items() if (start is None or day >= start.isoformat()) and (end is None or day < end.isoformat()))


def packed_days(spark: SparkSession, path: str, series: str, factor: float = 1000.0, start: date | None = None, end: date | None = None) -> DataFrame:
    """Minute bars of daily files named YYYY-MM-DD.*, one file at a time; a bad day gives one row with its reason in error.

    With start or end only the files of days in [start, end) are opened.
    """

    def decode(batches):
        for pdf in batches:
            for name, content in zip(pdf["day"], pdf["content"], strict=True):
                try:
                    yield decode_day(content, date.fromisoformat(name), factor).assign(error=None, series=series)
                except (ValueError, lzma.LZMAError) as e:
                    yield pd.DataFrame({"ms": [None], **{c: [None] for c in (*PRICES, "volume")}, "error": [str(e)], "series": [series]})

    bounded = start is not None or end is not None
    files = day_files(spark, path, start, end) if bounded else [path]
    read = spark.read.format("binaryFile").load(files) if files else spark.createDataFrame([], "path string, content binary")
    d = read.select(F.regexp_extract("path", DAY, 1).alias("day"), "content")
    return d.mapInPandas(decode, "ms long, open double, high double, low double, close double, volume double, error string, series string")


def archive_lines(content: bytes, name: str, chunk: int = 50_000):
    """(row, line) frames of all .csv members of an archive in the order of their names; without one, or if it is broken, an error."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            members = sorted(i.filename for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(".csv"))
            if not members:
                raise ValueError(f"{name}: no .csv in the archive")
            at, held = 0, []
            for member in members:
                with z.open(member) as f:
                    for raw in f:
                        held.append(raw.decode("utf-8", "replace").lstrip("\ufeff").rstrip("\r\n"))
                        if len(held) == chunk:
                            yield pd.DataFrame({"row": range(at, at + chunk), "line": held})
                            at, held = at + chunk, []
            yield pd.DataFrame({"row": range(at, at + len(held)), "line": held})
    except (zipfile.BadZipFile, EOFError) as e:
        raise ValueError(f"{name}: {e}") from e


def zipped_rows(spark: SparkSession, path: str, series: str, start_ms: int | None = None, end_ms: int | None = None, broken: str = "fail") -> DataFrame:
    """Rows 'yyyyMMdd HHmmss;o;h;l;c;v' of zipped files, in fixed UTC-5; times strictly increase across archives.

    Rows of fewer than six fields, with an unreadable time, price or volume, or with inconsistent prices are skipped; a blank volume is zero. An archive
    that is broken or holds no .csv ends the job, or is left out with broken="skip".
    """

    def lines(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for frame in archive_lines(content, name):
                        yield frame.assign(file=name)
                except ValueError:
                    if broken == "fail":
                        raise

    d = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "file string, row long, line string")
    part = F.split("line", ";")
    volume = F.when(F.trim(F.get(part, 5)) == "", 0.0).otherwise(number(F.get(part, 5)))
    d = d.where(F.size(part) >= 6).select(
        F.lit(series).alias("series"), "file", F.struct("file", "row").alias("seq"), F.unix_millis(fixed_offset_utc(F.get(part, 0))).alias("ms"), *[number(F.get(part, k + 1)).alias(c) for k, c in enumerate(PRICES)], volume.alias("volume"),
    )
    good = F.col("ms").isNotNull() & F.col("volume").isNotNull() & ohlc_valid(*[F.col(c) for c in PRICES])
    return tag_rows(d.where(good), start_ms=start_ms, end_ms=end_ms, block="file").where(F.col("tag") == "written").drop("tag", "seq", "file")


def routed(readers: dict, wanted: dict) -> DataFrame:
    """The rows of all wanted series (series -> path), each from its own reader (series -> reader of a path); an unknown series is an error."""
    unknown = sorted(set(wanted) - set(readers))
    if unknown:
        raise ValueError(f"no source for {', '.join(unknown)}")
    return reduce(DataFrame.unionByName, [readers[k](path, k) for k, path in wanted.items()])


def coverage(df: DataFrame, start=None, by=("series",)) -> DataFrame:
    """Per series the first and last time from start on, the rows and the days that have any."""
    d = df if start is None else df.where(F.col("ts") >= F.lit(start))
    return d.groupBy(*by).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("rows"), F.countDistinct(F.to_date("ts")).alias("days"))


#: A landed file counts from so many bytes on; an .empty file beside says that there is nothing to land.
LEAST_BYTES = 100


def pending(spark: SparkSession, planned: DataFrame, folder: str) -> DataFrame:
    """The planned chunks (name, ...) of which folder holds neither a file name.* of more than LEAST_BYTES nor name.empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(f.getPath().getName(), f.getLen()) for f in fs.listStatus(path)] if fs.exists(path) else []
    done = sorted({(name.rsplit(".", 1)[0],) for name, size in files if size > LEAST_BYTES or name.endswith(".empty")})
    return planned.join(spark.createDataFrame(done, "name string"), "name", "left_anti")


def year_chunks(bounds: DataFrame) -> DataFrame:
    """(chunk_start, chunk_end) of the calendar years that [a, b), two dates, reaches into, cut to it."""
    d = bounds.where(F.col("a") < F.col("b")).select("a", "b", F.explode(F.sequence(F.trunc("a", "year"), F.date_sub("b", 1), F.make_ym_interval(F.lit(1)))).alias("y"))
    return d.select(F.greatest("a", "y").alias("chunk_start"), F.least("b", F.add_months("y", 12)).alias("chunk_end"))


def newest_file(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return d.select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).limit(1)


def champions(spark: SparkSession, path: str) -> DataFrame:
    """One row per horizon of a champion manifest."""
    kind = "schema_version int, metal string, champions map<string, struct<active_strategy: string, selected_challenger: string, metrics: map<string, double>>>"
    d = spark.read.schema(kind).json(path, multiLine=True)
    return d.select("metal", "schema_version", F.explode("champions").alias("horizon", "champion")).select("metal", "schema_version", F.col("horizon").cast("int").alias("horizon_hours"), "champion.*")


def order_book_midpoint(xml: Column, security: str, currency: str = "USD") -> Column:
    """(best bid + best ask) / 2 of one security in an order book document; null where a side is missing, not positive, or crossed."""
    at = f'//pitch[@securityId="{security}" and @considerationCurrency="{currency}"]'
    bid, ask = (finite(F.xpath_double(xml, F.lit(f"{at}/{side}/price[1]/@limit"))) for side in ("buyPrices", "sellPrices"))
    return F.when((bid > 0) & (ask >= bid), (bid + ask) / 2)


def verified_bundle(parts: DataFrame, sha256: str) -> bytes:
    """The bytes of a bundle whose checksum is as expected; an error otherwise."""
    found = joined_bundle(parts).first()
    if found is None or found["content"] is None or not hmac.compare_digest(found["sha256"], sha256.strip().lower()):
        raise ValueError("the bundle's checksum is not the expected one")
    return bytes(found["content"])


def joined_bundle(parts: DataFrame) -> DataFrame:
    """Bytes and checksum of a bundle split into base64 parts (name, part)."""
    d = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "part"))), lambda p: F.regexp_replace(p["part"], r"\s", "")), "").alias("text"))
    return d.select(F.try_to_binary("text", F.lit("base64")).alias("content")).withColumn("sha256", F.sha2("content", 256))


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def set_aside(spark: SparkSession, target: str) -> list[str]:
    """What stood in the place of target before and wasn't removed yet, oldest first."""
    at, fs = file_system(spark, target)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.before-*")) or []
    return [f.getPath().toString() for f in sorted(found, key=lambda f: f.getModificationTime())]


def standing(spark: SparkSession, target: str) -> str:
    """Where the table of target is: in its place, or set aside where a writer was lost between the two steps of a replacement."""
    at, fs = file_system(spark, target)
    return target if fs.exists(at) else (set_aside(spark, target) or [target])[-1]


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Puts a written folder in the place of another. At every moment standing() finds the old or the new one, whole: the old is set aside, not
    deleted, until the new has its place.
    """
    target = target.rstrip("/")
    a, _ = file_system(spark, source)
    b, fs = file_system(spark, target)
    before = None
    if fs.exists(b):
        before, _ = file_system(spark, f"{target}.before-{uuid.uuid4().hex}")
        if not fs.rename(b, before):
            raise OSError(f"{target} can't be set aside")
    elif b.getParent() is not None:
        fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        if before is not None:
            fs.rename(before, b)
        raise OSError(f"{target} can't be written")
    for old in set_aside(spark, target):
        fs.delete(file_system(spark, old)[0], True)


def read_table(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A table of write_table(), wherever it stands."""
    return spark.read.format(form).options(**({"header": "true"} if form == "csv" else {})).load(standing(spark, path))


def write_table(df: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = ("series",)) -> int:
    """Writes and returns the rows written, in one pass. They appear as a whole once all are written; no rows are an error and leave path as it was.

    read_table() finds the old or the new rows at any moment.
    """
    spark, seen, part = df.sparkSession, Observation(), f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    options = {"header": "true"} if form == "csv" else {}
    df.observe(seen, F.count("*").alias("n")).write.partitionBy(*[c for c in by if c in df.columns]).format(form).options(**options).save(part)
    n = seen.get["n"]
    if not n:
        left = spark._jvm.org.apache.hadoop.fs.Path(part)
        left.getFileSystem(spark._jsc.hadoopConfiguration()).delete(left, True)
        raise ValueError("nothing to write")
    moved(spark, part, path)
    return n


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
