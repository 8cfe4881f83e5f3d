"""Prediction rows, readiness, quotes and request counters."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quartzline.functions.exprs import HORIZONS, direction, percent_change
from quartzline.operators.windows import streamed
from quartzline.session import written


def latest_complete(df: DataFrame, columns: list[str], by=("series",), ts: str = "ts") -> DataFrame:
    """The last row of each series in which all columns are there."""
    return df.dropna(subset=columns).groupBy(*by).agg(F.max_by(F.struct(*[c for c in df.columns if c not in by]), ts).alias("r")).select(*by, "r.*")


def prediction_rows(latest: DataFrame, models: DataFrame, by=("series",)) -> DataFrame:
    """Point forecast, 80% interval and change for each latest row and model (horizon_hours, predicted_return, residual_q10, residual_q90)."""
    d = latest.join(models, list(by))
    price = lambda r: F.col("close") * F.exp(r)
    r = F.coalesce("predicted_return", F.lit(0.0))
    d = d.select(
        *by, "ts", "horizon_hours", F.col("close").alias("current_price"), price(r).alias("predicted_price"),
        price(r + F.col("residual_q10")).alias("lower_80"), price(r + F.col("residual_q90")).alias("upper_80"),
        (F.col("ts") + F.make_interval(hours=F.col("horizon_hours"))).alias("target_time"),
    )
    d = d.withColumn("change_percent", percent_change(F.col("predicted_price"), F.col("current_price")))
    return d.withColumn("direction", direction(F.col("change_percent")))


def missing_models(required: DataFrame, horizons: DataFrame, available: DataFrame) -> DataFrame:
    """metal:horizon pairs that should exist but don't. The horizons, a few, go as one array to each metal."""
    every = [r[0] for r in horizons.select("horizon_hours").distinct().collect()]
    want = required.select("series", F.explode(F.array(*[F.lit(h) for h in sorted(every)])).alias("horizon_hours"))
    return want.join(available, ["series", "horizon_hours"], "left_anti").select(F.concat_ws(":", "series", F.col("horizon_hours").cast("string")).alias("missing"))


def midpoint(quotes: DataFrame) -> DataFrame:
    """(bid + ask) / 2 where both are positive and not crossed."""
    good = (F.col("bid") > 0) & (F.col("ask") >= F.col("bid"))
    return quotes.where(good).withColumn("price", (F.col("bid") + F.col("ask")) / 2)


def fresh_quote(quotes: DataFrame, now, ttl_seconds: int = 60, stale_seconds: int = 86_400) -> DataFrame:
    """Per series the quote to serve: the last fresh one of the best provider, else the last one that isn't too stale.

    quotes: (series, ts, price, source, priority).
    """
    age = F.unix_micros(now) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    d = quotes.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") <= stale_seconds))
    rank = F.struct((F.col("age") > ttl_seconds).cast("int"), F.when(F.col("age") <= ttl_seconds, F.col("priority")).otherwise(0), "age")
    return d.groupBy("series").agg(F.min_by(F.struct("ts", "price", "source", (F.col("age") > ttl_seconds).alias("stale")), rank).alias("q")).select("series", "q.*")


def exposition(requests: DataFrame, name: str = "http_requests_total") -> DataFrame:
    """Counter lines in the order of method, path and status."""
    d = requests.groupBy("method", "path", "status").agg(F.count("*").alias("requests")).orderBy("method", "path", "status")
    return d.select(F.format_string(name + '{method="%s",path="%s",status="%s"} %d', "method", "path", "status", "requests").alias("line"))


def models_by_metal(registry: DataFrame) -> DataFrame:
    return registry.groupBy("series").agg(F.sort_array(F.collect_set("horizon_hours")).alias("horizons"))


def newest(df: DataFrame, n: int = 6, by=("series",), ts: str = "ts") -> DataFrame:
    """The newest n rows of each series, newest first; the cut is made before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(ts))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def error_sample(df: DataFrame, n: int = 5, order: str = "ts") -> DataFrame:
    """The first n rows that carry an error."""
    return df.where(F.col("error").isNotNull()).orderBy(order).limit(n)


def session_quote(minutes: DataFrame, today, lookback_days: int = 4) -> DataFrame:
    """Per series the last close of the latest day before today that has one, at most lookback_days back."""
    if lookback_days < 2:
        raise ValueError("lookback_days must be at least 2")
    day = F.to_date("ts")
    d = minutes.where((day < F.lit(today)) & (day >= F.date_sub(F.lit(today), lookback_days)) & F.col("close").isNotNull())
    return d.groupBy("series").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("price"))


#: Times that a breaker stays shut which make up a block of failures.
BLOCK_SPANS = 16
#: Up to so many spans with a shut breaker are broadcast to the requests; beyond, these are shuffled.
BROADCAST_SPANS = 100_000


def shutting(failed: DataFrame, width: int) -> DataFrame:
    """The failures that shut a breaker: of each key the first, then again and again the first that is at least width later.

    failed: (key, us, ...), one row for each key and us. Time is cut into blocks. From any failure of a block, the ones after it follow without a look at
    what came before, so each block finds on its own until when the breaker is shut if it is entered at a failure. Only the failures at which
    it can be entered, those of its first width and the next one, go through one task a key to find where it is entered. A task holds the failures of one width of one key.
    """
    long, yes = T.StructField("until", T.LongType()), T.StructField("shuts", T.BooleanType())
    d = failed.withColumn("block", F.expr(f"us div {BLOCK_SPANS * width} - int(us % {BLOCK_SPANS * width} < 0)"))

    def last_of(later: deque, row: dict) -> list:
        """later: (us, until) of the failures after this one, nearest first, up to the first that is width later."""
        while len(later) > 1 and later[-2][0] >= row["us"] + width:
            later.pop()
        until = later[-1][1] if later and later[-1][0] >= row["us"] + width else row["us"] + width
        later.appendleft((row["us"], until))
        return [until]

    def enters(state: dict, row: dict) -> list:
        if row["block"] == state.get("block") or row["us"] < state.get("until", row["us"]):
            return [False]
        state.update(block=row["block"], until=row["until"])
        return [True]

    def shuts(state: dict, row: dict) -> list:
        if row["us"] < state.get("until", row["enter"]):
            return [False]
        state["until"] = row["us"] + width
        return [True]

    last_of.reads, enters.reads, shuts.reads = ["us"], ["block", "us", "until"], ["us", "enter"]
    ends = written(streamed(d.select("key", "block", "us"), ["key", "block"], [F.desc("us")], deque, last_of, T.StructType([long])), "breaker-ends")
    early = F.col("us") < F.col("block") * (BLOCK_SPANS * width) + width
    rest = ends.where(~early).groupBy("key", "block").agg(F.min_by(F.struct("us", "until"), "us").alias("x")).select("key", "block", "x.*")
    doors = streamed(ends.where(early).unionByName(rest), ["key"], ["us"], dict, enters, T.StructType([yes]))
    doors = written(doors.where("shuts").select("key", "block", F.col("us").alias("enter")), "breaker-doors")
    out = streamed(d.join(doors, ["key", "block"]), ["key", "block"], ["us"], dict, shuts, T.StructType([yes]))
    return out.where("shuts").select(*failed.columns)


def through_breakers(requests: DataFrame, seconds: float = 60.0, key: str = "service") -> DataFrame:
    """Adds provider, the position of the one that answered each request, and tried, the number of providers called.

    requests: key, us (microseconds), id, answers (array of booleans, what each provider would say, in the order of calls). A provider that fails isn't
    called for so many seconds; the first that answers ends the request. A provider sees the requests that those before it left, and only its own failures
    shut it, so providers are gone through one by one: the failures that shut one are found by shutting(), the requests while it is shut by a join with them.
    A request without a time comes while nothing is shut and shuts nothing. Requests of one key, time and id may come in any order.
    """
    width = int(seconds * 1_000_000)
    d = written(requests.withColumn("__row", F.monotonically_increasing_id()), "breaker-requests")
    d = d.withColumns({"__key": F.struct(F.col(key)), "__at": F.col("us").cast("long"), "provider": F.lit(None).cast("int"), "tried": F.lit(0)})
    place = F.struct("id", "__row")
    for k in range(d.agg(F.max(F.size("answers"))).first()[0] or 0):
        asked = F.col("provider").isNull() & F.coalesce(F.size("answers") > k, F.lit(False))
        good = F.coalesce(F.get("answers", F.lit(k)), F.lit(False))
        shut = F.lit(False)
        if width > 0:
            failed = d.where(asked & ~good & F.col("__at").isNotNull()).groupBy(F.col("__key").alias("key"), F.col("__at").alias("us")).agg(F.min(place).alias("first"))
            spans = written(shutting(failed, width), "breaker-spans")
            slot = lambda us: F.floor(us / F.lit(width)).cast("long")
            by = spans.select(F.col("key").alias("__key"), F.explode(F.array(slot(F.col("us")), slot(F.col("us")) + 1)).alias("__slot"), F.struct("us", "first").alias("x"))
            by = by.groupBy("__key", "__slot").agg(F.collect_list("x").alias("__spans"))
            held = lambda x: (F.col("__at") < x["us"] + width) & ((F.col("__at") > x["us"]) | ((F.col("__at") == x["us"]) & (place > x["first"])))  # noqa: B023, E731
            d = d.withColumn("__slot", slot(F.col("__at"))).join(F.broadcast(by) if spans.count() <= BROADCAST_SPANS else by, ["__key", "__slot"], "left")
            shut = F.coalesce(F.exists("__spans", held), F.lit(False))
        d = d.withColumns({"__called": asked & ~shut, "__good": good})
        d = d.withColumns({"tried": F.col("tried") + F.col("__called").cast("int"), "provider": F.when(F.col("__called") & F.col("__good"), k).otherwise(F.col("provider"))})
        d = d.drop("__slot", "__spans", "__called", "__good")
    return d.select(*requests.columns, "provider", "tried")


# The columns of a request and of a prediction, and the metals that may be asked for.
METALS = ("gold", "silver", "palladium", "platinum")
REQUEST = "metal string, horizon_hours int"
PREDICTION = (
    "metal string, timestamp_utc string, target_timestamp_utc string, horizon_hours int, active_strategy string, selected_challenger string, current_usd_per_kg double, predicted_usd_per_kg double, prediction_interval_80_low_usd_per_kg double, "
    "prediction_interval_80_high_usd_per_kg double, predicted_change_pct double, validation_mae_usd_per_kg double, validation_directional_accuracy_pct double, validation_improvement_vs_persistence_pct double, interval_note string"
)


def checked_requests(requests: DataFrame) -> DataFrame:
    """Adds error to (metal, horizon_hours): what is wrong with a request, null where nothing is."""
    metal = F.coalesce(F.col("metal").isin(*METALS), F.lit(False))
    return requests.withColumn(
        "error",
        F.when(~metal, F.concat(F.lit("metal must be one of "), F.lit(", ".join(METALS)))).when(F.coalesce(F.col("horizon_hours"), F.lit(0)) < 1, "horizon_hours must be at least 1").when(~F.col("horizon_hours").isin(*HORIZONS), F.format_string("horizon %dh is not supported", "horizon_hours")),
    )
