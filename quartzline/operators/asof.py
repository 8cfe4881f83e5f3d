"""As-of joins, elapsed-time returns and forecast targets; cross-market columns built from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzline.functions.exprs import micros, ratio
from quartzline.operators.windows import HOUR_US, zscore_over
from quartzline.session import written

# Horizons of cross-market returns and windows of their z-scores, in hours; the gap a target may have.
RETURN_HOURS = (1, 4, 24, 72, 168)
ZSCORE_HOURS = (24, 168)
TOLERANCE_HOURS = 72


def backward_asof(left: DataFrame, right: DataFrame, columns: list[str], time_column: str, ts: str = "ts", by: list[str] | None = None) -> DataFrame:
    """left with the columns of right's last row at or before its ts, and that row's ts as time_column.

    Both sides go through one sort by time within each day, and a small table of one row a day carries the last row of earlier
    days on: no pair of rows is ever compared and no task sorts more than a day of one key. Rows of right come first at equal times.
    """
    keys = [*(by or []), "__day"]
    packed = F.struct(*columns, F.col(ts).alias(time_column))
    day = F.date_trunc("day", F.col(ts)).alias("__day")
    a = left.select(*(by or []), ts, day, F.struct(*left.columns).alias("__l"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("__r"))
    b = right.select(*(by or []), ts, day, F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.lit(0).alias("__side"), packed.alias("__r"))
    both = a.unionByName(b)
    days = both.groupBy(*keys).agg(F.max_by("__r", F.when(F.col("__side") == 0, F.col(ts))).alias("__last"))
    earlier = Window.partitionBy(*(by or [])).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    w = Window.partitionBy(*keys).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    d = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where(F.col("__side") == 1)
    d = d.join(days, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]), "left")
    return d.select("__l.*", F.coalesce("__r", "__carried").alias("__r")).select(*left.columns, "__r.*")


def elapsed_lag(x: str, hours: int) -> Column:
    """The last value at least so many hours ago."""
    w = Window.partitionBy("series").orderBy(micros(F.col("ts"))).rangeBetween(Window.unboundedPreceding, -hours * HOUR_US)
    return F.last(x, ignorenulls=True).over(w)


def elapsed_log_return(x: str, hours: int) -> Column:
    return F.ln(x) - F.ln(elapsed_lag(x, hours))


#: Hours of a span of a series; no window reaches further.
SPAN_HOURS = 2880


def spanned(df: DataFrame, back: int, ahead: int) -> DataFrame:
    """Adds __span, a stretch of time, and __edge. Rows within back hours before a span or ahead hours after it are in that one too, marked so.

    Windows of elapsed time then run by span, so that no task holds a series; rows with __edge are to be dropped at the end. Rows of a null ts stay, in
    a span of their own.
    """
    if max(back, ahead) > SPAN_HOURS:
        raise ValueError(f"windows of more than {SPAN_HOURS} hours")
    us, width = micros(F.col("ts")), SPAN_HOURS * HOUR_US
    own = F.floor(us / F.lit(width))
    after, before = F.when(us >= (own + 1) * width - back * HOUR_US, own + 1), F.when(us < own * width + ahead * HOUR_US, own - 1)
    d = df.select(*df.columns, own.alias("__own"), F.explode_outer(F.array_compact(F.array(own, after, before))).alias("__span"))
    return d.withColumn("__edge", F.coalesce(F.col("__own") != F.col("__span"), F.lit(False))).drop("__own")


def carried(df: DataFrame, x: str, back: int) -> DataFrame:
    """(series, __span, __carried): the last value of x earlier than back hours before each span; tables of one row a span."""
    us, width = micros(F.col("ts")), SPAN_HOURS * HOUR_US
    last = df.where(F.col(x).isNotNull()).groupBy("series", (F.floor((us + back * HOUR_US) / F.lit(width)) + 1).alias("__span")).agg(F.max_by(x, us).alias("__carried")).withColumn("__side", F.lit(0))
    spans = df.select("series", F.floor(us / F.lit(width)).alias("__span"), F.lit(None).cast("double").alias("__carried"), F.lit(1).alias("__side")).distinct()
    w = Window.partitionBy("series").orderBy("__span", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return last.unionByName(spans).withColumn("__carried", F.last("__carried", ignorenulls=True).over(w)).where(F.col("__side") == 1).drop("__side")


def with_elapsed(df: DataFrame, x: str, returns: dict[str, int], scores: dict[str, int] | None = None) -> DataFrame:
    """Adds log returns of x over elapsed hours (name -> hours) and z-scores over the last so many hours, by span."""
    back = max([*returns.values(), *(scores or {}).values()])
    df = written(df, "elapsed")  # read twice below; unwritten, a chain of markets would double its plan at every step
    d = spanned(df, back, 0).join(carried(df, x, back), ["series", "__span"], "left")
    w = Window.partitionBy("series", "__span").orderBy(micros(F.col("ts")))
    old = lambda h: F.coalesce(F.last(x, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -h * HOUR_US)), F.col("__carried"))
    d = d.withColumns({name: F.ln(x) - F.ln(old(h)) for name, h in returns.items()} | {name: zscore_over(w.rangeBetween(-(h * HOUR_US - 1), 0), x, h) for name, h in (scores or {}).items()})
    return d.where(~F.col("__edge")).drop("__span", "__edge", "__carried")


def with_target(df: DataFrame, h: int, tolerance: int = TOLERANCE_HOURS) -> DataFrame:
    """Adds future_close, target_timestamp and target (log return) for h hours: the first close at or after ts + h, at most tolerance hours late."""
    w = Window.partitionBy("series", "__span").orderBy(micros(F.col("ts"))).rangeBetween(h * HOUR_US, (h + tolerance) * HOUR_US)
    d = spanned(df, 0, h + tolerance).withColumn("__f", F.first(F.when(F.col("close").isNotNull(), F.struct("ts", "close")), ignorenulls=True).over(w))
    d = d.where(~F.col("__edge")).drop("__span", "__edge").withColumns({f"future_close_{h}h": F.col("__f.close"), f"target_timestamp_{h}h": F.col("__f.ts")})
    return d.withColumn(f"target_{h}h", F.ln(f"future_close_{h}h") - F.ln("close")).drop("__f")


def context_columns(source: DataFrame, name: str, close: str) -> DataFrame:
    """ts and the source's own columns on its own clock: close, elapsed returns and z-scores."""
    d = source.where(F.col("close").isNotNull()).select("series", "ts", F.col("close").alias(close))
    return with_elapsed(d, close, {f"{name}_log_return_{h}h": h for h in RETURN_HOURS}, {f"{name}_close_zscore_{h}h": h for h in ZSCORE_HOURS}).drop("series")


def aligned(target: DataFrame, source: DataFrame, name: str, close: str) -> DataFrame:
    """target with the columns of one source series as of each row, their age in hours, and the target's own elapsed returns as __r{h}."""
    right = context_columns(source, name, close)
    d = backward_asof(target, right, [c for c in right.columns if c != "ts"], "__at")
    d = d.withColumn(f"{name}_source_age_hours", (micros(F.col("ts")) - micros(F.col("__at"))) / F.lit(float(HOUR_US))).drop("__at")
    return with_elapsed(d, "close", {f"__r{h}": h for h in RETURN_HOURS})


def with_context(target: DataFrame, source: DataFrame, name: str, close: str | None = None) -> DataFrame:
    """target with a context market: as-of aligned columns, their age in hours, and the spread of returns."""
    d = aligned(target, source, name, close or f"{name}_close")
    return d.withColumns({f"silver_minus_{name}_return_{h}h": F.col(f"__r{h}") - F.col(f"{name}_log_return_{h}h") for h in RETURN_HOURS}).drop(*[f"__r{h}" for h in RETURN_HOURS])


def with_gold(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """The gold provider: aligned columns first, then the gold to silver ratio on silver's clock."""
    close = "gold_close_usd_per_kg"
    d = aligned(silver, gold, "gold", close).withColumn("gold_silver_ratio", ratio(F.col(close), F.col("close")))
    d = d.withColumns({f"gold_minus_silver_return_{h}h": F.col(f"gold_log_return_{h}h") - F.col(f"__r{h}") for h in RETURN_HOURS}).drop(*[f"__r{h}" for h in RETURN_HOURS])
    return with_elapsed(d, "gold_silver_ratio", {f"gold_silver_ratio_log_return_{h}h": h for h in RETURN_HOURS}, {f"gold_silver_ratio_zscore_{h}h": h for h in ZSCORE_HOURS})


@dataclass(frozen=True)
class Provider:
    """A context market whose columns are added to a target series, aligned backward; no later quote is ever used."""

    name: str
    series: str
    symbol: str
    unit: str
    augment: Callable[[DataFrame, DataFrame], DataFrame]  # of this market alone; with_providers() takes all at once

    def metadata(self) -> dict:
        return {"name": self.name, "source_symbol": self.symbol, "source_unit": self.unit, "alignment": "backward_asof", "future_quotes_allowed": False}


def with_usd_index(silver: DataFrame, index: DataFrame) -> DataFrame:
    d = with_context(silver, index, "udx")
    return d.withColumns({f"usd_pressure_{h}h": -F.col(f"udx_log_return_{h}h") for h in RETURN_HOURS})


# The context markets by name.
PROVIDERS = {
    p.name: p
    for p in (
        Provider("gold_silver", "gold", "XAU/USD", "usd_per_kg", with_gold),
        Provider("usd_index", "udx", "UDX/USD", "index_points", with_usd_index),
        Provider("spx", "spx", "SPX/USD", "index_points", lambda target, source: with_context(target, source, "spx")),
        Provider("wti", "wti", "WTI/USD", "usd_per_barrel", lambda target, source: with_context(target, source, "wti")),
    )
}


def backward_asof_many(left: DataFrame, right: DataFrame, key: str, values: list[str], ts: str = "ts") -> DataFrame:
    """left with a struct for each value of key in right: its last row at or before ts, or null.

    All of them go through one sort by time within each day; a table of one row a day carries each value's last row of earlier days on.
    """
    names = [c for c in right.columns if c != key]
    row = F.struct(*names)
    kind = right.select(row.alias("r")).schema["r"].dataType
    day = F.date_trunc("day", F.col(ts)).alias("__day")
    a = left.select(F.col(ts).alias("__ts"), day, F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast("string").alias("__k"), F.lit(None).cast(kind).alias("__r"))
    b = right.where(F.col(ts).isNotNull()).select(F.col(ts).alias("__ts"), day, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.col(key).alias("__k"), row.alias("__r"))
    of = lambda v: F.when(F.col("__k") == v, F.col("__r"))
    days = a.select("__day", "__ts", "__k", "__r").unionByName(b.select("__day", "__ts", "__k", "__r")).groupBy("__day").agg(*[F.max_by("__r", F.when(F.col("__k") == v, F.col("__ts"))).alias(f"__d{i}") for i, v in enumerate(values)])
    earlier = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = days.select(F.col("__day").alias("__on"), *[F.last(f"__d{i}", ignorenulls=True).over(earlier).alias(f"__c{i}") for i in range(len(values))])
    w = Window.partitionBy("__day").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    d = a.unionByName(b).withColumns({f"__m{i}": F.last(of(v), ignorenulls=True).over(w) for i, v in enumerate(values)}).where(F.col("__side") == 1)
    d = d.join(days, F.col("__day").eqNullSafe(F.col("__on")), "left")
    return d.select("__l.*", *[F.coalesce(f"__m{i}", f"__c{i}").alias(v) for i, v in enumerate(values)])


def market_columns(series: str, m: str) -> dict[str, Column]:
    """What a context market adds to a row that has its last row as the struct m, and the target's own elapsed returns as __r{h}."""
    age = (micros(F.col("ts")) - micros(F.col(f"{m}.ts"))) / F.lit(float(HOUR_US))
    gold = series == "gold"
    out = {"gold_close_usd_per_kg" if gold else f"{series}_close": F.col(f"{m}.close")} | {f"{series}_log_return_{h}h": F.col(f"{m}.r{h}") for h in RETURN_HOURS}
    out |= {f"{series}_close_zscore_{h}h": F.col(f"{m}.z{h}") for h in ZSCORE_HOURS} | {f"{series}_source_age_hours": age}
    if gold:
        return out | {"gold_silver_ratio": ratio(F.col(f"{m}.close"), F.col("close"))} | {f"gold_minus_silver_return_{h}h": F.col(f"{m}.r{h}") - F.col(f"__r{h}") for h in RETURN_HOURS}
    out |= {f"silver_minus_{series}_return_{h}h": F.col(f"__r{h}") - F.col(f"{m}.r{h}") for h in RETURN_HOURS}
    return out | ({f"usd_pressure_{h}h": -F.col(f"{m}.r{h}") for h in RETURN_HOURS} if series == "udx" else {})


def with_providers(target: DataFrame, bars: DataFrame, names) -> DataFrame:
    """target, one series, with the columns of all named context markets, whose bars come from one table of all series. An unknown name, or a market
    without a bar, is an error.

    Elapsed returns and scores of the target and of all markets are one pass by span, the as-of joins of all markets one sort by day; only the
    windows of the gold ratio, which exists after them, are another pass.
    """
    names = list(names)
    for name in names:
        if name not in PROVIDERS:
            raise ValueError(f"unknown context market {name}")
    if not names:
        return target
    markets = {PROVIDERS[name].series: f"__{name}" for name in names}
    closes = bars.where(F.col("series").isin(*markets) & F.col("close").isNotNull()).select(F.col("series").alias("__of"), "ts", "close")
    there = {r["__of"] for r in closes.select("__of").distinct().collect()}
    for name in names:
        if PROVIDERS[name].series not in there:
            raise ValueError(f"{name} needs hourly bars of {PROVIDERS[name].series}")
    own = target.select(F.lit(None).cast("string").alias("__of"), "ts", F.col("close").cast("double").alias("close"), F.struct(*target.columns).alias("__row"))
    both = own.unionByName(closes, allowMissingColumns=True).withColumn("series", F.coalesce("__of", F.lit("")))
    d = written(with_elapsed(both, "close", {f"r{h}": h for h in RETURN_HOURS}, {f"z{h}": h for h in ZSCORE_HOURS}), "markets")
    left = d.where(F.col("__of").isNull()).select("__row", "ts", *[F.col(f"r{h}").alias(f"__r{h}") for h in RETURN_HOURS])
    right = d.where(F.col("__of").isNotNull()).select("__of", "ts", "close", *[f"r{h}" for h in RETURN_HOURS], *[f"z{h}" for h in ZSCORE_HOURS])
    d = backward_asof_many(left, right.withColumn("__of", F.concat(F.lit("__"), "__of")), "__of", [f"__{s}" for s in markets])
    d = d.select("__row.*", *[f"__r{h}" for h in RETURN_HOURS], *[f"__{s}" for s in markets])
    added = {s: market_columns(s, f"__{s}") for s in markets}
    d = d.select(*target.columns, *[x.alias(k) for columns in added.values() for k, x in columns.items()])
    order = [*target.columns]
    ratios = {f"gold_silver_ratio_log_return_{h}h": h for h in RETURN_HOURS}
    scores = {f"gold_silver_ratio_zscore_{h}h": h for h in ZSCORE_HOURS}
    for s, columns in added.items():
        order += [*columns, *(ratios if s == "gold" else ()), *(scores if s == "gold" else ())]
    return (with_elapsed(d, "gold_silver_ratio", ratios, scores) if "gold" in added else d).select(*order)
