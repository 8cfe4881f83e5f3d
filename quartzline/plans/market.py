"""Registered queries over market data and the SQL they are held against.

Views: events are ticks (event type to series, value to price); lineitem gives daily bars by return flag. Times are epoch seconds and
measures are rounded to six places, so that both engines print the same.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzline.functions import exprs as X
from quartzline.operators import asof, bars, evaluation, features, serving, training, windows
from quartzline.session import shared_dir, table, written
from quartzline.sources import market as sources
from quartzline.streaming import features as growing

SERIES = {"purchase": "silver", "view": "gold", "click": "udx", "signup": "spx", "error": "wti"}


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    name = F.lit(None).cast("string")
    for kind, series in SERIES.items():
        name = F.when(F.col("event_type") == kind, series).otherwise(name)
    d = table(spark, sf_dir, "events").select(name.alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))
    return d.where(F.col("series").isNotNull())


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.resample(ticks(spark, sf_dir), o="price", h="price", low="price", c="price", volume=None)


def seconds(ts: str = "ts", name: str = "ts_s") -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp")).alias(name)


def rounded(df: DataFrame, columns, keys=("series",)) -> DataFrame:
    return df.select(*keys, seconds(), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in columns])


TICKS = "ticks AS (SELECT CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SERIES.items()) + " END AS series, ts, event_id AS seq, value AS price FROM events WHERE event_type IN (" + ", ".join(f"'{k}'" for k in SERIES) + "))"
BARS = TICKS + ", bars AS (SELECT series, date_trunc('hour', ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, count(price)::DOUBLE AS volume, count(price) AS minute_count FROM ticks GROUP BY 1, 2)"
W = "PARTITION BY series ORDER BY ts"


def over(n: int) -> str:
    return f"OVER ({W} ROWS {n - 1} PRECEDING)"


def sql_round(pairs: dict[str, str], keys: str = "series, epoch(ts)::BIGINT AS ts_s") -> str:
    return keys + ", " + ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in pairs.items())


def q_hourly_bars(spark, sf_dir):
    return rounded(hourly(spark, sf_dir), bars.BAR)


S_HOURLY_BARS = f"WITH {BARS} SELECT {sql_round({c: c for c in bars.BAR})} FROM bars"


def q_daily_bars(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), F.struct(*keys).alias("k"))
    return bars.resample(d, "1 day", o="price", h="price", low="price", c="price", volume="volume", order=F.struct("ts", "k")).select("series", seconds(), *bars.BAR)


S_DAILY_BARS = """
WITH t AS (SELECT l_returnflag AS series, date_trunc('day', l_shipdate) AS ts, l_extendedprice / l_quantity AS price, l_quantity AS volume,
  row_number() OVER (PARTITION BY l_returnflag, date_trunc('day', l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
bars AS (SELECT series, ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(volume) AS volume, count(*) AS minute_count FROM t GROUP BY 1, 2)
SELECT series, epoch(ts)::BIGINT AS ts_s, open, high, low, close, volume, minute_count FROM bars"""


ROLLED = ["ret_1h", *[f"log_return_{n}h" for n in features.LAGS], *[f"{k}_{n}h" for n in features.WINDOWS for k in ("sma_ratio", "close_zscore", "volatility", "range_ratio", "range_position")], "stochastic_k_14", "stochastic_d_3", "bollinger_position_20", "bollinger_width_20", "candle_body_pct", "high_low_pct", "upper_wick_pct", "lower_wick_pct", "log_volume", "volume_zscore_24h", "volume_zscore_168h", "minute_coverage", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]


def q_rolling_features(spark, sf_dir):
    return rounded(features.rolling_features(hourly(spark, sf_dir)), ROLLED)


def full(expr: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} >= {n} THEN {expr} END"


def zscore(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} < {n} THEN NULL WHEN stddev_samp({x}) {over(n)} = 0 THEN 0.0 ELSE ({x} - avg({x}) {over(n)}) / stddev_samp({x}) {over(n)} END"


def rolling_sql(bars: str = BARS) -> str:
    p = {"ret_1h": "ret_1h"} | {f"log_return_{n}h": f"lnc - lag(lnc, {n}) OVER ({W})" for n in features.LAGS}
    for n in features.WINDOWS:
        top, bottom = full(f"max(high) {over(n)}", "high", n), full(f"min(low) {over(n)}", "low", n)
        p |= {
            f"sma_ratio_{n}h": f"close / nullif({full(f'avg(close) {over(n)}', 'close', n)}, 0) - 1",
            f"close_zscore_{n}h": zscore("close", n),
            f"volatility_{n}h": full(f"stddev_samp(ret_1h) {over(n)}", "ret_1h", n),
            f"range_ratio_{n}h": f"({top}) / nullif(({bottom}), 0) - 1",
            f"range_position_{n}h": f"(close - ({bottom})) / nullif(({top}) - ({bottom}), 0)",
        }
    lo, hi = full(f"min(low) {over(14)}", "low", 14), full(f"max(high) {over(14)}", "high", 14)
    m, s = full(f"avg(close) {over(20)}", "close", 20), full(f"stddev_samp(close) {over(20)}", "close", 20)
    p |= {
        "stochastic_k_14": f"(close - ({lo})) / nullif(({hi}) - ({lo}), 0)",
        "bollinger_position_20": f"(close - (({m}) - 2 * ({s}))) / nullif(4 * ({s}), 0)",
        "bollinger_width_20": f"4 * ({s}) / nullif(({m}), 0)",
        "candle_body_pct": "(close - open) / nullif(open, 0)",
        "high_low_pct": "(high - low) / nullif(open, 0)",
        "upper_wick_pct": "(high - greatest(open, close)) / nullif(open, 0)",
        "lower_wick_pct": "(least(open, close) - low) / nullif(open, 0)",
        "log_volume": "lv",
        "volume_zscore_24h": zscore("lv", 24),
        "volume_zscore_168h": zscore("lv", 168),
        "minute_coverage": "minute_count / 60.0",
        "hour_sin": "sin(hour(ts) * (2 * pi() / 24))",
        "hour_cos": "cos(hour(ts) * (2 * pi() / 24))",
        "dow_sin": "sin((isodow(ts) - 1) * (2 * pi() / 7))",
        "dow_cos": "cos((isodow(ts) - 1) * (2 * pi() / 7))",
    }
    d3 = f"round((CASE WHEN count(k14) {over(3)} >= 3 THEN avg(k14) {over(3)} END)::DOUBLE, 6) AS stochastic_d_3"
    inner = ", ".join(f"{v} AS {k}" for k, v in p.items())
    outer = ", ".join(f"round({k}::DOUBLE, 6) AS {k}" for k in p)
    return (
        f"WITH {bars}, a AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS lnc, ln(1 + greatest(volume, 0)) AS lv FROM bars), b AS (SELECT *, lnc - lag(lnc) OVER ({W}) AS ret_1h FROM a), "
        f"c AS (SELECT series, ts, {inner} FROM b), d AS (SELECT *, stochastic_k_14 AS k14 FROM c) SELECT series, epoch(ts)::BIGINT AS ts_s, {outer}, {d3} FROM d"
    )


BAD_TICKS = [c for c in ROLLED if c.startswith(("ret_", "log_return", "sma_ratio", "close_zscore", "volatility", "bollinger", "log_volume", "volume_zscore"))]
#: Every so many hours, from an hour on, a bar has such a close or volume.
PLANTED = {"close": ((97, 13, float("nan")), (193, 50, float("inf")), (211, 7, 1e9)), "volume": ((151, 20, float("nan")),)}


def q_bad_tick_features(spark, sf_dir):
    """Rolling features of bars among which some closes are NaN, infinite or a million times too high, and some volumes NaN."""
    d, hour = hourly(spark, sf_dir), F.floor(F.unix_seconds("ts") / 3600)
    for column, bad in PLANTED.items():
        for every, at, value in bad:
            d = d.withColumn(column, F.when(hour % every == at, F.lit(value)).otherwise(F.col(column)))
    return rounded(features.rolling_features(d), BAD_TICKS)


def bad_tick_sql() -> str:
    """NaN and infinity count as missing, so here they are null."""
    of = lambda column: f"CASE {' '.join(f'WHEN (epoch(ts) // 3600)::BIGINT % {every} = {at} THEN {value if value == 1e9 else "NULL"}' for every, at, value in reversed(PLANTED[column]))} ELSE {column} END AS {column}"
    planted = BARS.replace(" bars AS ", " plain AS ") + f", bars AS (SELECT series, ts, open, high, low, minute_count, {of('close')}, {of('volume')} FROM plain)"
    return f"SELECT series, ts_s, {', '.join(BAD_TICKS)} FROM ({rolling_sql(planted)})"


SMOOTHED = ["ema12_ratio", "ema26_ratio", "ema50_ratio", "ema200_ratio", "ema50_200_spread", "macd_pct", "macd_signal_pct", "macd_hist_pct", "rsi_14", "atr_14_pct", "adx_14", "plus_di_14", "minus_di_14", "di_spread_14"]


def q_exponential_features(spark, sf_dir):
    return rounded(features.exponential_features(hourly(spark, sf_dir)), SMOOTHED)


def exponential_sql() -> str:
    ema = lambda n, y: f"{y} + (x.close - {y}) * 2.0 / {n + 1}"
    wilder = lambda y, v: f"coalesce({y} * 13.0 / 14 + {v} / 14.0, {v})"
    return f"""
WITH RECURSIVE {BARS}, l AS (
  SELECT *, row_number() OVER ({W}) AS rn, close - lag(close) OVER ({W}) AS d, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn, lag(close) OVER ({W}) AS pc FROM bars
), x AS (
  SELECT series, ts, rn, close, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS g, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS s,
    greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS m FROM l
), r AS (
  SELECT series, rn, close AS e12, close AS e26, close AS e50, close AS e200, 0.0::DOUBLE AS sig, NULL::DOUBLE AS g, NULL::DOUBLE AS s, tr AS tr, p::DOUBLE AS p, m::DOUBLE AS m FROM x WHERE rn = 1
  UNION ALL
  SELECT x.series, x.rn, {ema(12, 'r.e12')}, {ema(26, 'r.e26')}, {ema(50, 'r.e50')}, {ema(200, 'r.e200')},
    r.sig * 0.8 + 0.2 * (({ema(12, 'r.e12')}) - ({ema(26, 'r.e26')})), {wilder('r.g', 'x.g')}, {wilder('r.s', 'x.s')}, {wilder('r.tr', 'x.tr')}, {wilder('r.p', 'x.p')}, {wilder('r.m', 'x.m')}
  FROM r JOIN x ON x.series = r.series AND x.rn = r.rn + 1
), i AS (
  SELECT x.series, x.ts, x.rn, x.close, e12, e26, e50, e200, sig, CASE WHEN x.rn >= 15 THEN r.g END AS g, CASE WHEN x.rn >= 15 THEN r.s END AS s, CASE WHEN x.rn >= 14 THEN r.tr END AS atr,
    CASE WHEN x.rn >= 14 THEN 100 * r.p / nullif(r.tr, 0) END AS plus, CASE WHEN x.rn >= 14 THEN 100 * r.m / nullif(r.tr, 0) END AS minus FROM x JOIN r ON r.series = x.series AND r.rn = x.rn
), j AS (SELECT *, 100 * abs(plus - minus) / nullif(plus + minus, 0) AS dx FROM i),
k AS (
  SELECT series, rn, dx AS adx FROM j WHERE rn = 14
  UNION ALL
  SELECT j.series, j.rn, k.adx * 13.0 / 14 + j.dx / 14.0 FROM k JOIN j ON j.series = k.series AND j.rn = k.rn + 1
)
SELECT j.series, epoch(ts)::BIGINT AS ts_s, """ + ", ".join(
        f"round(({v})::DOUBLE, 6) AS {n}"
        for n, v in {
            "ema12_ratio": "close / nullif(e12, 0) - 1", "ema26_ratio": "close / nullif(e26, 0) - 1", "ema50_ratio": "close / nullif(e50, 0) - 1", "ema200_ratio": "close / nullif(e200, 0) - 1", "ema50_200_spread": "e50 / nullif(e200, 0) - 1",
            "macd_pct": "(e12 - e26) / nullif(close, 0)", "macd_signal_pct": "sig / nullif(close, 0)", "macd_hist_pct": "(e12 - e26 - sig) / nullif(close, 0)", "rsi_14": "(100 - 100 / (1 + g / nullif(s, 0))) / 100", "atr_14_pct": "atr / nullif(close, 0)",
            "adx_14": "CASE WHEN j.rn >= 27 THEN adx / 100 END", "plus_di_14": "plus / 100", "minus_di_14": "minus / 100", "di_spread_14": "(plus - minus) / 100",
        }.items()
    ) + " FROM j LEFT JOIN k ON k.series = j.series AND k.rn = j.rn"


def q_hourly_features(spark, sf_dir):
    d = features.build_features(hourly(spark, sf_dir))
    return rounded(d, features.feature_columns(d))


def q_appended_features(spark, sf_dir):
    """The catalogue computed in two appends, up to the last day and that day: the rows of hourly_features."""
    b = written(hourly(spark, sf_dir), "bars")
    root, end = f"{shared_dir(spark)}/appended-{uuid.uuid4().hex}", b.agg(F.date_trunc("day", F.max("ts")).alias("end"))
    last = written(b.join(F.broadcast(end)).select(*b.columns, (F.col("ts") >= F.col("end")).alias("last")), "last")
    for part in ("NOT last", "last"):
        growing.append(last.where(part).drop("last"), root)
    d = growing.appended(spark, root)
    d = features.build_features(b) if d is None else d
    return rounded(d, features.feature_columns(d))


CONTEXT = ["udx_close", *[f"udx_log_return_{h}h" for h in asof.RETURN_HOURS], *[f"udx_close_zscore_{h}h" for h in asof.ZSCORE_HOURS], "udx_source_age_hours", *[f"silver_minus_udx_return_{h}h" for h in asof.RETURN_HOURS], *[f"usd_pressure_{h}h" for h in asof.RETURN_HOURS]]


def one(df: DataFrame, series: str) -> DataFrame:
    return df.where(F.col("series") == series)


def q_usd_context(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return rounded(asof.with_usd_index(one(b, "silver"), one(b, "udx")), CONTEXT)


def elapsed_return_sql(source: str, h: int, x: str = "close") -> str:
    """One as-of join per horizon, as the plain definition has it."""
    return f"SELECT a.ts, CASE WHEN a.{x} > 0 THEN ln(a.{x}) END - CASE WHEN b.{x} > 0 THEN ln(b.{x}) END AS r FROM {source} a ASOF LEFT JOIN {source} b ON a.ts - INTERVAL {h} HOURS >= b.ts"


def elapsed_z_sql(h: int, x: str = "close") -> str:
    w = f"OVER (ORDER BY ts RANGE BETWEEN INTERVAL {h * 3600 * 1000000 - 1} MICROSECONDS PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} < {max(4, min(24, h // 2))} THEN NULL WHEN stddev_samp({x}) {w} = 0 THEN 0.0 ELSE ({x} - avg({x}) {w}) / stddev_samp({x}) {w} END"


def source_sql(name: str) -> str:
    """CTEs s and u (bars of silver and of a context market), s{h} and u{h} (their elapsed returns), and v (the market with its own columns)."""
    hs = asof.RETURN_HOURS
    parts = ["s AS (SELECT ts, close FROM bars WHERE series = 'silver')", f"u AS (SELECT ts, close FROM bars WHERE series = '{name}')"]
    parts += [f"u{h} AS ({elapsed_return_sql('u', h)}), s{h} AS ({elapsed_return_sql('s', h)})" for h in hs]
    returns, scores = ", ".join(f"u{h}.r AS r{h}" for h in hs), ", ".join(f"{elapsed_z_sql(h)} AS z{h}" for h in asof.ZSCORE_HOURS)
    parts.append(f"v AS (SELECT u.ts AS at, close, {returns}, {scores} FROM (SELECT *, ts AS t FROM u) u " + " ".join(f"JOIN (SELECT ts AS t{h}, r FROM u{h}) u{h} ON u{h}.t{h} = u.t" for h in hs) + ")")
    return ", ".join(parts)


def context_sql(name: str = "udx", pressure: bool = True) -> str:
    hs = asof.RETURN_HOURS
    cols = {f"{name}_close": "v.close"} | {f"{name}_log_return_{h}h": f"v.r{h}" for h in hs} | {f"{name}_close_zscore_{h}h": f"v.z{h}" for h in asof.ZSCORE_HOURS} | {f"{name}_source_age_hours": "epoch(s.ts - v.at) / 3600"}
    cols |= {f"silver_minus_{name}_return_{h}h": f"s{h}.r - v.r{h}" for h in hs}
    if pressure:
        cols |= {f"usd_pressure_{h}h": f"-v.r{h}" for h in hs}
    return f"WITH {BARS}, {source_sql(name)} SELECT {sql_round(cols, chr(39) + 'silver' + chr(39) + ' AS series, epoch(s.ts)::BIGINT AS ts_s')} FROM s ASOF LEFT JOIN v ON s.ts >= v.at " + " ".join(f"JOIN s{h} ON s{h}.ts = s.ts" for h in hs)


def context_query(name: str):
    columns = [c.replace("udx", name) for c in CONTEXT if not c.startswith("usd_pressure")]

    def query(spark, sf_dir):
        b = written(hourly(spark, sf_dir), "bars")
        return rounded(asof.with_providers(one(b, "silver"), b, [name]), columns)

    return query


GOLD_ALL = ["gold_close_usd_per_kg", *[f"gold_log_return_{h}h" for h in asof.RETURN_HOURS], *[f"gold_close_zscore_{h}h" for h in asof.ZSCORE_HOURS], "gold_source_age_hours", "gold_silver_ratio", *[f"gold_silver_ratio_zscore_{h}h" for h in asof.ZSCORE_HOURS], *[f"gold_silver_ratio_log_return_{h}h" for h in asof.RETURN_HOURS], *[f"gold_minus_silver_return_{h}h" for h in asof.RETURN_HOURS]]


def q_gold_context(spark, sf_dir):
    b = written(hourly(spark, sf_dir), "bars")
    return rounded(asof.with_providers(one(b, "silver"), b, ["gold_silver"]), GOLD_ALL)


def gold_sql() -> str:
    hs, zs = asof.RETURN_HOURS, asof.ZSCORE_HOURS
    joined = "j AS (SELECT s.ts, v.close AS g, epoch(s.ts - v.at) / 3600 AS age, v.close / nullif(s.close, 0) AS q, " + ", ".join([f"v.r{h}" for h in hs] + [f"v.z{h}" for h in zs]) + " FROM s ASOF LEFT JOIN v ON s.ts >= v.at), k AS (SELECT ts, q FROM j WHERE q IS NOT NULL)"
    ratios = ", ".join(f"k{h} AS ({elapsed_return_sql('k', h, 'q')})" for h in hs)
    scored_j = "w AS (SELECT *, " + ", ".join(f"{elapsed_z_sql(h, 'q')} AS q{h}" for h in zs) + " FROM j)"
    cols = {"gold_close_usd_per_kg": "w.g"} | {f"gold_log_return_{h}h": f"w.r{h}" for h in hs} | {f"gold_close_zscore_{h}h": f"w.z{h}" for h in zs} | {"gold_source_age_hours": "w.age", "gold_silver_ratio": "w.q"}
    cols |= {f"gold_silver_ratio_zscore_{h}h": f"w.q{h}" for h in zs} | {f"gold_silver_ratio_log_return_{h}h": f"k{h}.r" for h in hs} | {f"gold_minus_silver_return_{h}h": f"w.r{h} - s{h}.r" for h in hs}
    return f"WITH {BARS}, {source_sql('gold')}, {joined}, {ratios}, {scored_j} SELECT {sql_round(cols, chr(39) + 'silver' + chr(39) + ' AS series, epoch(w.ts)::BIGINT AS ts_s')} FROM w " + " ".join(f"LEFT JOIN k{h} ON k{h}.ts = w.ts JOIN s{h} ON s{h}.ts = w.ts" for h in hs)


GOLD = ["gold_close_usd_per_kg", "gold_source_age_hours", "gold_silver_ratio", *[f"gold_silver_ratio_zscore_{h}h" for h in asof.ZSCORE_HOURS]]


def q_gold_ratio(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return rounded(asof.with_gold(one(b, "silver"), one(b, "gold")), GOLD)


S_GOLD_RATIO = (
    f"WITH {BARS}, s AS (SELECT s.ts, g.close AS g, epoch(s.ts - g.ts) / 3600 AS age, g.close / nullif(s.close, 0) AS close FROM (SELECT * FROM bars WHERE series = 'silver') s ASOF LEFT JOIN (SELECT * FROM bars WHERE series = 'gold') g ON s.ts >= g.ts) "
    "SELECT " + sql_round({"gold_close_usd_per_kg": "g", "gold_source_age_hours": "age", "gold_silver_ratio": "close"} | {f"gold_silver_ratio_zscore_{h}h": elapsed_z_sql(h) for h in asof.ZSCORE_HOURS}, "'silver' AS series, epoch(ts)::BIGINT AS ts_s") + " FROM s"
)


def q_targets(spark, sf_dir):
    d = hourly(spark, sf_dir)
    for h in (2, 24):
        d = asof.with_target(d, h)
    cols = [f"{k}_{h}h" for h in (2, 24) for k in ("future_close", "target")]
    return d.select("series", seconds(), *[F.round(c, 6).alias(c) for c in cols], *[seconds(f"target_timestamp_{h}h", f"target_s_{h}h") for h in (2, 24)])


def target_join(h: int, alias: str) -> str:
    return f"ASOF LEFT JOIN bars {alias} ON {alias}.series = b.series AND b.ts + INTERVAL {h} HOURS <= {alias}.ts"


def within(h: int, alias: str, x: str) -> str:
    return f"CASE WHEN {alias}.ts <= b.ts + INTERVAL {h + asof.TOLERANCE_HOURS} HOURS THEN {x} END"


S_TARGETS = f"WITH {BARS} SELECT b.series, epoch(b.ts)::BIGINT AS ts_s, " + ", ".join(
    f"round({within(h, a, a + '.close')}, 6) AS future_close_{h}h, round({within(h, a, f'CASE WHEN {a}.close > 0 THEN ln({a}.close) END - CASE WHEN b.close > 0 THEN ln(b.close) END')}, 6) AS target_{h}h, epoch({within(h, a, a + '.ts')})::BIGINT AS target_s_{h}h" for h, a in ((2, "x"), (24, "y"))
) + f" FROM bars b {target_join(2, 'x')} {target_join(24, 'y')}"


def prepared(spark, sf_dir, h: int = 24) -> DataFrame:
    d = asof.with_target(hourly(spark, sf_dir), h)
    return d.where(F.col("close") > 0).dropna(subset=[f"target_{h}h"])


PREPARED = f"{BARS}, prepared AS (SELECT b.series, b.ts, b.close, {within(24, 'y', 'y.close')} AS future, {within(24, 'y', 'y.ts')} AS tts FROM bars b {target_join(24, 'y')} WHERE b.close > 0), p AS (SELECT *, ln(future) - ln(close) AS target, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY series) AS n FROM prepared WHERE future > 0)"


def metric_sql(a: str, p: str, c: str) -> str:
    pairs = {
        "mae": f"avg(abs({a} - {p}))", "rmse": f"sqrt(avg(({a} - {p}) * ({a} - {p})))", "smape_percent": f"coalesce(avg(CASE WHEN abs({a}) + abs({p}) > 0 THEN 2 * abs({p} - {a}) / (abs({a}) + abs({p})) END), 0) * 100",
        "directional_accuracy_percent": f"avg((sign({a} - {c}) = sign({p} - {c}))::INT::DOUBLE) * 100", "persistence_mae": f"avg(abs({a} - {c}))",
        "improvement_percent": f"coalesce((avg(abs({a} - {c})) - avg(abs({a} - {p}))) / nullif(avg(abs({a} - {c})), 0) * 100, 0)", "residual_q10": f"quantile_cont(ln({a}) - ln({p}), 0.1)", "residual_q90": f"quantile_cont(ln({a}) - ln({p}), 0.9)",
    }
    return "count(*) AS rows_validated, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in pairs.items())


def scored(d: DataFrame, predicted: str, by: list[str]) -> DataFrame:
    m = evaluation.scores(d, by, "future_close_24h", predicted, "close")
    return m.select(*by, "rows_validated", *[F.round(c, 6).alias(c) for c in m.columns if c not in (*by, "rows_validated")])


def positive(d: DataFrame) -> DataFrame:
    return d.where(F.col("future_close_24h") > 0)


def q_walk_forward(spark, sf_dir):
    return scored(evaluation.walk_forward_median(positive(prepared(spark, sf_dir)), 24, 5), "predicted", ["series"])


FOLDED = "f AS (SELECT *, floor(n / 6) AS size, CASE WHEN rn >= n - 5 * floor(n / 6) THEN floor((rn - (n - 5 * floor(n / 6))) / floor(n / 6)) + 1 ELSE 0 END AS fold FROM p), st AS (SELECT series, fold, min(ts) AS start FROM f WHERE fold > 0 GROUP BY 1, 2)"
S_WALK_FORWARD = f"WITH {PREPARED}, {FOLDED}, fit AS (SELECT st.series, st.fold, median(target) AS m FROM st JOIN f ON f.series = st.series AND f.fold < st.fold AND f.tts < st.start GROUP BY 1, 2), o AS (SELECT f.*, f.close * exp(m) AS predicted FROM f JOIN fit ON fit.series = f.series AND fit.fold = f.fold) SELECT series, {metric_sql('future', 'predicted', 'close')} FROM o GROUP BY series"


def q_folds(spark, sf_dir):
    d = evaluation.with_fold(evaluation.numbered(positive(prepared(spark, sf_dir))), 5)
    return d.groupBy("series", "fold").agg(F.count("*").alias("rows"), seconds_of(F.min("ts")).alias("first_s"), seconds_of(F.max("ts")).alias("last_s"))


def seconds_of(x: Column) -> Column:
    return F.unix_seconds(x)


S_FOLDS = f"WITH {PREPARED}, {FOLDED} SELECT series, fold::INT AS fold, count(*) AS rows, epoch(min(ts))::BIGINT AS first_s, epoch(max(ts))::BIGINT AS last_s FROM f GROUP BY 1, 2"


def q_holdout_persistence(spark, sf_dir):
    d = evaluation.with_holdout(evaluation.numbered(positive(prepared(spark, sf_dir))))
    return scored(d.where(~F.col("development")).withColumn("p", F.col("close")), "p", ["series"])


S_HOLDOUT = f"WITH {PREPARED} SELECT series, {metric_sql('future', 'close', 'close')} FROM p WHERE rn >= floor(n * 0.8::DOUBLE) GROUP BY series"


def momentum(d: DataFrame) -> DataFrame:
    """A plain challenger: the return of the row before, damped."""
    return d.withColumn("raw", F.coalesce(0.1 * (F.ln("close") - F.ln(F.lag("close").over(windows.by_time()))), F.lit(0.0)))


def q_selective_grid(spark, sf_dir):
    d = evaluation.selective_grid(momentum(positive(prepared(spark, sf_dir))), target="target_24h")
    return d.select("series", F.round("persistence_mae", 6).alias("persistence_mae"), F.round("best_mae", 6).alias("best_mae"), "quantile", "shrinkage")


def grid_sql() -> str:
    grid = "(VALUES " + ", ".join(f"({q}::DOUBLE, {s}::DOUBLE, {i * len(evaluation.SHRINKAGES) + j})" for i, q in enumerate(evaluation.QUANTILES) for j, s in enumerate(evaluation.SHRINKAGES)) + ") AS g(q, s, k)"
    th = " UNION ALL ".join(f"SELECT series, {q}::DOUBLE AS q, quantile_cont(abs(raw), {q}) AS t FROM m GROUP BY series" for q in evaluation.QUANTILES)
    return (
        f"WITH {PREPARED}, m AS (SELECT *, coalesce(0.1 * (ln(close) - ln(lag(close) OVER ({W}))), 0) AS raw FROM p), th AS ({th}), "
        f"e AS (SELECT m.series, g.q, g.s, g.k, avg(abs(close * exp(target) - close * exp(CASE WHEN abs(raw) >= t THEN raw * g.s ELSE 0 END))) AS mae FROM {grid} JOIN th ON th.q = g.q JOIN m ON m.series = th.series GROUP BY ALL "
        "UNION ALL SELECT series, NULL, NULL, -1, avg(abs(close * exp(target) - close)) FROM m GROUP BY series), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mae, k) AS o, max(CASE WHEN k = -1 THEN mae END) OVER (PARTITION BY series) AS base FROM e) "
        "SELECT series, round(base, 6) AS persistence_mae, round(mae, 6) AS best_mae, q AS quantile, s AS shrinkage FROM r WHERE o = 1"
    )


def q_champions(spark, sf_dir):
    d = evaluation.with_holdout(evaluation.numbered(positive(prepared(spark, sf_dir))))
    start = d.where(~F.col("development")).groupBy("series").agg(F.min("ts").alias("start"))
    med = d.where("development").join(start, "series").where(F.col("target_timestamp_24h") < F.col("start")).groupBy("series").agg(F.median("target_24h").alias("m"))
    d = momentum(d).join(med, "series")
    score = lambda p, rows: (lambda base, mae: X.ratio(base - mae, base) * 100)(F.avg(F.when(rows, F.abs(F.col("future_close_24h") - F.col("close")))), F.avg(F.when(rows, F.abs(F.col("future_close_24h") - p))))
    parts = []
    for k, (name, r) in enumerate({"median": F.col("m"), "momentum": F.col("raw")}.items()):
        p, dev = F.col("close") * F.exp(r), F.col("development")
        parts.append(d.groupBy("series").agg(F.lit(name).alias("name"), F.lit(k).alias("position"), F.avg(F.when(dev, F.abs(F.col("future_close_24h") - p))).alias("dev_mae"), score(p, dev).alias("dev_improvement"), score(p, ~dev).alias("holdout_improvement")))
    return evaluation.champion(parts[0].unionByName(parts[1]))


S_CHAMPIONS = f"""WITH {PREPARED}, d AS (SELECT *, rn < floor(n * 0.8::DOUBLE) AS dev, coalesce(0.1 * (ln(close) - ln(lag(close) OVER ({W}))), 0) AS raw FROM p),
st AS (SELECT series, min(ts) AS start FROM d WHERE NOT dev GROUP BY 1), md AS (SELECT d.series, median(target) AS m FROM d JOIN st ON st.series = d.series WHERE dev AND tts < start GROUP BY 1),
c AS (SELECT d.*, m FROM d JOIN md ON md.series = d.series),
u AS (SELECT series, dev, future, close, 'median' AS name, 0 AS position, close * exp(m) AS q FROM c UNION ALL SELECT series, dev, future, close, 'momentum', 1, close * exp(raw) FROM c),
s AS (SELECT series, name, position, avg(abs(future - q)) FILTER (WHERE dev) AS dev_mae,
  (avg(abs(future - close)) FILTER (WHERE dev) - avg(abs(future - q)) FILTER (WHERE dev)) / avg(abs(future - close)) FILTER (WHERE dev) * 100 AS di,
  (avg(abs(future - close)) FILTER (WHERE NOT dev) - avg(abs(future - q)) FILTER (WHERE NOT dev)) / avg(abs(future - close)) FILTER (WHERE NOT dev) * 100 AS hi FROM u GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dev_mae, position) AS o FROM s)
SELECT series, name AS selected, di >= 0.5 AS dev_gate, hi >= 0.5 AS holdout_gate, CASE WHEN di >= 0.5 AND hi >= 0.5 THEN name ELSE 'persistence' END AS active FROM b WHERE o = 1"""


def q_predictions(spark, sf_dir):
    latest = serving.latest_complete(hourly(spark, sf_dir).where(F.col("close") > 0).select("series", "ts", "close"), ["close"])
    models = spark.createDataFrame([(s, h, 0.001 * h, -0.01, 0.01) for s in sorted(SERIES.values()) for h in (2, 24)], "series string, horizon_hours int, predicted_return double, residual_q10 double, residual_q90 double")
    d = serving.prediction_rows(latest, models)
    return d.select("series", seconds(), "horizon_hours", *[F.round(c, 6).alias(c) for c in ("current_price", "predicted_price", "lower_80", "upper_80", "change_percent")], "direction", seconds("target_time", "target_s"))


S_PREDICTIONS = f"""WITH {BARS}, l AS (SELECT series, max(ts) AS ts, arg_max(close, ts) AS close FROM bars WHERE close > 0 GROUP BY 1), h AS (SELECT unnest([2, 24])::INT AS h)
SELECT series, epoch(ts)::BIGINT AS ts_s, h AS horizon_hours, round(close, 6) AS current_price, round(close * exp(0.001 * h), 6) AS predicted_price, round(close * exp(0.001 * h - 0.01), 6) AS lower_80, round(close * exp(0.001 * h + 0.01), 6) AS upper_80,
  round((exp(0.001 * h) - 1) * 100, 6) AS change_percent, 'up' AS direction, epoch(ts)::BIGINT + h * 3600 AS target_s FROM l, h"""


def q_tag_report(spark, sf_dir):
    """Ticks as minute bars in arrival order by price, so that late and bad rows occur."""
    t = ticks(spark, sf_dir)
    bad = F.col("seq") % 7 == 0
    d = t.select("series", F.col("seq").alias("id"), F.unix_millis("ts").alias("ms"), F.col("price").alias("open"), (F.col("price") + F.when(bad, -1).otherwise(1)).alias("high"), (F.col("price") - 1).alias("low"), F.col("price").alias("close"), F.struct((F.col("seq") - 40 * (F.col("seq") % 5)).alias("a"), "seq").alias("seq"))
    return bars.tag_report(bars.tag_rows(d.withColumn("block", F.floor(F.col("seq.a") / 5000)), block="block"))


S_TAG_REPORT = f"""WITH {TICKS}, d AS (SELECT series, epoch_us(ts) // 1000 AS ms, seq % 7 <> 0 AS ok, row_number() OVER (PARTITION BY series ORDER BY seq - 40 * (seq % 5), seq) AS o FROM ticks),
m AS (SELECT *, max(CASE WHEN ok THEN ms END) OVER (PARTITION BY series ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
t AS (SELECT *, CASE WHEN ms <= before THEN 'duplicate' WHEN NOT ok THEN 'malformed' ELSE 'written' END AS tag FROM m)
SELECT series, count(*) FILTER (WHERE tag = 'written') AS rows_written, count(*) FILTER (WHERE tag = 'duplicate') AS duplicates, count(*) FILTER (WHERE tag = 'malformed') AS malformed,
  min(ms) FILTER (WHERE tag = 'written') AS first_ms, max(ms) FILTER (WHERE tag = 'written') AS last_ms, count(DISTINCT make_timestamp(ms * 1000)::DATE) FILTER (WHERE tag = 'written') AS days_with_data FROM t GROUP BY series"""


def q_keep_last(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    return bars.keep_last(t.select("series", "ts", "seq", "price")).select("series", seconds(), "seq", F.round("price", 6).alias("price"))


S_KEEP_LAST = f"WITH {TICKS} SELECT series, epoch(date_trunc('hour', ts))::BIGINT AS ts_s, max(seq) AS seq, round(arg_max(price, seq), 6) AS price FROM ticks GROUP BY 1, 2"


def q_unit_conversion(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.col("o_totalprice").cast("decimal(16,2)").cast("string")
    return o.select("o_orderkey", X.usd_per_kg_exact(text).cast("string").alias("usd_per_kg"), X.horizon_label((F.col("o_orderkey") % 720).cast("int")).alias("label"), X.direction(X.percent_change(F.col("o_totalprice"), F.lit(150000.0))).alias("direction"))


S_UNIT_CONVERSION = """SELECT o_orderkey, CASE WHEN o_totalprice::DECIMAL(16, 2) > 0 THEN round_even(o_totalprice::DECIMAL(9, 2)::DECIMAL(12, 2) * 32.150746568627980523::DECIMAL(20, 18), 6)::DECIMAL(20, 6)::VARCHAR END AS usd_per_kg,
  CASE WHEN o_orderkey % 720 < 168 THEN (o_orderkey % 720) || 'h' ELSE ((o_orderkey % 720) // 24) || 'd' END AS label,
  CASE WHEN abs((o_totalprice / 150000 - 1) * 100) < 0.005 THEN 'neutral' WHEN o_totalprice > 150000 THEN 'up' ELSE 'down' END AS direction FROM orders"""


def requests(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.when(F.col("event_type") == "purchase", "POST").otherwise("GET").alias("method"), F.concat(F.lit("/"), "event_type").alias("path"), F.when(F.col("value") > 50, "200").otherwise("429").alias("status"))


def q_exposition(spark, sf_dir):
    return serving.exposition(requests(spark, sf_dir))


S_EXPOSITION = """SELECT 'http_requests_total{method="' || m || '",path="' || p || '",status="' || s || '"} ' || n AS line FROM (SELECT CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS m, '/' || event_type AS p, CASE WHEN value > 50 THEN '200' ELSE '429' END AS s, count(*) AS n FROM events GROUP BY ALL)"""


def q_missing_models(spark, sf_dir):
    seen = hourly(spark, sf_dir).groupBy("series").agg(F.count("*").alias("n")).select("series", F.explode(F.sequence(F.lit(2), F.lit(12), F.lit(2))).alias("horizon_hours"))
    need = spark.createDataFrame([(s,) for s in ("gold", "palladium", "silver")], "series string")
    return serving.missing_models(need, spark.createDataFrame([(h,) for h in X.HORIZONS], "horizon_hours int"), seen)


S_MISSING = f"WITH {TICKS} SELECT s || ':' || h AS missing FROM (SELECT unnest(['gold', 'palladium', 'silver']) AS s), (SELECT unnest([2, 4, 8, 12, 24, 72, 168, 360, 720]) AS h) WHERE NOT (s IN (SELECT series FROM ticks) AND h IN (2, 4, 6, 8, 10, 12))"


def q_fresh_quotes(spark, sf_dir):
    t = ticks(spark, sf_dir)
    now = t.agg(F.max("ts")).first()[0]
    q = t.select("series", "ts", "price", F.when(F.col("seq") % 2 == 0, "book").otherwise("bars").alias("source"), (F.col("seq") % 2).cast("int").alias("priority"))
    d = serving.fresh_quote(q, F.lit(now), ttl_seconds=7200)
    return d.select("series", seconds(), F.round("price", 6).alias("price"), "source", "stale")


S_FRESH = f"""WITH {TICKS}, n AS (SELECT max(ts) AS now FROM ticks), a AS (SELECT t.*, epoch(now - ts) AS age FROM ticks t, n), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY (age > 7200)::INT, CASE WHEN age <= 7200 THEN seq % 2 ELSE 0 END, age) AS o FROM a WHERE age BETWEEN 0 AND 86400)
SELECT series, epoch_us(ts) // 1000000 AS ts_s, round(price, 6) AS price, CASE WHEN seq % 2 = 0 THEN 'book' ELSE 'bars' END AS source, age > 7200 AS stale FROM r WHERE o = 1"""


def q_rate_limit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("string").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"))
    return windows.rate_limited(e, 3, 7200).groupBy("client").agg(F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"))


#: The greedy rule as a recursion over each client's requests, with the accepted times of the window as a list.
S_RATE_LIMIT = """WITH RECURSIVE e AS (SELECT (user_id % 20)::VARCHAR AS client, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS rn FROM events), r AS (
  SELECT client, rn, [us] AS held, true AS allowed FROM e WHERE rn = 1
  UNION ALL
  SELECT client, rn, CASE WHEN len(h) < 3 THEN list_append(h, us) ELSE h END, len(h) < 3 FROM (SELECT e.client, e.rn, e.us, list_filter(r.held, lambda t: t > e.us - 7200000000) AS h FROM r JOIN e ON e.client = r.client AND e.rn = r.rn + 1)
) SELECT client, count(*) AS requests, count_if(allowed)::BIGINT AS allowed FROM r GROUP BY client"""


def q_json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,int>").alias("m"))
    return e.select("event_id", F.element_at("m", F.lit("k")).alias("k"), F.sha2(F.to_json(F.struct("event_id")), 256).alias("digest"))


S_JSON = """SELECT event_id, (props->>'$.k')::INT AS k, sha256('{"event_id":' || event_id || '}') AS digest FROM events"""


def q_year_chunks(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    d = table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.date_add(F.to_date(F.max("o_orderdate")), 1).alias("b"))
    return sources.year_chunks(d).select(F.col("chunk_start").cast("string"), F.col("chunk_end").cast("string"))


S_YEARS = "WITH d AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE + 1 AS b FROM orders), y AS (SELECT a, b, unnest(generate_series(date_trunc('year', a), (b - 1)::TIMESTAMP, INTERVAL 1 YEAR))::DATE AS y FROM d) SELECT greatest(a, y)::VARCHAR AS chunk_start, least(b, (y + INTERVAL 1 YEAR)::DATE)::VARCHAR AS chunk_end FROM y"


def q_boosted_forecast(spark, sf_dir):
    """Boosted trees of each series on its purged development rows' returns, scored on the holdout. README lists what is less than the reference's."""
    cols = ["ret_1h", "sma_ratio_24h", "volatility_24h", "close_zscore_24h"]
    d = asof.with_target(features.rolling_features(hourly(spark, sf_dir)), 24).where(F.col("close") > 0).dropna(subset=["target_24h"])
    d = evaluation.with_holdout(evaluation.numbered(positive(d).dropna(subset=cols)))
    train, rest = (written(x, "boosted") for x in evaluation.holdout_split(d, "target_timestamp_24h"))
    names = [r.series for r in train.select("series").distinct().orderBy("series").collect()]
    parts = [evaluation.boosted(iterations=5).fit_predict(train.where(F.col("series") == s), rest.where(F.col("series") == s), cols, "target_24h") for s in names]
    if not parts:
        raise ValueError("no series has training rows")
    return scored(reduce(DataFrame.unionByName, parts).withColumn("p", F.col("close") * F.exp("raw")), "p", ["series"])


def q_median_trees(spark, sf_dir):
    """Trees with median leaves of all series, fitted together on their purged development rows and the catalogue up to 24 h, scored on the holdout."""
    b = written(features.build_features(hourly(spark, sf_dir)), "features")
    cols = [c for c in features.feature_columns(b) if not c.endswith(("48h", "72h", "168h", "360h", "720h")) and not c.startswith("bollinger_position")]
    d = asof.with_target(b, 24).where(F.col("close") > 0).dropna(subset=["target_24h", *cols])
    train, rest = (written(x, "trees") for x in evaluation.holdout_split(evaluation.with_holdout(evaluation.numbered(positive(d))), "target_timestamp_24h"))
    fits = evaluation.median_boosted(iterations=3).fits(train, cols, "target_24h", "series")
    return scored(evaluation.predict_each(fits, rest, cols, "series").withColumn("p", F.col("close") * F.exp("raw")), "p", ["series"])


def q_lookback_walk_forward(spark, sf_dir):
    return scored(evaluation.walk_forward_median(positive(prepared(spark, sf_dir)), 24, 5, lookback_days=7), "predicted", ["series"])


S_LOOKBACK = S_WALK_FORWARD.replace("f.tts < st.start GROUP", "f.tts < st.start AND f.ts >= st.start - INTERVAL 7 DAYS GROUP")


RANGE_MS = (1704412800000, 1705622400000)


def q_tag_range(spark, sf_dir):
    """tag_report's rows within two dates, by block of 500 arrivals."""
    t = ticks(spark, sf_dir)
    bad = F.col("seq") % 7 == 0
    order = F.struct((F.col("seq") - 40 * (F.col("seq") % 5)).alias("a"), "seq")
    d = t.select("series", F.unix_millis("ts").alias("ms"), F.col("price").alias("open"), (F.col("price") + F.when(bad, -1).otherwise(1)).alias("high"), (F.col("price") - 1).alias("low"), F.col("price").alias("close"), order.alias("seq"))
    d = d.withColumn("block", F.floor(F.col("seq.a") / 500))
    tagged = bars.tag_rows(d, start_ms=RANGE_MS[0], end_ms=RANGE_MS[1], block="block")
    return tagged.groupBy("series", "tag").agg(F.count("*").alias("rows"))


S_TAG_RANGE = f"""WITH {TICKS}, d AS (SELECT series, epoch_us(ts) // 1000 AS ms, seq % 7 <> 0 AS ok, epoch_us(ts) // 1000 BETWEEN {RANGE_MS[0]} AND {RANGE_MS[1] - 1} AS inside, row_number() OVER (PARTITION BY series ORDER BY seq - 40 * (seq % 5), seq) AS o FROM ticks),
m AS (SELECT *, max(CASE WHEN ok AND inside THEN ms END) OVER (PARTITION BY series ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d)
SELECT series, CASE WHEN NOT inside THEN 'out_of_range' WHEN ms <= before THEN 'duplicate' WHEN NOT ok THEN 'malformed' ELSE 'written' END AS tag, count(*) AS rows FROM m GROUP BY 1, 2"""


def q_coverage(spark, sf_dir):
    d = sources.coverage(ticks(spark, sf_dir), "2024-01-05")
    return d.select("series", seconds("first_ts", "first_s"), seconds("last_ts", "last_s"), "rows", "days")


S_COVERAGE = f"WITH {TICKS} SELECT series, epoch_us(min(ts)) // 1000000 AS first_s, epoch_us(max(ts)) // 1000000 AS last_s, count(*) AS rows, count(DISTINCT ts::DATE) AS days FROM ticks WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY series"


def q_session_quotes(spark, sf_dir):
    d = serving.session_quote(ticks(spark, sf_dir).withColumnRenamed("price", "close"), "2024-01-20")
    return d.select("series", seconds(), F.round("price", 6).alias("price"), X.symbol_of(F.col("series")).alias("symbol"))


S_SESSION = f"WITH {TICKS} SELECT series, epoch_us(max(ts)) // 1000000 AS ts_s, round(arg_max(price, ts), 6) AS price, CASE series WHEN 'silver' THEN 'XAG' WHEN 'gold' THEN 'XAU' ELSE upper(series) END AS symbol FROM ticks WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-20' GROUP BY series"


def q_newest_bars(spark, sf_dir):
    return serving.newest(hourly(spark, sf_dir)).select("series", seconds(), F.round("close", 6).alias("close"), "rank")


S_NEWEST = f"WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC)::INT AS rank FROM bars) SELECT series, epoch(ts)::BIGINT AS ts_s, round(close, 6) AS close, rank FROM n WHERE rank <= 6"


def q_requests_checked(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    metal = F.element_at(F.array(*[F.lit(m) for m in (*serving.METALS, "tin")]), (F.col("event_id") % 5 + 1).cast("int"))
    hours = F.element_at(F.array(*[F.lit(h) for h in (*X.HORIZONS, 0, 5)]), (F.col("event_id") % 11 + 1).cast("int"))
    return serving.checked_requests(e.select("event_id", metal.alias("metal"), hours.alias("horizon_hours")))


S_REQUESTS = """WITH r AS (SELECT event_id, ['gold', 'silver', 'palladium', 'platinum', 'tin'][event_id % 5 + 1] AS metal, [2, 4, 8, 12, 24, 72, 168, 360, 720, 0, 5][event_id % 11 + 1]::INT AS horizon_hours FROM events)
SELECT *, CASE WHEN metal = 'tin' THEN 'metal must be one of gold, silver, palladium, platinum' WHEN horizon_hours < 1 THEN 'horizon_hours must be at least 1' WHEN horizon_hours = 5 THEN 'horizon 5h is not supported' END AS error FROM r"""


def q_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stamp = F.date_format(F.col("o_orderdate").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return o.select("o_orderkey", X.price_text(F.col("o_totalprice")).alias("price"), X.percent_text(X.percent_change((F.col("o_orderkey") % 3000).cast("double"), F.lit(1000.0))).alias("change"), F.unix_seconds(X.http_date(stamp)).alias("date_s"), X.horizon_of(F.concat(F.lit("silver_"), F.col("o_orderkey") % 720, F.lit("h.json"))).alias("hours"))


S_TEXTS = """SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS price, CASE WHEN o_orderkey % 3000 > 1000 THEN '+' ELSE '' END || format('{:.2f}%', ((o_orderkey % 3000) / 1000.0::DOUBLE - 1) * 100) AS change, epoch_us(o_orderdate) // 1000000 AS date_s, (o_orderkey % 720)::INT AS hours FROM orders"""


def q_registry(spark, sf_dir):
    seen = hourly(spark, sf_dir).select("series", F.element_at(F.array(*[F.lit(h) for h in X.HORIZONS]), F.hour("ts") % 6 + 1).alias("horizon_hours"))
    return serving.models_by_metal(seen).select("series", F.array_join("horizons", ",").alias("horizons"))


S_REGISTRY = f"WITH {BARS}, h AS (SELECT DISTINCT series, [2, 4, 8, 12, 24, 72, 168, 360, 720][hour(ts) % 6 + 1] AS h FROM bars) SELECT series, string_agg(h::VARCHAR, ',' ORDER BY h) AS horizons FROM h GROUP BY series"


def q_circuit_breaker(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    answers = F.array(F.col("event_id") % 3 == 0, F.col("event_id") % 4 < 2)
    d = e.select(F.lit("api").alias("service"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"), answers.alias("answers"))
    return serving.through_breakers(d, 3600).groupBy("provider", "tried").agg(F.count("*").alias("requests"))


def q_train_and_forecast(spark, sf_dir):
    """Silver's forecasts by artifacts that were trained, saved, checked and loaded again. README lists what is less than the reference's."""
    b = written(hourly(spark, sf_dir).where(F.col("close") > 0), "bars")
    root = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    config = training.Config(min_rows=300, splits=2, iterations=2)
    choices = [*training.candidates(config), evaluation.Ridge(1.0)]
    columns = ["ret_1h", "sma_ratio_24h", "close_zscore_24h", "volatility_24h", "rsi_14", "spx_log_return_24h", "gold_silver_ratio"]
    done = training.train_all(b, "silver", root, (2, 24, 72), config, choices, columns, ("spx", "gold_silver"))
    parts = [training.latest_forecast(b, training.load(spark, root, "silver", a.record["horizon_hours"])) for a in done]
    return reduce(DataFrame.unionByName, parts).drop("timestamp_utc", "target_timestamp_utc")


S_HOURLY_FEATURES = f"SELECT * FROM ({rolling_sql()}) JOIN ({exponential_sql()}) USING (series, ts_s)"


QUERIES = {
    "hourly_bars": q_hourly_bars, "daily_bars": q_daily_bars, "hourly_features": q_hourly_features, "rolling_features": q_rolling_features, "bad_tick_features": q_bad_tick_features, "exponential_features": q_exponential_features, "appended_features": q_appended_features,
    "usd_context": q_usd_context, "gold_ratio": q_gold_ratio, "targets": q_targets, "walk_forward": q_walk_forward, "folds": q_folds, "holdout_persistence": q_holdout_persistence,
    "selective_grid": q_selective_grid, "champions": q_champions, "predictions": q_predictions, "tag_report": q_tag_report, "keep_last": q_keep_last, "unit_conversion": q_unit_conversion,
    "exposition": q_exposition, "missing_models": q_missing_models, "fresh_quotes": q_fresh_quotes, "rate_limit": q_rate_limit, "json_props": q_json_props, "year_chunks": q_year_chunks, "boosted_forecast": q_boosted_forecast, "median_trees": q_median_trees,
    "spx_context": context_query("spx"), "wti_context": context_query("wti"), "gold_context": q_gold_context, "lookback_walk_forward": q_lookback_walk_forward, "tag_range": q_tag_range, "coverage": q_coverage, "session_quotes": q_session_quotes,
    "newest_bars": q_newest_bars, "requests_checked": q_requests_checked, "texts": q_texts, "registry": q_registry, "circuit_breaker": q_circuit_breaker, "train_and_forecast": q_train_and_forecast,
}
ORACLES = {
    "hourly_bars": S_HOURLY_BARS, "daily_bars": S_DAILY_BARS, "rolling_features": rolling_sql(), "bad_tick_features": bad_tick_sql(), "exponential_features": exponential_sql(), "usd_context": context_sql(), "gold_ratio": S_GOLD_RATIO, "targets": S_TARGETS,
    "walk_forward": S_WALK_FORWARD, "folds": S_FOLDS, "holdout_persistence": S_HOLDOUT, "selective_grid": grid_sql(), "champions": S_CHAMPIONS, "predictions": S_PREDICTIONS, "tag_report": S_TAG_REPORT, "keep_last": S_KEEP_LAST,
    "unit_conversion": S_UNIT_CONVERSION, "exposition": S_EXPOSITION, "missing_models": S_MISSING, "fresh_quotes": S_FRESH, "rate_limit": S_RATE_LIMIT, "json_props": S_JSON, "year_chunks": S_YEARS,
    "hourly_features": S_HOURLY_FEATURES, "appended_features": S_HOURLY_FEATURES, "spx_context": context_sql("spx", False), "wti_context": context_sql("wti", False), "gold_context": gold_sql(), "lookback_walk_forward": S_LOOKBACK, "tag_range": S_TAG_RANGE, "coverage": S_COVERAGE,
    "session_quotes": S_SESSION, "newest_bars": S_NEWEST, "requests_checked": S_REQUESTS, "texts": S_TEXTS, "registry": S_REGISTRY,
}
