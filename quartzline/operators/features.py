"""The feature catalogue of hourly bars: 81 columns, each a function of rows up to its own in one series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.functions.exprs import above_zero, finite, ratio
from quartzline.operators.windows import IN_CHUNK, block_rows, chunked, exponential_ends, rolling_extremes, rolling_moments, sound
from quartzline.session import written

# Lags and window lengths in rows, and spans of the exponential means.
LAGS = (2, 4, 8, 12, 24, 48, 72, 168, 360, 720)
WINDOWS = (6, 12, 24, 48, 72, 168, 360, 720)
SPANS = (12, 26, 50, 200)
WILDER = 1 / 14
ALPHAS = {n: 2 / (n + 1) for n in SPANS}
NOT_FEATURES = ("series", "ts", "open", "high", "low", "close", "volume", "minute_count")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES and not c.startswith(("target_", "future_", "__"))]


def exponential_features(bars: DataFrame) -> DataFrame:
    """EMA ratios, MACD, RSI, ATR and the directional indicators, beside the bars."""
    return exponential_parts(bars)[0]


def exponential_parts(bars: DataFrame, carried: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """exponential_features(), and where its means and the means of those stand after the last row.

    With carried, such ends of earlier rows, the means go on from there; rows whose __old is true are the last of the earlier ones, and count only as
    the rows before those that follow.
    """
    before = lambda x: F.expr(f"lag({x}) {IN_CHUNK}")
    c, pc = F.col("close"), before("close")
    d = c - pc
    up, down = F.col("high") - before("high"), before("low") - F.col("low")
    b = chunked(bars, 1, block_rows([0.2, WILDER, *ALPHAS.values()])).withColumns(
        {
            "__g": above_zero(d),
            "__l": above_zero(-d),
            "__tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)),
            "__p": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "__m": F.when((down > up) & (down > 0), down).otherwise(0.0),
        }
    )
    b = b.where("NOT __halo").drop("__halo")
    new = (lambda x: F.when(~F.col("__old"), x)) if "__old" in bars.columns else (lambda x: x)
    b = b.withColumns({"__c": new(F.col("close")), **{f"__{k}": new(F.col(f"__{k}")) for k in ("g", "l", "tr", "p", "m")}})
    first, second = carried or (None, None)
    wilder = {f"__e{k}": (f"__{k}", WILDER, 14) for k in ("g", "l", "tr", "p", "m")}
    b, first = exponential_ends(b, {f"__ema{n}": ("__c", a, 0) for n, a in ALPHAS.items()} | wilder, first)
    plus, minus = (100 * ratio(F.col(f"__e{k}"), F.col("__etr")) for k in "pm")
    b = b.withColumns({"__macd": F.col("__ema12") - F.col("__ema26"), "__plus": plus, "__minus": minus})
    b = b.withColumn("__dx", 100 * ratio(F.abs(F.col("__plus") - F.col("__minus")), F.col("__plus") + F.col("__minus")))
    b = b.withColumns({"__macd_new": new(F.col("__macd")), "__dx": new(F.col("__dx"))})
    b, second = exponential_ends(b, {"__signal": ("__macd_new", 0.2, 0), "__adx": ("__dx", WILDER, 14)}, second)
    c = F.col("close")
    out = {f"ema{n}_ratio": ratio(c, F.col(f"__ema{n}")) - 1 for n in SPANS}
    out |= {
        "ema50_200_spread": ratio(F.col("__ema50"), F.col("__ema200")) - 1,
        "macd_pct": ratio(F.col("__macd"), c),
        "macd_signal_pct": ratio(F.col("__signal"), c),
        "macd_hist_pct": ratio(F.col("__macd") - F.col("__signal"), c),
        "rsi_14": (100 - 100 / (1 + ratio(F.col("__eg"), F.col("__el")))) / 100,
        "atr_14_pct": ratio(F.col("__etr"), c),
        "adx_14": F.col("__adx") / 100,
        "plus_di_14": F.col("__plus") / 100,
        "minus_di_14": F.col("__minus") / 100,
        "di_spread_14": (F.col("__plus") - F.col("__minus")) / 100,
    }
    return b.select(*bars.columns, *[finite(x).alias(k) for k, x in out.items()]), first, second


#: Rows before its own that a rolling column looks at: the longest window, its returns' lag and the mean over three rows behind it.
REACH = max(WINDOWS) + 4


def quotient(a: str, b: str) -> str:
    return f"try_divide({a}, {b})"


def zscore(x: str, name: str, n: int) -> str:
    return f"CASE WHEN {name}_sd_{n} = 0 THEN 0D ELSE ({x} - {name}_mean_{n}) / {name}_sd_{n} END"


def rolling_features(bars: DataFrame) -> DataFrame:
    """Returns, momentum, trend, volatility, range, stochastic, Bollinger, candle, volume and calendar columns, beside the bars.

    All windows run by chunk of a series: one sort for all of them, and a fixed number of terms a row whatever a window's length.
    """
    b = written(chunked(bars, REACH), "chunks")  # so that the long plan below has one shuffle and is planned once
    kept = [c for c in b.columns if c not in bars.columns]
    b = b.selectExpr("*", "CASE WHEN close > 0 THEN ln(close) END AS __ln", "ln(1 + greatest(coalesce(nanvl(volume, CAST(NULL AS DOUBLE)), 0D), 0D)) AS __lv")
    b = b.selectExpr("*", f"__ln - lag(__ln) {IN_CHUNK} AS ret_1h", *[f"__ln - lag(__ln, {n}) {IN_CHUNK} AS log_return_{n}h" for n in LAGS])
    b = rolling_moments(b, {"__p": ("close", (*WINDOWS, 20)), "__r": ("ret_1h", WINDOWS), "__v": ("__lv", (24, 168))})
    b = rolling_extremes(b, "high", "low", sorted({*WINDOWS, 14}))
    out = {f"log_return_{n}h": f"log_return_{n}h" for n in LAGS}
    for n in WINDOWS:
        out |= {
            f"sma_ratio_{n}h": f"{quotient('close', f'__p_mean_{n}')} - 1",
            f"close_zscore_{n}h": zscore("close", "__p", n),
            f"volatility_{n}h": f"__r_sd_{n}",
            f"range_ratio_{n}h": f"{quotient(f'__top_{n}', f'__bottom_{n}')} - 1",
            f"range_position_{n}h": quotient(f"close - __bottom_{n}", f"__top_{n} - __bottom_{n}"),
        }
    out |= {
        "stochastic_k_14": quotient("close - __bottom_14", "__top_14 - __bottom_14"),
        "bollinger_position_20": quotient("close - (__p_mean_20 - 2 * __p_sd_20)", "4 * __p_sd_20"),
        "bollinger_width_20": quotient("4 * __p_sd_20", "__p_mean_20"),
        "candle_body_pct": quotient("close - open", "open"),
        "high_low_pct": quotient("high - low", "open"),
        "upper_wick_pct": quotient("high - greatest(open, close)", "open"),
        "lower_wick_pct": quotient("least(open, close) - low", "open"),
        "log_volume": "__lv",
        "volume_zscore_24h": zscore("__lv", "__v", 24),
        "volume_zscore_168h": zscore("__lv", "__v", 168),
        "minute_coverage": "minute_count / 60D",
    }
    angle = {"hour": "hour(ts) * (2 * pi() / 24)", "dow": "weekday(ts) * (2 * pi() / 7)"}
    out |= {f"{k}_{f}": f"{f}({x})" for k, x in angle.items() for f in ("sin", "cos")}
    b = b.selectExpr(*[f"`{c}`" for c in bars.columns], *kept, "ret_1h", *[f"{x} AS {k}" for k, x in out.items()])
    finite_only = [f"CASE WHEN NOT isnan({k}) AND abs({k}) <> double('infinity') THEN {k} END AS {k}" for k in out]
    b = b.selectExpr(*[f"`{c}`" for c in bars.columns], *kept, f"{sound('ret_1h')} AS ret_1h", *finite_only)
    three = IN_CHUNK.replace(")", " ROWS 2 PRECEDING)")
    b = b.selectExpr("*", f"CASE WHEN count(stochastic_k_14) {three} = 3 THEN avg(stochastic_k_14) {three} END AS stochastic_d_3")
    return b.where("NOT __halo").drop(*kept)


def build_features(bars: DataFrame) -> DataFrame:
    """All 81 columns beside the bars."""
    return rolling_features(exponential_features(bars))
