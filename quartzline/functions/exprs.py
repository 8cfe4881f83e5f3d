"""Scalar expressions of the market domain: unit conversion, guards, time and label functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grams of a troy ounce, ounces of a kilogram, and the forecast horizons in hours.
TROY_OUNCE_GRAMS = "31.1034768"
OUNCES_PER_KG = 32.150746568627981
OUNCES_PER_KG_EXACT = "32.150746568627980523"
HORIZONS = (2, 4, 8, 12, 24, 72, 168, 360, 720)
#: Epoch values under this are seconds, others milliseconds.
SECONDS_BELOW = 10_000_000_000


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def number(x: Column) -> Column:
    """A double, or null where the text isn't a finite number."""
    return finite(x.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def above_zero(x: Column) -> Column:
    """max(x, 0) that keeps null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def usd_per_kg(per_ounce: Column) -> Column:
    return per_ounce * F.lit(OUNCES_PER_KG)


def usd_per_kg_exact(text: Column) -> Column:
    """Decimal conversion of a positive price text, rounded half-even to six places; null for anything else."""
    x = F.trim(text).try_cast("decimal(16,7)")
    return F.when(x > 0, F.bround(x * F.lit(OUNCES_PER_KG_EXACT).cast("decimal(20,18)"), 6).cast("decimal(20,6)"))


def epoch_ms(value: Column) -> Column:
    """Milliseconds from a value that may be seconds."""
    return F.when((value > 0) & (value < SECONDS_BELOW), value * 1000).otherwise(value).cast("long")


def iso_seconds(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fixed_offset_utc(text: Column, hours: int = -5) -> Column:
    """UTC instant of a local time text yyyyMMdd HHmmss at a fixed offset without daylight saving."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd HHmmss")) - F.make_interval(hours=F.lit(hours))


def ohlc_valid(o: Column, h: Column, low: Column, c: Column) -> Column:
    return F.coalesce((low <= h) & o.between(low, h) & c.between(low, h), F.lit(False))


def percent_change(new: Column, old: Column) -> Column:
    return (ratio(new, old) - 1) * 100


def direction(change_percent: Column, flat: float = 0.005) -> Column:
    """up, down, or neutral for small changes and where there is no finite one."""
    x = finite(change_percent)
    return F.when(x >= flat, "up").when(x <= -flat, "down").otherwise("neutral")


def price_text(x: Column, digits: int = 2) -> Column:
    """Grouped thousands and two decimals; a dash where there is no finite price."""
    return F.coalesce(F.format_number(finite(x), digits), F.lit("—"))


def percent_text(x: Column, digits: int = 2) -> Column:
    """Signed percent; a dash where there is no finite one."""
    y = finite(x)
    return F.when(y.isNotNull(), F.concat(F.when(y > 0, "+").otherwise(""), F.format_string(f"%.{digits}f%%", y))).otherwise("—")


def http_date(text: Column) -> Column:
    """UTC instant of a mail or HTTP date such as Sat, 01 Feb 2025 10:00:00 GMT or 1 Feb 2025 12:00:00 +0200; null for anything else."""
    parts = r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})\s+(GMT|UT|UTC|Z|[+-]\d{4})\s*$"
    zone = F.regexp_extract(text, parts, 2)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    ahead = F.when(zone.startswith("-"), -minutes).when(zone.startswith("+"), minutes).otherwise(0)
    return F.try_to_timestamp(F.regexp_extract(text, parts, 1), F.lit("d MMM yyyy HH:mm:ss")) - F.make_interval(mins=ahead)


def symbol_of(series: Column) -> Column:
    """The exchange symbol of a metal, else the name in capitals."""
    # Fixed values.
    names = {"silver": "XAG", "gold": "XAU", "platinum": "XPT", "palladium": "XPD"}
    out = F.upper(F.coalesce(series, F.lit("")))
    for name, symbol in names.items():
        out = F.when(series == name, symbol).otherwise(out)
    return out


def env_list(text: str | None) -> tuple[str, ...]:
    """The trimmed lower-case items of a comma-separated setting, each once."""
    return tuple(dict.fromkeys(x for x in (p.strip().lower() for p in (text or "").split(",")) if x))


def horizon_of(name: Column) -> Column:
    """Hours in an artifact's name such as silver_24h.json; null where there are none."""
    return F.regexp_extract(name, r"^[a-z]+_(\d+)h(?:\b|_)", 1).try_cast("int")


def horizon_label(hours: Column) -> Column:
    return F.when(hours < 168, F.format_string("%dh", hours)).otherwise(F.format_string("%dd", (hours / 24).cast("int")))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
