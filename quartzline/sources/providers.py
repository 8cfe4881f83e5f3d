"""What a provider of minute bars or of live quotes has to offer, and providers over landed data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzline.functions.exprs import http_date, usd_per_kg
from quartzline.operators.serving import fresh_quote, session_quote
from quartzline.sources.market import order_book_midpoint

# The order book's securities of the metals.
SECURITIES = {"gold": "AUXLN", "silver": "AGXLN", "platinum": "PTXLN", "palladium": "PDXLN"}


@runtime_checkable
class MinuteProvider(Protocol):
    """Minute bars (series, ts, prices, volume) of one series in [start, end)."""

    source_name: str
    timeframe: str
    price_side: str

    def minutes(self, spark: SparkSession, series: str, start=None, end=None) -> DataFrame: ...


@dataclass(frozen=True)
class LandedMinutes:
    """Minute bars of files under root/series, by a reader such as market.metal_minutes."""

    root: str
    reader: Callable[[SparkSession, str, str], DataFrame]
    source_name: str
    timeframe: str = "M1"
    price_side: str = "BID"

    def minutes(self, spark: SparkSession, series: str, start=None, end=None) -> DataFrame:
        d = self.reader(spark, f"{self.root.rstrip('/')}/{series}", series)
        d = d if start is None else d.where(F.col("ts") >= F.lit(start))
        return d if end is None else d.where(F.col("ts") < F.lit(end))


@runtime_checkable
class QuoteProvider(Protocol):
    """Live quotes (series, ts, price, source), at most one a series; none where configured is false."""

    configured: bool

    def latest(self) -> DataFrame: ...


@dataclass(frozen=True)
class OrderBooks:
    """Midpoints in USD per kilogram of order book documents: payloads (series, xml, date, an HTTP date)."""

    payloads: DataFrame
    configured: bool = True

    def latest(self) -> DataFrame:
        price = F.lit(None).cast("double")
        for series, security in SECURITIES.items():
            price = F.when(F.col("series") == series, order_book_midpoint(F.col("xml"), security)).otherwise(price)
        d = self.payloads.select("series", http_date(F.col("date")).alias("ts"), price.alias("price"), F.lit("order book").alias("source"))
        return d.where(F.col("price").isNotNull() & F.col("ts").isNotNull())


@dataclass(frozen=True)
class Sessions:
    """The last close of the latest completed day, from minute bars in USD per ounce (series, ts, close)."""

    minutes: DataFrame
    today: object
    lookback_days: int = 4
    configured: bool = True

    def latest(self) -> DataFrame:
        d = session_quote(self.minutes, self.today, self.lookback_days)
        return d.select("series", "ts", usd_per_kg(F.col("price")).alias("price"), F.lit("completed session").alias("source"))


def latest_quotes(providers: list[QuoteProvider], now, ttl_seconds: int = 60, stale_seconds: int = 86_400) -> DataFrame:
    """The quote of each series to serve, from all configured providers, the first in the list being preferred; see fresh_quote()."""
    parts = [p.latest().withColumn("priority", F.lit(k)) for k, p in enumerate(providers) if p.configured]
    if not parts:
        raise ValueError("no quote provider is configured")
    return fresh_quote(reduce(DataFrame.unionByName, parts), now, ttl_seconds, stale_seconds)
