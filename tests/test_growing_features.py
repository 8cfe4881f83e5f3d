"""Features appended day by day against features built over all bars at once."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quartzline.operators import features
from quartzline.streaming import features as growing
from quartzline.streaming.market import VERSIONS

KINDS = "series string, ts timestamp, open double, high double, low double, close double, volume double, minute_count long"


def hours(n: int) -> pd.DataFrame:
    """Three series, one without a name; closes are missing here and there, over the ends of appends, and in one series for most of a month."""
    rng = np.random.default_rng(5)
    frames = []
    for k, series in enumerate(["silver", "gold", None]):
        close = 1000 * (k + 1) + np.cumsum(rng.normal(0, 2, n))
        d = pd.DataFrame({"series": series, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "open": close + rng.normal(0, 1, n), "high": close + 3, "low": close - 3, "close": close, "volume": rng.integers(1, 90, n).astype(float), "minute_count": 60})
        missing = (rng.random(n) < 0.05) | ((np.arange(n) >= 796) & (np.arange(n) < 803))
        if series == "gold":
            missing |= (np.arange(n) >= 20) & (np.arange(n) < n - 30)
        d.loc[missing, ["open", "high", "low", "close"]] = np.nan
        frames.append(d)
    return pd.concat(frames)


def table(spark, pdf):
    return spark.createDataFrame(pdf, KINDS).select("series", "ts", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("open", "high", "low", "close", "volume")], "minute_count")


def same(got, want):
    key = lambda d: d.toPandas().assign(series=lambda x: x.series.fillna("-")).sort_values(["series", "ts"]).reset_index(drop=True)
    a, b = key(got), key(want)
    pd.testing.assert_frame_equal(a[b.columns], b, check_exact=False, rtol=1e-8, atol=1e-10)


def test_days_appended_equal_a_full_build(spark, tmp_path):
    pdf, root = hours(860), str(tmp_path / "grown")
    at = lambda k: datetime(2024, 1, 1) + timedelta(hours=k)
    d = table(spark, pdf).where("NOT (series = 'silver' AND ts >= '2024-02-03 08:00' AND ts < '2024-02-04 08:00')").cache()  # hours 800 to 823: silver has none in the second append
    assert growing.appended(spark, root) is None
    for v, (a, b) in enumerate([(0, 800), (800, 824), (824, 825), (825, 860)]):
        assert growing.append(d.where((F.col("ts") >= at(a)) & (F.col("ts") < at(b))), root) == v
    same(growing.appended(spark, root), features.build_features(d))

    kept = [growing.commits(spark, root)[-k][1] for k in range(1, VERSIONS)]
    assert sorted(p.parent.name for p in (tmp_path / "grown" / "parts").glob("*/tail")) == sorted([*kept, growing.commits(spark, root)[-VERSIONS][1]])
    tail = spark.read.parquet(f"{root}/parts/{kept[0]}/tail").groupBy("series").count()
    assert {r["count"] for r in tail.collect()} == {features.REACH}  # what the next append reads, whatever stands


def test_late_bars_and_lost_writers(spark, tmp_path, monkeypatch):
    pdf, root = hours(60), str(tmp_path / "grown")
    d = table(spark, pdf[pdf.series == "silver"]).cache()
    first, rest = d.where("ts < '2024-01-02 12:00'"), d.where("ts >= '2024-01-02 12:00'")
    growing.append(first, root)
    with pytest.raises(ValueError, match="36 bars are no later"):
        growing.append(d, root)
    with pytest.raises(ValueError, match="1 bars are no later"):
        growing.append(rest.limit(1).withColumn("ts", F.lit(None).cast("timestamp")), root)
    with pytest.raises(ValueError, match="fail or drop"):
        growing.append(d, root, "keep")
    assert growing.append(first, root, "drop") is None and growing.append(d.where("false"), root) is None

    whole = growing.advanced

    def broken(*a):
        tables, read = whole(*a)
        return tables | {growing.SIGNALS: tables[growing.SIGNALS].select(F.raise_error(F.lit("lost")).alias("x"))}, read

    monkeypatch.setattr(growing, "advanced", broken)
    with pytest.raises(Exception, match="lost"):
        growing.append(rest, root)
    monkeypatch.setattr(growing, "advanced", whole)
    assert growing.appended(spark, root).count() == 36
    growing.append(d, root, "drop")
    same(growing.appended(spark, root), features.build_features(d))


def test_stream_of_bars_adds_nothing_twice(spark, tmp_path):
    pdf, root, source = hours(90), str(tmp_path / "grown"), str(tmp_path / "bars")
    d = table(spark, pdf[pdf.series == "silver"]).cache()
    for a, b in ((0, 40), (40, 90)):
        at = [datetime(2024, 1, 1) + timedelta(hours=k) for k in (a, b)]
        d.where((F.col("ts") >= at[0]) & (F.col("ts") < at[1])).coalesce(1).write.mode("append").parquet(source)
        for checkpoint in ("one", "lost") if a else ("one",):
            stream = spark.readStream.schema(d.schema).parquet(source)
            query = growing.keep_features(stream, root, str(tmp_path / checkpoint))
            query.processAllAvailable()
            query.stop()
    assert len(growing.commits(spark, root)) == 2
    same(growing.appended(spark, root), features.build_features(d))
