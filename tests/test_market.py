"""Market operators on small fixtures with known results, and against pandas."""

import lzma
import math
import struct
import zipfile
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quartzline.functions import exprs as X
from quartzline.operators import asof, bars, evaluation, features, serving, windows
from quartzline.sources import market as sources


def hourly_frame(n, start="2024-01-01", gap=()):
    rng = np.random.default_rng(3)
    ts = pd.date_range(start, periods=n, freq="h")
    close = 1000 + np.cumsum(rng.normal(0, 1, n))
    d = pd.DataFrame({"series": "silver", "ts": ts, "open": close + 0.1, "high": close + 1, "low": close - 1, "close": close, "volume": rng.integers(1, 90, n).astype(float), "minute_count": 60})
    return d.drop(index=list(gap)).reset_index(drop=True)


@pytest.fixture(scope="module")
def frame():
    return hourly_frame(800)


@pytest.fixture(scope="module")
def hourly(spark, frame):
    return spark.createDataFrame(frame)


def by_time(df):
    return df.orderBy("ts").toPandas()


def test_resample_takes_first_and_last_and_skips_empty_hours(spark):
    rows = [("s", "2025-01-01 00:00:00", 1.0, 2.0), ("s", "2025-01-01 00:59:00", 3.0, None), ("s", "2025-01-01 02:00:00", 5.0, None)]
    d = spark.createDataFrame(rows, "series string, t string, p double, v double").withColumn("ts", F.to_timestamp("t"))
    out = bars.resample(d, o="p", h="p", low="p", c="p", volume="v").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume, r.minute_count) for r in out] == [(1, 3, 1, 3, 2, 2), (5, 5, 5, 5, None, 1)]


def test_minutes_convert_to_kilograms(spark, tmp_path):
    (tmp_path / "m.csv").write_text(" Timestamp ,open,HIGH,low,close,volume\n1735689600000,31.1034768,31.414511568,30.792442032,31.1034768,2\n1735689660000,31.1034768,31.725546336,30.481407264,31.414511568,3\nx,1,1,1,1,1\n1735689720000,,1,1,1,1\n")
    d = sources.raw_minutes(spark, str(tmp_path / "m.csv"), "silver")
    d = d.withColumns({c: X.usd_per_kg(F.col(c)) for c in ("open", "high", "low", "close")})
    (r,) = bars.resample(d).collect()
    assert (round(r.open, 6), round(r.close, 6), r.volume, r.minute_count) == (1000.0, 1010.0, 5.0, 2)
    with pytest.raises(ValueError, match="missing columns: close"):
        bars.require(d.drop("close"), ("close",))


def test_exact_conversion_and_scalars(spark):
    d = spark.createDataFrame([("31.1034768", 1.0), (" -1 ", 0.0), ("NaN", -1.0), (None, None)], "t string, x double")
    out = d.select(X.usd_per_kg_exact(F.col("t")).cast("string").alias("k"), X.above_zero(F.col("x")).alias("a"), X.ratio(F.lit(1.0), F.col("x")).alias("r"), X.number(F.col("t")).alias("n")).collect()
    assert [tuple(r) for r in out] == [("1000.000000", 1.0, 1.0, 31.1034768), (None, 0.0, None, -1.0), (None, 0.0, -1.0, None), (None, None, None, None)]
    one = spark.range(1).select(X.direction(F.lit(0.004)).alias("a"), X.direction(F.lit(-1.0)).alias("b"), X.horizon_label(F.lit(168)).alias("c"), X.iso_seconds(F.lit(1735689600999)).alias("d"), X.fixed_offset_utc(F.lit("20250101 000000")).cast("string").alias("e")).first()
    assert tuple(one) == ("neutral", "down", "7d", "2025-01-01T00:00:00Z", "2025-01-01 05:00:00")


def test_tags_follow_the_last_accepted_row(spark):
    rows = [("s", 1, 10, 1.0, 2.0, 0.5, 1.0), ("s", 2, 10, 1.0, 2.0, 0.5, 1.0), ("s", 3, 30, 9.0, 2.0, 0.5, 1.0), ("s", 4, 20, 1.0, 2.0, 0.5, 1.0), ("s", 5, 15, 9.0, 2.0, 0.5, 1.0), ("s", 6, None, 1.0, 1.0, 1.0, 1.0)]
    d = bars.tag_rows(spark.createDataFrame(rows, "series string, seq long, ms long, open double, high double, low double, close double"))
    assert [r.tag for r in d.orderBy("seq").collect()] == ["written", "duplicate", "malformed", "written", "duplicate", "malformed"]
    r = bars.tag_report(d).first()
    assert (r.rows_written, r.duplicates, r.malformed, r.first_ms, r.last_ms) == (2, 2, 2, 10, 20)


def test_keep_last(spark):
    d = spark.createDataFrame([("s", 1, 1, 5.0), ("s", 1, 2, None), ("s", 2, 3, 7.0)], "series string, ts long, seq long, x double")
    assert sorted((r.ts, r.x) for r in bars.keep_last(d).collect()) == [(1, None), (2, 7.0)]


def test_feature_catalogue_matches_pandas(hourly, frame):
    out = features.build_features(hourly)
    names = features.feature_columns(out)
    assert len(names) == len(set(names)) == 81
    got, c = by_time(out), frame["close"]
    delta = c.diff()
    wilder = lambda s: s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    rs = wilder(delta.clip(lower=0)) / wilder(-delta.clip(upper=0)).replace(0, np.nan)
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    up, down = frame["high"].diff(), -frame["low"].diff()
    tr = pd.concat([frame.high - frame.low, (frame.high - c.shift()).abs(), (frame.low - c.shift()).abs()], axis=1).max(axis=1)
    plus, minus = (100 * wilder(pd.Series(np.where(cond, v, 0.0))) / wilder(tr) for cond, v in (((up > down) & (up > 0), up), ((down > up) & (down > 0), down)))
    expected = {
        "ret_1h": np.log(c).diff(), "log_return_168h": np.log(c).diff(168), "sma_ratio_720h": c / c.rolling(720).mean() - 1, "close_zscore_24h": (c - c.rolling(24).mean()) / c.rolling(24).std(),
        "volatility_48h": np.log(c).diff().rolling(48).std(), "range_ratio_12h": frame.high.rolling(12).max() / frame.low.rolling(12).min() - 1, "ema200_ratio": c / c.ewm(span=200, adjust=False).mean() - 1,
        "macd_signal_pct": macd.ewm(span=9, adjust=False).mean() / c, "rsi_14": (100 - 100 / (1 + rs)) / 100, "atr_14_pct": wilder(tr) / c, "adx_14": wilder(100 * (plus - minus).abs() / (plus + minus)) / 100,
        "stochastic_d_3": ((c - frame.low.rolling(14).min()) / (frame.high.rolling(14).max() - frame.low.rolling(14).min())).rolling(3).mean(), "volume_zscore_24h": None,
    }
    for name, e in expected.items():
        if e is not None:
            np.testing.assert_allclose(got[name].astype(float), e, rtol=1e-9, atol=1e-12, err_msg=name)
    assert (got["hour_sin"] ** 2 + got["hour_cos"] ** 2).round(9).eq(1).all()


def test_constant_prices_give_zero_scores(spark):
    d = hourly_frame(60).assign(open=5.0, high=5.0, low=5.0, close=5.0, volume=0.0)
    got = by_time(features.rolling_features(spark.createDataFrame(d)))
    assert got["close_zscore_24h"].dropna().eq(0).all() and got["close_zscore_24h"].isna().sum() == 23
    assert got["volume_zscore_24h"].dropna().eq(0).all() and got["range_position_24h"].isna().all()


def test_as_of_joins_match_pandas(spark):
    left, right = hourly_frame(200, gap=range(20, 40)), hourly_frame(200, "2024-01-01 00:30", gap=range(50, 90)).assign(series="udx")
    got = by_time(asof.with_context(spark.createDataFrame(left), spark.createDataFrame(right), "udx"))
    e = pd.merge_asof(left, right[["ts", "close"]].rename(columns={"close": "u"}).assign(at=right.ts), on="ts")
    np.testing.assert_allclose(got["udx_close"].astype(float), e["u"])
    np.testing.assert_allclose(got["udx_source_age_hours"].astype(float), (e.ts - e["at"]).dt.total_seconds() / 3600)
    back = pd.merge_asof(left[["ts"]].assign(key=left.ts - pd.Timedelta(hours=24)).sort_values("key"), left[["ts", "close"]].rename(columns={"ts": "key", "close": "old"}), on="key")
    r = by_time(spark.createDataFrame(left).withColumn("r", asof.elapsed_log_return("close", 24)))
    np.testing.assert_allclose(r["r"].astype(float), np.log(left.close) - np.log(back["old"]))
    z = left.set_index("ts").close.rolling("24h", min_periods=12)
    got = by_time(spark.createDataFrame(left).withColumn("z", windows.elapsed_zscore("close", 24)))
    np.testing.assert_allclose(got["z"].astype(float), ((left.set_index("ts").close - z.mean()) / z.std()).to_numpy(), rtol=1e-9)


def test_target_over_a_weekend(spark):
    ts = ["2025-01-03 20:00", "2025-01-03 21:00", "2025-01-05 22:00", "2025-01-05 23:00"]
    d = spark.createDataFrame(pd.DataFrame({"series": "s", "ts": pd.to_datetime(ts), "close": [100.5, 101.5, 110.5, 111.5]}))
    r = asof.with_target(d, 2).orderBy("ts").collect()
    assert r[1].future_close_2h == 110.5 and str(r[1].target_timestamp_2h) == "2025-01-05 22:00:00"
    assert math.isclose(r[1].target_2h, math.log(110.5 / 101.5)) and r[2].future_close_2h is None
    assert asof.with_target(d, 2, tolerance=10).where("future_close_2h = 110.5").count() == 0


def test_folds_expand_and_training_is_purged(hourly):
    d = evaluation.with_fold(evaluation.numbered(asof.with_target(hourly, 24)), 3)
    sizes = {r.fold: r["count"] for r in d.groupBy("fold").count().collect()}
    assert sizes == {0: 200, 1: 200, 2: 200, 3: 200}
    t = evaluation.training_rows(d, "target_timestamp_24h")
    assert t.where("target_timestamp_24h >= start").count() == 0 and t.where("valid_fold = 1").count() == 200 - 24
    out = evaluation.walk_forward_median(asof.with_target(hourly, 24), 24, 3)
    m = out.agg(*evaluation.metrics("future_close_24h", "predicted", "close")).first()
    assert m.rows_validated == 600 and m.residual_q10 < m.residual_q90


def test_metrics_on_known_rows(spark):
    d = spark.createDataFrame([(11.0, 10.0, 10.0), (9.0, 9.5, 10.0), (10.0, 10.0, 10.0)], "a double, p double, c double")
    m = d.agg(*evaluation.metrics("a", "p", "c")).first()
    assert math.isclose(m.mae, 0.5) and math.isclose(m.persistence_mae, 2 / 3) and math.isclose(m.directional_accuracy_percent, 200 / 3) and math.isclose(m.improvement_percent, 25)


def test_selection_needs_both_gates_and_grid_prefers_persistence(spark):
    s = spark.createDataFrame([("a", "x", 0, 1.0, 2.0, 0.4), ("a", "y", 1, 1.0, 9.0, 9.0), ("b", "x", 0, 2.0, 0.1, 1.0), ("b", "y", 1, 1.0, 0.5, 0.5)], "series string, name string, position int, dev_mae double, dev_improvement double, holdout_improvement double")
    assert {r.series: (r.selected, r.active) for r in evaluation.champion(s).collect()} == {"a": ("x", "persistence"), "b": ("y", "y")}
    d = spark.createDataFrame([("n", 1.0, 0.0, 100.0), ("n", -1.0, 0.0, 100.0), ("g", 0.01, 0.01, 100.0), ("g", -0.01, -0.01, 100.0)], "series string, raw double, target double, close double")
    got = {r.series: (r.quantile, r.shrinkage) for r in evaluation.selective_grid(d).collect()}
    assert got == {"n": (None, None), "g": (0.5, 1.0)}


def test_models_fit(hourly):
    d = evaluation.with_holdout(evaluation.numbered(features.rolling_features(asof.with_target(hourly, 2)).dropna(subset=["target_2h", "sma_ratio_24h", "volatility_24h"])))
    train, rest = d.where("development"), d.where("not development")
    for model in (evaluation.boosted(iterations=3), evaluation.ridge(1.0, train, "target_2h")):
        assert model.fit_predict(train, rest, ["sma_ratio_24h", "volatility_24h"], "target_2h").where("raw is not null").count() == rest.count()
    with pytest.raises(ValueError, match="at least"):
        evaluation.require_rows(d)


def test_serving(spark):
    latest = spark.createDataFrame([("s", datetime(2025, 1, 1), 100.0)], "series string, ts timestamp, close double")
    models = spark.createDataFrame([("s", 2, None, -0.1, 0.1)], "series string, horizon_hours int, predicted_return double, residual_q10 double, residual_q90 double")
    r = serving.prediction_rows(latest, models).first()
    assert (r.predicted_price, r.change_percent, r.direction, str(r.target_time)) == (100.0, 0.0, "neutral", "2025-01-01 02:00:00") and r.lower_80 < 100 < r.upper_80
    q = spark.createDataFrame([(1.0, 3.0), (3.0, 1.0), (0.0, 1.0)], "bid double, ask double")
    assert [x.price for x in serving.midpoint(q).collect()] == [2.0]
    e = spark.createDataFrame([(str(i % 2), i * 1_000_000 * 10, i) for i in range(40)], "client string, us long, id long")
    allowed = windows.rate_limited(e, 2).where("allowed and client = '0'").orderBy("us").collect()
    times, held = [r.us for r in allowed], []
    for us in range(0, 400_000_000, 20_000_000):
        held += [us] if sum(t > us - 60_000_000 for t in held) < 2 else []
    assert times == held
    lines = [r.line for r in serving.exposition(spark.createDataFrame([("GET", "/a", "200")] * 2, "method string, path string, status string")).collect()]
    assert lines == ['http_requests_total{method="GET",path="/a",status="200"} 2']


def test_packed_days_and_zips(spark, tmp_path):
    good = struct.pack(">5if", 0, 31000, 31100, 30900, 31200, 1.25) + struct.pack(">5if", 60, 31100, 31050, 31000, 31250, 2.5)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "2025-01-01.bi5").write_bytes(lzma.compress(good, lzma.FORMAT_ALONE))
    (tmp_path / "d" / "2025-01-02.bi5").write_bytes(lzma.compress(struct.pack(">5if", 90000, 1, 1, 1, 1, 1.0), lzma.FORMAT_ALONE))
    rows = sources.packed_days(spark, str(tmp_path / "d"), "silver").orderBy("ms").collect()
    day = 1735689600000
    assert [(r.ms, r.open, r.high, r.low, r.close, r.volume) for r in rows[1:]] == [(day, 31.0, 31.2, 30.9, 31.1, 1250000.0), (day + 60000, 31.1, 31.25, 31.0, 31.05, 2500000.0)]
    assert "2025-01-02" in rows[0].error
    assert sources.decode_day(b"", date(2025, 1, 1)).empty
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "a.zip", "w") as z:
        z.writestr("a.csv", "20250101 000000;1;2;0.5;1;0\n20250101 000000;1;2;0.5;1;0\n20250101 000100;9;2;0.5;1;0\nbad\n20250101 000200;1;2;0.5;1;0\n")
    got = sources.zipped_rows(spark, str(tmp_path / "z"), "gold").orderBy("ms").collect()
    assert [r.ms - day for r in got] == [5 * 3600 * 1000, 5 * 3600 * 1000 + 120000]


def test_manifest_order_book_bundle_and_sinks(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"schema_version": 6, "metal": "silver", "champions": {"2": {"active_strategy": "persistence", "selected_challenger": "median", "metrics": {"mae": 7.2}}}}')
    r = sources.champions(spark, str(tmp_path / "m.json")).first()
    assert (r.metal, r.horizon_hours, r.active_strategy, r.metrics["mae"]) == ("silver", 2, "persistence", 7.2)
    xml = '<m><pitch securityId="AGX" considerationCurrency="USD"><buyPrices><price limit="2027"/></buyPrices><sellPrices><price limit="2042"/></sellPrices></pitch></m>'
    d = spark.createDataFrame([(xml,)], "x string").select(sources.order_book_midpoint(F.col("x"), "AGX").alias("a"), sources.order_book_midpoint(F.col("x"), "AUX").alias("b")).first()
    assert tuple(d) == (2034.5, None)
    b = sources.joined_bundle(spark.createDataFrame([("p2", "bG8="), ("p1", "aGVs\n")], "name string, part string")).first()
    assert bytes(b.content) == b"hello"
    n = sources.write_table(spark.createDataFrame([("s", 1.0)], "series string, x double"), str(tmp_path / "out"))
    assert n == 1
    with pytest.raises(ValueError):
        sources.write_table(spark.createDataFrame([], "x double"), str(tmp_path / "none"))


def test_streaming_bars_and_limits(spark, tmp_path):
    from quartzline.streaming import market as streaming

    rows = [("s", f"2025-01-01 0{h}:10:00", float(h)) for h in range(4)]
    spark.createDataFrame(rows, "series string, t string, price double").withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series string, price double, ts timestamp").parquet(str(tmp_path / "in"))
    q = streaming.hourly_bars(stream).writeStream.format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.open for r in spark.table("bars").orderBy("ts").collect()] == [0.0, 1.0, 2.0]
    q = streaming.keep_latest(streaming.distinct_ticks(stream), str(tmp_path / "latest"), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "latest" / "0")).first().price == 3.0


def test_candidates_pass_the_dual_gate(spark):
    d = hourly_frame(400)
    d["signal"] = np.r_[np.diff(np.log(d.close), n=1), 0.0][: len(d)]
    d["signal"] = d["signal"].rolling(2).sum().shift(-1).fillna(0.0)
    prepared = asof.with_target(spark.createDataFrame(d), 2).dropna(subset=["target_2h"]).cache()
    good = evaluation.ridge(0.01, prepared, "target_2h", "ridge")
    r = evaluation.select_champion(prepared, [good, evaluation.CrossFitted(good)], ["signal"], 2, 2).first()
    assert r.dev_gate and r.holdout_gate and r.active == r.selected
    noise = evaluation.select_champion(prepared.withColumn("signal", F.rand(1)), [good], ["signal"], 2, 2).first()
    assert noise.active == "persistence"


def test_boosted_forecast_takes_every_series_and_purges(spark, tmp_path, monkeypatch):
    from quartzline.plans import market

    events = [(i, t, datetime(2025, 1, 1) + pd.Timedelta(hours=i), 50.0 + i % 7) for t in market.SERIES for i in range(200)]
    spark.createDataFrame(events, "event_id long, event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    seen = []

    class Last:
        def fit_predict(self, train, rows, features, target):
            seen.append((train.agg(F.max("target_timestamp_24h")).first()[0], rows.agg(F.min("ts")).first()[0]))
            return rows.withColumn("raw", F.lit(0.0))

    monkeypatch.setattr(evaluation, "boosted", lambda **k: Last())
    got = {r.series for r in market.q_boosted_forecast(spark, str(tmp_path)).collect()}
    assert got == set(market.SERIES.values()) and len(seen) == 5 and all(a < b for a, b in seen)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rate_limits_and_exponential_means_stream(spark):
    rng = np.random.default_rng(3)
    events = [(c, int(us) * 1_000_000, i) for c, n in (("hot", 600), ("cold", 30)) for i, us in enumerate(np.sort(rng.integers(0, 3_000, n)))]
    got = windows.rate_limited(spark.createDataFrame(events, "client string, us long, id long"), 3)
    assert "FlatMapGroups" not in plan_of(got)
    got, held = {(r.client, r.id): r.allowed for r in got.collect()}, {"hot": [], "cold": []}
    assert len(got) == 630
    for c, us, i in events:
        ok = sum(t > us - 60_000_000 for t in held[c]) < 3
        held[c] += [us] if ok else []
        assert got[c, i] == ok
    x = [None if rng.random() < 0.3 else float(v) for v in rng.normal(size=300)]
    rows = [(s, datetime(2025, 1, 1) + pd.Timedelta(hours=i), v) for s in "ab" for i, v in enumerate(x)]
    got = windows.exponential(spark.createDataFrame(rows, "series string, ts timestamp, x double"), {"y": ("x", 0.1, 5), "z": ("x", 0.4, 0)})
    assert "FlatMapGroups" not in plan_of(got)
    for s in "ab":
        part = got.where(F.col("series") == s).orderBy("ts").toPandas()
        for name, alpha, least in (("y", 0.1, 5), ("z", 0.4, 0)):
            np.testing.assert_allclose(part[name], pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False, min_periods=least).mean(), rtol=1e-12)


def test_as_of_join_carries_rows_over_days_and_sorts_by_day(spark):
    day = lambda d, h=0: datetime(2025, 1, d, h)
    left = spark.createDataFrame([(i, day(d, h)) for i, (d, h) in enumerate([(1, 0), (2, 5), (2, 7), (6, 0), (9, 3)])], "i long, ts timestamp")
    right = spark.createDataFrame([(10, day(2, 6)), (11, day(2, 7)), (None, day(6, 1))], "v long, ts timestamp")
    got = asof.backward_asof(left, right, ["v"], "at")
    assert [(r.i, r.v, r["at"]) for r in got.orderBy("i").collect()] == [(0, None, None), (1, None, None), (2, 11, day(2, 7)), (3, 11, day(2, 7)), (4, None, day(6, 1))]
    assert "hashpartitioning(__day" in plan_of(got)
