"""Purged chronological splits, forecast metrics, selective shrinkage and champion selection."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzline.functions.exprs import finite, ratio
from quartzline.operators.boosting import Settings, Trees, fit_many
from quartzline.operators.quantiles import quantiles
from quartzline.session import discard, written

# The grid of the cross-fitted selection, the gate in percent, and the least rows for training.
QUANTILES = (0.5, 0.7, 0.8, 0.9, 0.95)
SHRINKAGES = (0.1, 0.25, 0.5, 0.75, 1.0)
GATE_PERCENT = 0.5
MIN_ROWS = 5_000
DEVELOPMENT_SHARE = 0.8


def numbered(df: DataFrame, by=("series",), ts: str = "ts") -> DataFrame:
    """Adds rn (0-based, by time) and n, the rows of the series, or replaces them.

    Positions come from the rows of each day and running sums over the days, so that no task sorts more than a day of a series. Null keys and times
    are values like others.
    """
    keys, df = [*by, "__day"], df.drop("rn", "n")
    d = df.withColumn("__day", F.date_trunc("day", ts))
    days = d.groupBy(*keys).agg(F.count("*").alias("__rows"))
    w = Window.partitionBy(*by).orderBy("__day")
    counted = {"__before": F.coalesce(F.sum("__rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("__rows").over(Window.partitionBy(*by))}
    days = days.withColumns(counted).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__before", "n")
    d = d.join(days, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]))
    at = F.col("__before") + F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1
    return d.withColumn("rn", at).select(*df.columns, "rn", "n")


def with_fold(df: DataFrame, splits: int) -> DataFrame:
    """Adds fold: 1 to splits for validation rows of the expanding split, 0 for rows that only train. Rows must carry rn and n."""
    size = F.floor(F.col("n") / (splits + 1))
    first = F.col("n") - splits * size
    return df.withColumn("fold", F.when(F.col("rn") >= first, F.floor((F.col("rn") - first) / size) + 1).otherwise(0).cast("int"))


def with_holdout(df: DataFrame, share: float = DEVELOPMENT_SHARE) -> DataFrame:
    """Adds development: the first int(n * share) rows."""
    return df.withColumn("development", F.col("rn") < F.floor(F.col("n") * F.lit(share)))


def training_rows(df: DataFrame, target_ts: str, lookback_days: int | None = None, by=("series",)) -> DataFrame:
    """(fold of validation, training row) pairs: rows of earlier folds whose target lies before the validation's first row.

    One row per fold a row trains for: folds are few. lookback_days keeps recent rows only.
    """
    bounds = df.where(F.col("fold") > 0).groupBy(*by, "fold").agg(F.min("ts").alias("start")).withColumnRenamed("fold", "valid_fold")
    d = df.join(bounds, list(by)).where((F.col("fold") < F.col("valid_fold")) & (F.col(target_ts) < F.col("start")))
    return d if lookback_days is None else d.where(F.col("ts") >= F.col("start") - F.make_dt_interval(days=F.lit(lookback_days)))


def holdout_split(df: DataFrame, target_ts: str) -> tuple[DataFrame, DataFrame]:
    """(training, holdout) rows by development; training rows whose target reaches into their series' holdout are left out."""
    rest = df.where(~F.col("development"))
    start = rest.groupBy("series").agg(F.min("ts").alias("__start"))
    return df.where("development").join(start, "series").where(F.col(target_ts) < F.col("__start")).drop("__start"), rest


def metrics(actual: str, predicted: str, current: str) -> list[Column]:
    """The record of forecast scores as aggregates over one pool of rows, in price space."""
    a, p, c = F.col(actual), F.col(predicted), F.col(current)
    d = F.abs(a) + F.abs(p)
    mae, base = F.avg(F.abs(a - p)), F.avg(F.abs(a - c))
    residual = F.ln(a) - F.ln(p)
    return [
        F.count("*").alias("rows_validated"),
        mae.alias("mae"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        (F.coalesce(F.avg(F.when(d > 0, 2 * F.abs(p - a) / d)), F.lit(0.0)) * 100).alias("smape_percent"),
        (F.avg((F.signum(a - c) == F.signum(p - c)).cast("double")) * 100).alias("directional_accuracy_percent"),
        base.alias("persistence_mae"),
        F.coalesce(ratio(base - mae, base) * 100, F.lit(0.0)).alias("improvement_percent"),
        F.percentile(residual, F.lit(0.1)).alias("residual_q10"),
        F.percentile(residual, F.lit(0.9)).alias("residual_q90"),
    ]


def scores(df: DataFrame, by: list[str], actual: str, predicted: str, current: str, *more: Column) -> DataFrame:
    """metrics() for each group of by, without a buffer of a whole group for the quantiles."""
    d = df.withColumn("__residual", F.ln(actual) - F.ln(predicted))
    spread = quantiles(d, by, "__residual", [0.1, 0.9], out="__q").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], "__q")
    m = d.groupBy(*by).agg(*metrics(actual, predicted, current)[:-2], *more)
    m = m.join(spread, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)]))
    return m.select(*m.columns[: len(by) + 7], F.col("__q")[0].alias("residual_q10"), F.col("__q")[1].alias("residual_q90"), *m.columns[len(by) + 7 : -len(by) - 1])


def price_mae(close: Column, target: Column, predicted: Column) -> Column:
    good = finite(close).isNotNull() & (close > 0) & finite(target).isNotNull() & finite(predicted).isNotNull()
    return F.coalesce(F.avg(F.when(good, F.abs(close * F.exp(target) - close * F.exp(predicted)))), F.avg(F.abs(target - predicted)), F.lit(float("inf")))


def walk_forward_median(df: DataFrame, h: int, splits: int, lookback_days: int | None = None, by=("series",)) -> DataFrame:
    """Validation rows with the median return of their fold's purged training rows as prediction, all folds pooled."""
    d = with_fold(numbered(df, by), splits)
    fits = quantiles(training_rows(d, f"target_timestamp_{h}h", lookback_days, by), [*by, "valid_fold"], f"target_{h}h", [0.5])
    fits = fits.select(*by, F.col("valid_fold").alias("fold"), F.col("quantiles")[0].alias("predicted_return"))
    return d.join(fits, [*by, "fold"]).withColumn("predicted", F.col("close") * F.exp("predicted_return"))


def selective(raw: Column, threshold: Column, shrinkage) -> Column:
    """Abstains under the threshold, shrinks above."""
    return F.when(F.abs(raw) >= threshold, raw * shrinkage).otherwise(0.0)


def selective_grid(oof: DataFrame, by=("series",), raw: str = "raw", target: str = "target", close: str = "close", shares=QUANTILES, shrinkages=SHRINKAGES) -> DataFrame:
    """The best (quantile, shrinkage) per series by price error, persistence winning ties; quantile null means always abstain.

    All pairs are conditional aggregates of one pass; the thresholds come from one aggregate before it.
    """
    q = quantiles(oof.withColumn("__abs", F.abs(raw)), list(by), "__abs", list(shares), out="__t")
    d = oof.join(q, list(by))
    grid = [(i, j) for i in range(len(shares)) for j in range(len(shrinkages))]
    errors = [price_mae(F.col(close), F.col(target), F.lit(0.0)).alias("e")]
    errors += [price_mae(F.col(close), F.col(target), selective(F.col(raw), F.col("__t")[i], shrinkages[j])).alias(f"e{k}") for k, (i, j) in enumerate(grid)]
    d = d.groupBy(*by).agg(*errors)
    null = F.lit(None).cast("double")
    pairs = [F.struct(F.col("e").alias("mae"), F.lit(-1).alias("at"), null.alias("quantile"), null.alias("shrinkage"))]
    pairs += [F.struct(F.col(f"e{k}").alias("mae"), F.lit(k).alias("at"), F.lit(shares[i]).alias("quantile"), F.lit(shrinkages[j]).alias("shrinkage")) for k, (i, j) in enumerate(grid)]
    return d.select(*by, F.col("e").alias("persistence_mae"), F.array_min(F.array(*pairs)).alias("b")).select(*by, "persistence_mae", F.col("b.mae").alias("best_mae"), F.col("b.quantile").alias("quantile"), F.col("b.shrinkage").alias("shrinkage"))


def champion(scores: DataFrame, by=("series",), gate: float = GATE_PERCENT) -> DataFrame:
    """The challenger of the least development error (earliest on ties), active only where both gates hold, else persistence.

    scores: (by, name, position, dev_mae, dev_improvement, holdout_improvement).
    """
    best = scores.groupBy(*by).agg(F.min_by(F.struct("name", "dev_mae", "dev_improvement", "holdout_improvement"), F.struct("dev_mae", "position")).alias("w"))
    d = best.select(*by, F.col("w.name").alias("selected"), (F.col("w.dev_improvement") >= gate).alias("dev_gate"), (F.col("w.holdout_improvement") >= gate).alias("holdout_gate"))
    return d.withColumn("active", F.when(F.col("dev_gate") & F.col("holdout_gate"), F.col("selected")).otherwise("persistence"))


@dataclass(frozen=True)
class Fitted:
    """A fitted forecaster: a model over feature columns or a constant return, and the selective shrinkage of what it gives, if any.

    threshold: None for no shrinkage, infinite for a forecaster that always abstains.
    """

    name: str
    model: PipelineModel | Trees | Linear | None = None
    constant: float = 0.0
    threshold: float | None = None
    shrinkage: float = 1.0

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with raw, the predicted return; rows without all features are left out where there is a model."""
        out = rows.withColumn("raw", F.lit(self.constant)) if self.model is None else self.model.transform(rows).withColumnRenamed("prediction", "raw").drop("features")
        return out if self.threshold is None else out.withColumn("raw", selective(F.col("raw"), F.lit(self.threshold), self.shrinkage))

    def values(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.constant) if self.model is None else self.model.predict(x)
        return raw if self.threshold is None else np.where(np.abs(raw) >= self.threshold, raw * self.shrinkage, 0.0)


def predict_each(fits: dict[object, Fitted], rows: DataFrame, features: list[str], by: str) -> DataFrame:
    """rows with raw, each from the forecaster of its value of by, in one pass; rows of other values or without all features are left out."""
    if any(isinstance(f.model, PipelineModel) for f in fits.values()):
        return reduce(DataFrame.unionByName, [f.predict(rows.where(F.col(by) == k)) for k, f in fits.items()])
    kept = rows.where(F.col(by).isin(*fits)).dropna(subset=features)
    schema = kept.withColumn("raw", F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in features]) if features else np.empty((batch.num_rows, 0))
            key, raw = np.array(batch.column(by).to_pylist(), dtype=object), np.zeros(batch.num_rows)
            for k in dict.fromkeys(key):
                raw[key == k] = fits[k].values(x[key == k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw)], names=[*batch.schema.names, "raw"])

    return kept.mapInArrow(run, schema)


class Estimator(Protocol):
    """What candidates have in common: a name, how far back they train, and fits: one Fitted for each value of a column, all in the same jobs."""

    name: str
    lookback_days: int | None

    def fits(self, rows: DataFrame, features: list[str], target: str, by: str) -> dict[object, Fitted]: ...

    def fit(self, train: DataFrame, features: list[str], target: str) -> Fitted: ...


def lookback_name(base: str, lookback_days: int | None) -> str:
    return base if lookback_days is None else f"{base}_lookback_{lookback_days}d"


class FitPredict:
    def fit(self, train: DataFrame, features: list[str], target: str) -> Fitted:
        found = self.fits(train.withColumn("__all", F.lit("all")), features, target, "__all")
        if not found:
            raise ValueError(f"{self.name}: no complete training rows")
        return found["all"]

    def fit_predict(self, train: DataFrame, rows: DataFrame, features: list[str], target: str) -> DataFrame:
        return self.fit(train, features, target).predict(rows)


@dataclass(frozen=True)
class Forecaster(FitPredict):
    """A named MLlib estimator over feature columns, fitted once for each value. Predictions are returns."""

    name: str
    estimator: object
    lookback_days: int | None = None

    def fits(self, rows: DataFrame, features: list[str], target: str, by: str) -> dict[object, Fitted]:
        return {r[0]: self.fit(rows.where(F.col(by) == r[0]), features, target) for r in rows.select(by).distinct().collect()}

    def fit(self, train: DataFrame, features: list[str], target: str) -> Fitted:
        into = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
        rows = into.transform(train.where(F.col(target).isNotNull())).select("features", F.col(target).alias("label"))
        return Fitted(self.name, PipelineModel([into, self.estimator.fit(rows)]))


@dataclass(frozen=True)
class Boosted(FitPredict):
    """Boosted trees for absolute error, see boosting.fit_many."""

    name: str = "boosted"
    settings: Settings = Settings()
    lookback_days: int | None = None

    def fits(self, rows: DataFrame, features: list[str], target: str, by: str) -> dict[object, Fitted]:
        return {k: Fitted(self.name, m) for k, m in fit_many(rows, features, target, by, self.settings).items()}


def median_boosted(name: str = "boosted", iterations: int = 350, step: float = 0.05, depth: int | None = None, leaves: int = 31, l2: float = 1.0) -> Boosted:
    return Boosted(name, Settings(iterations, step, leaves, l2, depth=depth))


def boosted(name: str = "boosted", iterations: int = 40, step: float = 0.05, depth: int = 5, seed: int = 42) -> Forecaster:
    """MLlib's trees under the same protocol; their leaves hold means of signs where median_boosted() has medians."""
    return Forecaster(name, GBTRegressor(lossType="absolute", maxIter=iterations, stepSize=step, maxDepth=depth, seed=seed))


@dataclass
class Linear:
    """A linear forecast as a column expression."""

    features: list[str]
    weights: list[float]
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ np.array(self.weights) + self.intercept

    def transform(self, rows: DataFrame) -> DataFrame:
        total = F.lit(self.intercept)
        for f, w in zip(self.features, self.weights, strict=True):
            total = total + F.col(f) * F.lit(w)
        return rows.dropna(subset=self.features).withColumn("prediction", total)

    def to_json(self) -> str:
        return json.dumps(vars(self))

    @staticmethod
    def from_json(text: str) -> Linear:
        return Linear(**json.loads(text))

    def save(self, path: str) -> None:
        SparkSession.active().createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.text(path)


def grams(rows: DataFrame, columns: list[str], by: str) -> dict[object, tuple[int, np.ndarray, np.ndarray]]:
    """by -> (rows, means, sums of products of deviations) of the columns, in one job. Partial ones of batches merge by Chan's formula, so no digits are lost
    to large means; the driver gets one square matrix a value. Rows with a missing column don't count.
    """
    d = rows.select(F.col(by).cast("string").alias("__k"), *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)]).dropna()
    width = len(columns)

    def merged(a, b):
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def packed(found):
        if not found:
            return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.binary())], names=["k", "part"])
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([np.concatenate([[n], m, p.ravel()]).tobytes() for n, m, p in found.values()], pa.binary())], names=["k", "part"])

    def part(batches):
        found = {}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]) if batch.num_rows else np.empty((0, width))
            key = np.array(batch.column(0).to_pylist(), dtype=object)
            for k in dict.fromkeys(key):
                own = x[key == k]
                mean = own.mean(axis=0)
                one = (len(own), mean, (own - mean).T @ (own - mean))
                found[k] = merged(found[k], one) if k in found else one
        yield packed(found)

    def unpacked(raw):
        v = np.frombuffer(raw)
        return int(v[0]), v[1 : width + 1], v[width + 1 :].reshape(width, width)

    def whole(batches):
        found = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[k] = merged(found[k], unpacked(raw)) if k in found else unpacked(raw)
        yield packed(found)

    sums = d.mapInArrow(part, "k string, part binary").repartition("k").mapInArrow(whole, "k string, part binary").collect()
    own = {str(r[0]): r[0] for r in rows.select(by).distinct().collect()}
    return {own[r.k]: unpacked(r.part) for r in sums}


@dataclass(frozen=True)
class Ridge(FitPredict):
    """Ridge on standardised columns, from one matrix of products for each fit: all folds, lookbacks and horizons are one pass over the rows."""

    alpha: float
    label: str | None = None
    lookback_days: int | None = None

    @property
    def name(self) -> str:
        return self.label or lookback_name(f"ridge_alpha_{self.alpha:g}", self.lookback_days)

    def fits(self, rows: DataFrame, features: list[str], target: str, by: str) -> dict[object, Fitted]:
        out = {}
        for k, (n, mean, products) in grams(rows, [*features, target], by).items():
            sd = np.sqrt(np.diag(products)[:-1] / n)
            sd = np.where(sd > 0, sd, 1.0)
            z = products[:-1, :-1] / np.outer(sd, sd)
            w = np.linalg.solve(z + self.alpha * np.eye(len(sd)), products[:-1, -1] / sd) / sd
            out[k] = Fitted(self.name, Linear(list(features), [float(v) for v in w], float(mean[-1] - w @ mean[:-1])))
        return out


def ridge(alpha: float, train: DataFrame | None = None, target: str | None = None, name: str = "ridge") -> Ridge:
    """Ridge(alpha, name). train and target are not looked at: the penalty follows the rows of each fit."""
    return Ridge(alpha, name)


@dataclass(frozen=True)
class MedianReturn(FitPredict):
    """The median return of the training rows, 0 without any."""

    lookback_days: int | None = None

    @property
    def name(self) -> str:
        return lookback_name("median_return", self.lookback_days)

    def fits(self, rows: DataFrame, features: list[str], target: str, by: str) -> dict[object, Fitted]:
        found = quantiles(rows, [by], target, [0.5]).collect()
        return {r[by]: Fitted(self.name, constant=(r["quantiles"] or [None])[0] or 0.0) for r in found}

    def fit(self, train: DataFrame, features: list[str], target: str) -> Fitted:
        return self.fits(train.withColumn("__all", F.lit("all")), features, target, "__all").get("all", Fitted(self.name))


def shrunk_each(name: str, fits: dict[object, Fitted], rows: DataFrame, features: list[str], by: str, rules: dict[object, tuple[float, float] | None]) -> dict[object, Fitted]:
    """fits with the threshold that is a quantile of what each predicts for its own training rows. rules: (quantile, shrinkage) of each, None to abstain always."""
    shares = sorted({r[0] for r in rules.values() if r})
    found = {}
    if shares:
        raw = predict_each(fits, rows, features, by).select(by, F.abs("raw").alias("__abs"))
        found = {r[by]: dict(zip(shares, r["quantiles"] or [], strict=False)) for r in quantiles(raw, [by], "__abs", shares).collect()}
    out = {}
    for k, f in fits.items():
        rule = rules.get(k)
        threshold = found.get(k, {}).get(rule[0]) if rule else None
        out[k] = replace(f, name=name, threshold=float("inf") if threshold is None else threshold, shrinkage=rule[1] if rule else 1.0)
    return out


@dataclass(frozen=True)
class Selective(FitPredict):
    """A forecaster that abstains under a quantile of its own predictions and shrinks above it."""

    base: Estimator
    quantile: float = 0.8
    shrinkage: float = 0.25
    lookback_days: int | None = None

    @property
    def name(self) -> str:
        return lookback_name(f"selective_{self.base.name}_q{round(self.quantile * 100)}_s{round(self.shrinkage * 100)}", self.lookback_days)

    def fits(self, rows: DataFrame, features: list[str], target: str, by: str) -> dict[object, Fitted]:
        fits = self.base.fits(rows, features, target, by)
        return shrunk_each(self.name, fits, rows, features, by, dict.fromkeys(fits, (self.quantile, self.shrinkage)))


@dataclass(frozen=True)
class CrossFitted(FitPredict):
    """Selective shrinkage whose quantile and shrinkage come from inner out-of-fold predictions; abstains always where nothing beats persistence.

    Inner and outer models of all values are fitted together.
    """

    base: Estimator
    splits: int = 3
    name: str = "cross_fitted"
    lookback_days: int | None = None

    def fits(self, rows: DataFrame, features: list[str], target: str, by: str) -> dict[object, Fitted]:
        d = written(with_fold(numbered(rows.where(F.col(by).isNotNull()), (by,)), self.splits).withColumnRenamed("fold", "__inner"), "inner-folds")
        key = lambda k: F.concat(F.col(by).cast("string"), F.lit("#"), k.cast("string"))
        later = F.array(*[F.lit(k) for k in range(self.splits + 1)])  # 0 is the outer fit, to all rows
        train = d.withColumn("__for", F.explode(F.filter(later, lambda k: (k == 0) | (F.col("__inner") < k)))).withColumn("__key", key(F.col("__for")))
        fits = self.base.fits(train, features, target, "__key")
        own = {str(r[0]): r[0] for r in d.select(by).distinct().collect()}
        outer = {own[k[:-2]]: f for k, f in fits.items() if k.endswith("#0")}
        inner = predict_each({k: f for k, f in fits.items() if not k.endswith("#0")}, d.where(F.col("__inner") > 0).withColumn("__key", key(F.col("__inner"))), features, "__key")
        best = {r[by]: r for r in selective_grid(inner, by=(by,), target=target).collect()}
        rules = {k: (best[k]["quantile"], best[k]["shrinkage"]) if k in best and best[k]["quantile"] is not None else None for k in outer}
        return shrunk_each(self.name, outer, d, features, by, rules)


def require_rows(df: DataFrame, least: int = MIN_ROWS) -> int:
    n = df.count()
    if n < least:
        raise ValueError(f"{n} rows; at least {least} are needed")
    return n


def walk_forward(df: DataFrame, base: Estimator, features: list[str], h: int, splits: int) -> DataFrame:
    """Out-of-fold predictions of one series, all folds pooled: each fold's model sees purged earlier rows only. Folds without training rows are left out."""
    d = written(with_fold(numbered(df), splits), "folds").withColumn("__all", F.lit("all"))
    out = walked(d, base, features, f"target_{h}h", f"target_timestamp_{h}h", "__all")
    return out.drop("__all")


def walked(folds: DataFrame, base: Estimator, features: list[str], target: str, reached: str, by: str) -> DataFrame:
    """Out-of-fold predictions of every value of by and fold, whose models are fitted together. folds: a written table with fold."""
    key = lambda fold: F.concat_ws("|", F.col(by).cast("string"), F.col(fold).cast("string"))
    train = training_rows(folds, reached, base.lookback_days, (by,)).withColumn("__key", key("valid_fold"))
    fits = base.fits(train, features, target, "__key")
    if not fits:
        raise ValueError("no fold has training rows")
    out = predict_each(fits, folds.where(F.col("fold") > 0).withColumn("__key", key("fold")), features, "__key")
    return out.drop("__key").withColumn("predicted", F.col("close") * F.exp("raw"))


def recent(df: DataFrame, last, lookback_days: int | None) -> DataFrame:
    """Rows of at most so many days before last."""
    return df if lookback_days is None else df.where(F.col("ts") >= F.lit(last) - F.make_dt_interval(days=F.lit(lookback_days)))


@dataclass(frozen=True)
class Selection:
    """The candidate of the least development error, its scores, and what the two gates say."""

    winner: int
    names: tuple[str, ...]
    development: tuple[dict, ...]
    challenger: dict
    persistence: dict
    holdout_start: object
    gate: float

    @property
    def selected(self) -> str:
        return self.names[self.winner]

    @property
    def gates(self) -> tuple[bool, bool]:
        return self.development[self.winner]["improvement_percent"] >= self.gate, self.challenger["improvement_percent"] >= self.gate

    @property
    def active(self) -> str:
        return self.selected if all(self.gates) else "persistence"

    @property
    def metrics(self) -> dict:
        return self.challenger if all(self.gates) else self.persistence


def select_many(tables: dict[int, DataFrame], candidates: list[Estimator], features: list[str], splits: int, min_rows: int = 0, share: float = DEVELOPMENT_SHARE, gate: float = GATE_PERCENT) -> dict[int, Selection]:
    """Walk-forward scores of all candidates on the development rows of every horizon, then one purged fit of the best, scored on the holdout once.

    tables: horizon -> prepared rows of one series. Horizons and folds are one long table, so a candidate's fits of all of them are the same jobs.
    """
    if not 0.6 <= share <= 0.9:
        raise ValueError("the holdout takes 10% to 40% of the rows")
    parts = [d.select(F.lit(h).alias("__h"), "ts", "close", F.col(f"target_{h}h").alias("__y"), F.col(f"future_close_{h}h").alias("__future"), F.col(f"target_timestamp_{h}h").alias("__reached"), *[F.col(f) for f in features]) for h, d in tables.items()]
    d = written(with_holdout(numbered(reduce(DataFrame.unionByName, parts), ("__h",)), share).drop("rn", "n"), "selection")
    dev, rest = d.where("development").drop("development"), d.where("not development").drop("development")
    counts = {r["__h"]: r for r in d.groupBy("__h").agg(F.count_if("development").alias("dev"), F.min(F.when(~F.col("development"), F.col("ts"))).alias("start")).collect()}
    for h in tables:
        if h not in counts or counts[h]["start"] is None:
            raise ValueError("no rows are left for the holdout")
        if counts[h]["dev"] < min_rows:
            raise ValueError(f"{counts[h]['dev']} rows; at least {min_rows} are needed")
    by_h = lambda rows, *more: {r["__h"]: {k: v for k, v in r.asDict().items() if k != "__h"} for r in scores(rows, ["__h"], "__future", "predicted", "close", *more).collect()}
    folds = written(with_fold(numbered(dev, ("__h",)), splits), "folds")
    found = [by_h(walked(folds, c, features, "__y", "__reached", "__h"), F.countDistinct("fold").alias("completed_folds")) for c in candidates]
    best = {h: min(range(len(candidates)), key=lambda k: (found[k][h]["mae"], k)) for h in tables}
    start = reduce(lambda x, h: F.when(F.col("__h") == h, F.lit(counts[h]["start"])).otherwise(x), tables, F.lit(None))
    train, held = dev.where(F.col("__reached") < start), {}
    for k in sorted(set(best.values())):
        own = train.where(F.col("__h").isin(*[h for h in tables if best[h] == k]))
        days = candidates[k].lookback_days
        fits = candidates[k].fits(own if days is None else own.where(F.col("ts") >= start - F.make_dt_interval(days=F.lit(days))), features, "__y", "__h")
        held |= fits
    if set(held) != set(tables):
        raise ValueError("no purged development rows remain before the holdout")
    challengers = by_h(predict_each(held, rest, features, "__h").withColumn("predicted", F.col("close") * F.exp("raw")))
    persistence = by_h(rest.withColumn("predicted", F.col("close")))
    discard(folds, d)
    names = tuple(c.name for c in candidates)
    return {h: Selection(best[h], names, tuple(f[h] for f in found), challengers[h], persistence[h], counts[h]["start"], gate) for h in tables}


def select(df: DataFrame, candidates: list[Estimator], features: list[str], h: int, splits: int, min_rows: int = 0, share: float = DEVELOPMENT_SHARE, gate: float = GATE_PERCENT) -> Selection:
    """select_many() of one horizon."""
    return select_many({h: df}, candidates, features, splits, min_rows, share, gate)[h]


def select_champion(df: DataFrame, candidates: list, features: list[str], h: int, splits: int, min_rows: int = 0) -> DataFrame:
    """The dual gate over fitted candidates, see select(). One row: selected, the two gates and active, as champion() gives it."""
    s = select(df, candidates, features, h, splits, min_rows)
    outer = lambda k: s.challenger["improvement_percent"] if k == s.winner else None
    scores = [("all", name, k, s.development[k]["mae"], s.development[k]["improvement_percent"], outer(k)) for k, name in enumerate(s.names)]
    return champion(df.sparkSession.createDataFrame(scores, "series string, name string, position int, dev_mae double, dev_improvement double, holdout_improvement double"))
