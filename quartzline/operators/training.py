"""From hourly bars to persisted champions and back to forecasts: prepare, select, refit, save, load, predict."""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzline.functions.exprs import HORIZONS, direction, percent_change
from quartzline.operators import asof, evaluation, features
from quartzline.operators.boosting import Trees
from quartzline.operators.evaluation import CrossFitted, Estimator, Fitted, Linear, MedianReturn, Selection, Selective, median_boosted, recent
from quartzline.session import written
from quartzline.sources.market import moved, standing


@dataclass(frozen=True)
class Config:
    # The production settings of training.
    min_rows: int = evaluation.MIN_ROWS
    splits: int = 5
    iterations: int = 350
    step: float = 0.05
    leaves: int = 31
    l2: float = 1.0
    depth: int | None = None
    gate: float = evaluation.GATE_PERCENT


def candidates(config: Config) -> list[Estimator]:
    """The production candidates: the median, a fixed selective rule, and the cross-fitted one."""
    base = median_boosted("gbt", config.iterations, config.step, config.depth, config.leaves, config.l2)
    return [MedianReturn(), Selective(base, 0.8, 0.25), CrossFitted(base, 3, "cross_fitted_selective_gbt")]


def feature_base(bars: DataFrame, series: str, providers=()) -> DataFrame:
    """The bars of one series with all their features and those of context markets, computed once for all horizons."""
    d = features.build_features(bars.where(F.col("series") == series))
    return written(asof.with_providers(d, bars, providers), "feature-base")


def prepared(base: DataFrame, h: int, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(rows in which all features and the target of h hours are there, the features): features first, then targets, then the cut."""
    if h not in HORIZONS:
        raise ValueError(f"horizon {h}h is not supported")
    columns = columns or features.feature_columns(base)
    d = asof.with_target(base.where(F.col("close").isNotNull()), h)
    return d.dropna(subset=[*columns, "close", f"target_{h}h", f"future_close_{h}h", f"target_timestamp_{h}h"]), columns


@dataclass(frozen=True)
class Artifact:
    """A persisted decision: everything about it in record, and the refitted challenger."""

    record: dict
    fitted: Fitted


def train_many(base: DataFrame, series: str, horizons, config: Config, choices: list[Estimator] | None = None, columns: list[str] | None = None, providers=()) -> list[Artifact]:
    """Selects on development rows, checks on the holdout, then refits each horizon's winner to all rows of its lookback; all horizons in the same jobs."""
    names = columns or features.feature_columns(base)
    tables = {h: written(prepared(base, h, names)[0], "prepared") for h in horizons}
    counts = {h: evaluation.require_rows(d, config.min_rows) for h, d in tables.items()}
    choices = choices or candidates(config)
    least = min(min(config.min_rows, int(n * evaluation.DEVELOPMENT_SHARE)) for n in counts.values())
    chosen = evaluation.select_many(tables, choices, names, config.splits, least, gate=config.gate)
    final = {h: recent(d, d.agg(F.max("ts")).first()[0], choices[chosen[h].winner].lookback_days) for h, d in tables.items()}
    fitted = {}
    for k in sorted({s.winner for s in chosen.values()}):
        parts = [final[h].select(F.lit(h).alias("__h"), "ts", "close", F.col(f"target_{h}h").alias("__y"), *[F.col(c) for c in names]) for h in horizons if chosen[h].winner == k]
        fitted |= choices[k].fits(written(reduce(DataFrame.unionByName, parts), "refit"), names, "__y", "__h")
    out = []
    for h in horizons:
        s: Selection = chosen[h]
        count, first, last = final[h].agg(F.count("*"), F.min("ts"), F.max("ts")).first()
        record = {
            "schema_version": 6, "metal": series, "horizon_hours": h, "feature_columns": names, "trained_at_utc": datetime.now(UTC).isoformat(), "training_rows": count, "training_start_utc": first.isoformat(), "training_end_utc": last.isoformat(),
            "candidate_training_lookback_days": choices[s.winner].lookback_days, "training_config": asdict(config), "exogenous_features": [asof.PROVIDERS[p].metadata() for p in providers], "active_strategy": s.active, "selected_challenger": s.selected,
            "selection": {"development_candidates": dict(zip(s.names, s.development, strict=True)), "challenger_holdout_metrics": s.challenger, "holdout_start_utc": s.holdout_start.isoformat(), "development_qualified": s.gates[0], "holdout_qualified": s.gates[1], "promotion_threshold_pct": s.gate},
            "metrics": s.metrics | {"rows_total": counts[h]},
        }
        out.append(Artifact(record, fitted[h]))
    return out


def train(base: DataFrame, series: str, h: int, config: Config, choices: list[Estimator] | None = None, columns: list[str] | None = None, providers=()) -> Artifact:
    """train_many() of one horizon."""
    return train_many(base, series, (h,), config, choices, columns, providers)[0]


def folder_sha256(spark: SparkSession, path: str) -> str:
    """One digest over the names and digests of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.regexp_extract("path", f"/{path.rstrip('/').rsplit('/', 1)[-1]}/(.*)$", 1).alias("name"), F.sha2("content", 256).alias("digest")).where(~F.col("name").rlike(r"(^|/)[._][^/]*\.crc$"))
    return hashlib.sha256("".join(sorted(f"{r.name}:{r.digest}\n" for r in files.collect())).encode()).hexdigest()


def place(root: str, series: str, h: int) -> str:
    return f"{root.rstrip('/')}/{series}/{series}_{h}h"


def save(spark: SparkSession, root: str, artifact: Artifact) -> str:
    """Writes model and record beside the old ones and puts them in their place as a whole. Returns the folder."""
    r, f = artifact.record, artifact.fitted
    target = place(root, r["metal"], r["horizon_hours"])
    part = f"{target}.part-{uuid.uuid4().hex}"
    kept = {"name": f.name, "constant": f.constant, "threshold": None if f.threshold is None else repr(f.threshold), "shrinkage": f.shrinkage, "model": type(f.model).__name__ if f.model is not None else None}
    digest = ""
    if f.model is not None:
        f.model.save(f"{part}/model")
        digest = folder_sha256(spark, f"{part}/model")
    record = json.dumps(r | {"fitted": kept, "model_sha256": digest}, sort_keys=True)
    both = [(record, hashlib.sha256(record.encode()).hexdigest())]
    spark.createDataFrame(both, "record string, sha256 string").coalesce(1).write.json(f"{part}/record")
    moved(spark, part, target)
    return target


def load(spark: SparkSession, root: str, series: str, h: int) -> Artifact:
    """The artifact of a series and horizon; an error where there is none or where its checksums don't hold."""
    folder = standing(spark, place(root, series, h))
    row = spark.read.schema("record string, sha256 string").json(f"{folder}/record").first()
    if row is None or not hmac.compare_digest(hashlib.sha256(row.record.encode()).hexdigest(), row.sha256):
        raise ValueError(f"{folder}: the record's checksum doesn't hold")
    record = json.loads(row.record)
    kept = record["fitted"]
    model = None
    if kept["model"]:
        if not hmac.compare_digest(folder_sha256(spark, f"{folder}/model"), record["model_sha256"]):
            raise ValueError(f"{folder}: the model's checksum doesn't hold")
        text = {"Trees": Trees, "Linear": Linear}.get(kept["model"])
        model = text.from_json(spark.read.text(f"{folder}/model").first()[0]) if text else PipelineModel.load(f"{folder}/model")
    return Artifact(record, Fitted(kept["name"], model, kept["constant"], None if kept["threshold"] is None else float(kept["threshold"]), kept["shrinkage"]))


def available(spark: SparkSession, *roots: str) -> DataFrame:
    """(series, horizons) of all artifacts below any of the roots whose records hold."""
    d = spark.read.schema("record string, sha256 string").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.json").json(list(roots))
    d = d.where(F.sha2("record", 256) == F.col("sha256")).select(F.from_json("record", "metal string, horizon_hours int").alias("r"))
    return d.where(F.col("r.horizon_hours").isin(*HORIZONS)).groupBy(F.col("r.metal").alias("series")).agg(F.sort_array(F.collect_set("r.horizon_hours")).alias("horizons"))


def train_all(bars: DataFrame, series: str, root: str, horizons=HORIZONS, config: Config = Config(), choices=None, columns=None, providers=()) -> list[Artifact]:
    """Trains, saves and reports all horizons of a series over one feature base."""
    unknown = [h for h in horizons if h not in HORIZONS]
    if unknown:
        raise ValueError(f"horizons {unknown} are not supported")
    if not horizons:
        return []
    spark = bars.sparkSession
    done = train_many(feature_base(bars, series, providers), series, horizons, config, choices, columns, providers)
    for a in done:
        save(spark, root, a)
    keys = ("horizon_hours", "active_strategy", "selected_challenger", "candidate_training_lookback_days")
    report = {"metal": series, "trained_at_utc": datetime.now(UTC).isoformat(), "horizons_hours": list(horizons), "feature_base_reused_across_horizons": True, "horizon_status": [{k: a.record[k] for k in keys} for a in done], "metrics": [a.record["metrics"] for a in done]}
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/{series}/{series}_training_report")
    return done


def forecast(latest: DataFrame, artifact: Artifact) -> DataFrame:
    """The prediction row of a latest row (series, ts, close, raw): price, 80% interval, change, and what the record says of the model."""
    r, m = artifact.record, artifact.record["metrics"]
    price = lambda x: F.col("close") * F.exp(x)
    d = latest.select(
        F.lit(r["metal"]).alias("metal"), F.col("ts").alias("timestamp_utc"), (F.col("ts") + F.make_interval(hours=F.lit(r["horizon_hours"]))).alias("target_timestamp_utc"), F.lit(r["horizon_hours"]).alias("horizon_hours"),
        F.lit(r["active_strategy"]).alias("active_strategy"), F.lit(r["selected_challenger"]).alias("selected_challenger"), F.col("close").alias("current_usd_per_kg"), price(F.col("raw")).alias("predicted_usd_per_kg"),
        price(F.col("raw") + m["residual_q10"]).alias("prediction_interval_80_low_usd_per_kg"), price(F.col("raw") + m["residual_q90"]).alias("prediction_interval_80_high_usd_per_kg"),
    )
    change = percent_change(F.col("predicted_usd_per_kg"), F.col("current_usd_per_kg"))
    said = {"validation_mae_usd_per_kg": m["mae"], "validation_directional_accuracy_pct": m["directional_accuracy_percent"], "validation_improvement_vs_persistence_pct": m["improvement_percent"]}
    return d.select("*", change.alias("predicted_change_pct"), direction(change).alias("direction"), *[F.lit(v).cast("double").alias(k) for k, v in said.items()])


def persistence_forecast(quote: DataFrame, artifact: Artifact) -> DataFrame:
    """The forecast from a live quote (series, ts, close) alone; an error unless the champion is persistence."""
    if artifact.record["active_strategy"] != "persistence":
        raise ValueError("the active champion needs features")
    return forecast(quote.withColumn("raw", F.lit(0.0)), artifact)


def latest_forecast(bars: DataFrame, artifact: Artifact) -> DataFrame:
    """The forecast from bars: of the last close for persistence, else of the last row that has all features, context markets included."""
    series = artifact.record["metal"]
    if artifact.record["active_strategy"] == "persistence":
        last = bars.where((F.col("series") == series) & F.col("close").isNotNull()).agg(F.max_by(F.struct("ts", "close"), "ts").alias("r")).select("r.*")
        rows = last.where(F.col("ts").isNotNull()).withColumn("raw", F.lit(0.0))
    else:
        names = {p.metadata()["name"]: p.name for p in asof.PROVIDERS.values()}
        d = features.build_features(bars.where(F.col("series") == series))
        d = asof.with_providers(d, bars, [names.get(m["name"], m["name"]) for m in artifact.record["exogenous_features"]])
        last = d.dropna(subset=[*artifact.record["feature_columns"], "close"]).orderBy(F.desc("ts")).limit(1)
        rows = artifact.fitted.predict(last)
    if rows.isEmpty():
        raise ValueError(f"{series}: no complete row to forecast from")
    return forecast(rows, artifact)
