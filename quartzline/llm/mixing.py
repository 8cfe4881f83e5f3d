"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the budget by its weight. Sources whose share exceeds the maximum number of epochs are clamped there and
the excess goes to the others in proportion to their weights, until none exceeds. A target of 1.4 times a source takes each
of its documents once, and 40% of its words again. The repeated part is the head of the source in a seeded hash order.

Only ids, sizes and hashes are shuffled. The cut in hash order is found in two steps, first among 4096 buckets of the hash, then within
the one bucket that it falls into, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzline.llm.text_stats import word_count
from quartzline.session import counted, rows, written

WEIGHTS = (5, 2, 1)
EPOCHS = 2
BUDGET = 1.5
SEED = "mix-1"
#: Up to so many sources the table of sources is broadcast to the documents; above, it joins by a shuffle.
BROADCAST_SOURCES = 20_000


def source_key(source: Column) -> Column:
    """Sorts like the source by code point, null last."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source))


def draw(key: Column, text: Column, seed: str = SEED) -> Column:
    """The seeded hash that orders documents: 32 hex digits of the key, or of the text where the key is null."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))))


def water_fill(sizes: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, budget: float = BUDGET) -> DataFrame:
    """Adds target to (source_key, source_size): one row per source, all targets summing to budget times all sizes.

    The clamped sources are those of the least cap a weight, so one ordered pass finds the level at which the redistribution ends. The
    pass orders the table of sources, one row each, in one task; no document passes through it. Sources of size 0 get target 0.
    """
    by_name = Window.orderBy("source_key")
    d = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    d = d.withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    every = Window.partitionBy()
    d = d.withColumns(
        {
            "at": F.row_number().over(order),
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "all": F.sum("source_size").over(every),
        }
    )
    d = d.withColumn("level", (F.col("all") * budget - F.col("before")) / F.col("rest"))
    level = F.min_by(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")), F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("at"))).over(every)
    return d.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))).select("source_key", "source_size", "target")


def near(df: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    return df.join(F.broadcast(sources) if n <= BROADCAST_SOURCES else sources, "source_key")


def plan_mix(ids: DataFrame, **options) -> DataFrame:
    """Per source: source_size, target, whole (repetitions of all its documents), cut and best (hashes that choose one more).

    ids: (source_key, size, draw), written before.
    """
    sources = counted(water_fill(ids.groupBy("source_key").agg(F.sum("size").alias("source_size")), **options), "mix-sources")
    n = rows(sources)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", ratio).withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size"))
    bucket = F.substring("draw", 1, 3)
    sums = ids.groupBy("source_key", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source_key").orderBy("bucket")
    sums = near(sums.withColumn("cum", F.sum("size").over(upto)), sources, n).where(F.col("cum") > F.col("gap"))
    edge = sums.groupBy("source_key").agg(F.min(F.struct("bucket", (F.col("cum") - F.col("size")).alias("before"))).alias("edge"))
    edge = written(sources.join(edge, "source_key", "left").select("source_key", "source_size", "target", "whole", "gap", "edge.bucket", "edge.before"), "mix-edges")
    inside = near(ids.withColumn("bucket", bucket), edge.select("source_key", F.col("bucket").alias("edge"), "before", "gap"), n).where(F.col("bucket") == F.col("edge"))
    inside = inside.groupBy("source_key", "draw", "before", "gap").agg(F.sum("size").alias("size"))  # rows of one draw go together
    running = F.sum("size").over(Window.partitionBy("source_key").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("cum", running + F.col("before")).where(F.col("cum") <= F.col("gap")).groupBy("source_key").agg(F.max("draw").alias("last"))
    cuts = written(edge.join(last, "source_key", "left").withColumn("cut", F.coalesce("last", "bucket", F.lit("~"))).drop("last", "bucket", "before"), "mix-cuts")
    got = near(ids, cuts.select("source_key", "cut"), n).groupBy("source_key").agg(F.sum(F.when(F.col("draw") <= F.col("cut"), F.col("size")).otherwise(0)).alias("got"))
    left = cuts.join(got, "source_key").withColumn("left", F.col("gap") - F.col("got"))
    # One more document closes the rest of the gap where that brings the total nearer.
    fit = near(ids, left.select("source_key", "cut", "left"), n).where((F.col("draw") > F.col("cut")) & (F.abs(F.col("size") - F.col("left")) < F.col("left")))
    fit = fit.groupBy("source_key").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "draw", "left")).alias("fit"))
    fit = written(fit.select("source_key", "fit"), "mix-fit")
    # Where its draw stands for several rows, all of them together must bring it nearer.
    both = near(ids, fit, n).where(F.col("draw") == F.col("fit.draw")).groupBy("source_key").agg(F.sum("size").alias("size"), F.first("fit").alias("fit"))
    fit = both.where(F.abs(F.col("size") - F.col("fit.left")) < F.col("fit.left"))
    return counted(cuts.join(fit, "source_key", "left").select("source_key", "source_size", "target", "whole", "cut", F.col("fit.draw").alias("best")), "mix-plan")


def with_copies(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, **options) -> DataFrame:
    """(row, a struct of all columns of docs, size, source_size, target and copies) for every row of docs.

    Size is the number of words; null text has none. Null sources form one source, the last. No document is taken more than epochs times,
    rounded up. Rows that repeat a key, and rows without one that repeat a text, are drawn together. Empty input gives empty output.
    Reruns agree: only the seed and the key decide.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, source_key(F.col(source)).alias("source_key"), draw(F.col(key), F.col(text), seed).alias("draw"), word_count(F.col(text)).alias("size"))
    ids = written(d.select("source_key", "size", "draw"), "mix-ids")
    plan = plan_mix(ids, **options)
    d = near(d, plan, rows(plan))
    more = (F.col("draw") <= F.col("cut")).cast("long") + F.coalesce((F.col("draw") == F.col("best")).cast("long"), F.lit(0))
    most = -(-options.get("epochs", EPOCHS) // 1)  # an empty document fits in anywhere, but no oftener than the others
    return d.select("row", "size", "source_size", "target", F.least(F.col("whole") + more, F.lit(int(most))).cast("long").alias("copies"))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times copies) of every document."""
    d = with_copies(docs.select("doc_id", "source", "text"))
    return d.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with its columns as they are; see with_copies()."""
    d = with_copies(docs, key, source, text, **options).where(F.col("copies") > 0)
    d = d.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return d.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS k, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS h
  FROM documents
), s AS (
  SELECT k, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap, [5, 2, 1][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY k
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, k) AS pos,
    coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
    sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest, sum(source_size) OVER ()::DOUBLE AS total
  FROM s
), l AS (SELECT *, (total * 1.5::DOUBLE - before) / rest AS level FROM o),
v AS (SELECT min_by(level, pos) FILTER (WHERE cap > level * w) AS level FROM l),
t AS (SELECT k, source_size, least(cap::DOUBLE, coalesce(v.level * w, cap::DOUBLE)) AS target FROM l, v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS gap, sum(size) OVER (PARTITION BY d.k ORDER BY h RANGE UNBOUNDED PRECEDING) AS cum FROM d JOIN p ON d.k = p.k),
e AS (SELECT *, gap - coalesce(max(CASE WHEN cum <= gap THEN cum END) OVER (PARTITION BY k), 0) AS remaining FROM r),
f AS (
  SELECT *, CASE WHEN cum > gap AND abs(size - remaining) < remaining THEN row_number() OVER (PARTITION BY k, cum > gap AND abs(size - remaining) < remaining ORDER BY abs(size - remaining), h) END AS fit FROM e
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + CASE WHEN cum <= gap THEN 1 ELSE 0 END + CASE WHEN fit = 1 THEN 1 ELSE 0 END))::BIGINT AS taken FROM f
"""
