"""Exact quantiles of large groups: the bracket of each rank is narrowed by histograms until few values are left in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzline.session import written

#: A group, or a bracket, of at most so many values is sorted as a whole.
GATHERED = 10_000
#: Bins that a bracket is cut into in each round.
BINS = 1024


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], gathered: int = GATHERED, out: str = "quantiles") -> DataFrame:
    """(by, out): for each group an array of the quantiles at shares, between neighbouring values in proportion. Nulls don't count; a group of nulls has nulls.

    Groups of few values are sorted as they are. In a greater one each wanted rank has a bracket of values, which every round cuts into equal bins
    to keep the one that holds the rank; counts combine on the map side, so no task holds more than the bins of a group or the values that gathered allows.
    """
    d = df.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(by)], F.col(value).cast("double").alias("__v"))
    keys = [f"__g{i}" for i in range(len(by))]
    named = [F.col(f"__g{i}").alias(k) for i, k in enumerate(by)]
    sizes = written(d.groupBy(*keys).agg(F.count("__v").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")), "quantile-sizes")
    large = sizes.where(F.col("__n") > gathered)
    plain = F.percentile("__v", F.array(*[F.lit(float(s)) for s in shares])).alias(out)
    if large.isEmpty():
        return d.groupBy(*keys).agg(plain).select(*named, out)
    small = sizes.where(F.col("__n") <= gathered).select(*keys)
    few = d.alias("d").join(small.alias("s"), _same("d", "s", keys), "left_semi").groupBy(*keys).agg(plain).select(*named, out)

    place = lambda s: (F.col("__n") - 1) * F.lit(float(s))
    ends = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(s)), F.ceil(place(s))) for s in shares])))
    # (group, rank): the bracket's values, how many lie below it and in it.
    state = large.select(*keys, F.explode(ends).alias("__rank"), "__low", "__high", F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__in"))
    state, found = written(state, "brackets"), None
    while True:
        ready = (F.col("__in") <= gathered) | (F.col("__low") == F.col("__high"))
        ended = state.where(ready)
        found = ended if found is None else found.unionByName(ended)
        if state.where(~ready).isEmpty():
            break
        open_ = state.where(~ready)
        width = F.col("__high") - F.col("__low")
        at = F.least(F.floor((F.col("__v") - F.col("__low")) / width * BINS), F.lit(BINS - 1))
        seen = d.alias("d").join(open_.alias("s"), _same("d", "s", keys) & F.col("__v").between(F.col("__low"), F.col("__high"))).select(*[F.col(f"s.{k}").alias(k) for k in keys], "__rank", "__below", at.alias("__bin"), "__v")
        bins = seen.groupBy(*keys, "__rank", "__below", "__bin").agg(F.count("*").alias("__in"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        up_to = Window.partitionBy(*keys, "__rank").orderBy("__bin")
        bins = bins.withColumn("__end", F.col("__below") + F.sum("__in").over(up_to))
        kept = bins.where((F.col("__rank") < F.col("__end")) & (F.col("__rank") >= F.col("__end") - F.col("__in")))
        state = written(kept.select(*keys, "__rank", "__low", "__high", (F.col("__end") - F.col("__in")).alias("__below"), "__in"), "brackets")
    inside = d.alias("d").join(found.where(F.col("__low") < F.col("__high")).alias("s"), _same("d", "s", keys) & F.col("__v").between(F.col("__low"), F.col("__high")))
    sorted_ = inside.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], "__rank", "__below").agg(F.sort_array(F.collect_list("__v")).alias("__values"))
    ranks = sorted_.select(*keys, "__rank", F.get("__values", (F.col("__rank") - F.col("__below")).cast("int")).alias("__v"))
    ranks = ranks.unionByName(found.where(F.col("__low") == F.col("__high")).select(*keys, "__rank", F.col("__low").alias("__v")))
    maps = ranks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))
    d = maps.alias("m").join(large.alias("s"), _same("m", "s", keys)).select(*[F.col(f"m.{k}").alias(k) for k in keys], "__n", "__at")

    def between(s: float):
        low, high = F.element_at("__at", F.floor(place(s))), F.element_at("__at", F.ceil(place(s)))
        return low + (place(s) - F.floor(place(s))) * (high - low)

    return d.select(*named, F.array(*[between(s) for s in shares]).alias(out)).unionByName(few)


def _same(a: str, b: str, keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out
