"""Packing: optimal length buckets by dynamic programming, and token-budget batches within each bucket.

The bounds of K buckets that minimise padding are found exactly, for input of any size, from the histogram of lengths, the one thing that reaches
the driver: n different lengths need at least n * (n - 1) / 2 words, so it grows with the square root of the input at most. Batches number the rows of a bucket without gathering them: rows are dealt to shards, shard counts give each
shard its first number, and a row's number within its shard comes from a window over that shard alone.
"""

from __future__ import annotations

from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzline.llm.text_stats import word_count
from quartzline.session import counted, written

BUCKETS = 16
BUDGET = 32_768
#: Different lengths that the driver takes in bucket_bounds().
BINS = 1_000_000
#: Beyond them, lengths up to FINE have bins of their own; above, PER_DOUBLING bins share each doubling.
FINE, PER_DOUBLING = 1024, 64
#: Rows of a shard on average, at most.
SHARD_ROWS = 50_000


def bin_edge(length: Column) -> Column:
    """Itself up to FINE, else the length rounded up to a part of its power of two."""
    step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")))) / PER_DOUBLING, F.lit(1.0)).cast("long")
    return F.when(length <= FINE, length).otherwise(F.ceil(length / step) * step).cast("long")


def layer(cost: list, edges: list[int], rows: list[int], held: list[int]) -> tuple[list, list[int]]:
    """The least padding of the first j lengths with one bucket more than cost allows, and where that bucket begins.

    A bucket over lengths i to j-1 costs edges[j-1] * (rows[j] - rows[i]) - (held[j] - held[i]), so each i is a line in edges[j-1] of slope -rows[i].
    Slopes fall and the places asked for rise: a queue of the lines that are least somewhere gives each answer in constant time, in whole numbers.
    """
    new, cut, lines, head = [0], [0], [], 0
    for j in range(1, len(edges) + 1):
        if cost[j - 1] is not None:
            slope, start = -rows[j - 1], cost[j - 1] + held[j - 1]
            while len(lines) - head >= 2:
                (a, b, _), (c, d, _) = lines[-2], lines[-1]
                if (start - b) * (a - c) > (d - b) * (a - slope):
                    break
                lines.pop()
            lines.append((slope, start, j - 1))
        x = edges[j - 1]
        while head + 1 < len(lines) and lines[head + 1][0] * x + lines[head + 1][1] <= lines[head][0] * x + lines[head][1]:
            head += 1
        slope, start, i = lines[head]
        new.append(slope * x + start + x * rows[j] - held[j])
        cut.append(i)
    return new, cut


def optimal_bounds(edges, counts, sums, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most so many buckets with the least total padding. edges ascend; sums are the lengths that each stands for, counts their number."""
    edges = [int(e) for e in edges]
    rows, held = [0], [0]
    for c, s in zip(counts, sums, strict=True):
        rows.append(rows[-1] + int(c))
        held.append(held[-1] + int(s))
    cost: list = [0] + [None] * len(edges)
    cuts = []
    for _ in range(min(buckets, len(edges))):
        cost, cut = layer(cost, edges, rows, held)
        cuts.append(array("q", cut))
    bounds, j = [], len(edges)
    for cut in reversed(cuts):
        if j:
            bounds.append(edges[j - 1])
            j = cut[j]
    return bounds[::-1]


def exact_bounds(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """lengths: one column, length. The whole histogram goes to the driver, whatever the input's size."""
    rows = lengths.groupBy("length").agg(F.count("*").alias("n"), F.sum("length").alias("s")).toArrow().sort_by("length")
    return optimal_bounds(*(rows[k].to_pylist() for k in ("length", "n", "s")), buckets)


def bucket_bounds(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """As exact_bounds() up to BINS different lengths; beyond, bounds of bins, for a driver that can't hold them. pack() doesn't use it."""
    measures = [F.max("length").alias("edge"), F.count("*").alias("n"), F.sum("length").alias("s")]
    rows = lengths.groupBy("length").agg(*measures).limit(BINS + 1).toArrow()
    if rows.num_rows > BINS:
        rows = lengths.groupBy(bin_edge(F.col("length"))).agg(*measures).toArrow()
    rows = rows.sort_by("edge")
    return optimal_bounds(*(rows[k].to_pylist() for k in ("edge", "n", "s")), buckets)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(key, length, bucket, bucket_bound, batch, slot, padding): where every row goes.

    A batch holds max(1, budget // bound) rows, all padded to the bucket's bound, so a batch exceeds the budget only where one row does.
    batch numbers are unique across buckets only together with bucket. Null texts have length 0 and share the first bucket with
    the shortest. Rows that repeat a key get slots of their own, dealt to all shards. Other columns are ignored. Empty input gives empty output.
    """
    size = word_count(F.col(text)) if length is None else length.cast("long")
    rows = counted(docs.select(F.col(key), size.alias("length"), F.xxhash64(key, F.monotonically_increasing_id()).alias("deal")), "pack-lengths")
    bounds = exact_bounds(rows.select("length"), buckets)
    bucket, bound = F.lit(max(len(bounds) - 1, 0)), F.lit(bounds[-1] if bounds else 0).cast("long")
    for k in range(len(bounds) - 2, -1, -1):
        fits = F.col("length") <= bounds[k]
        bucket, bound = F.when(fits, k).otherwise(bucket), F.when(fits, F.lit(bounds[k]).cast("long")).otherwise(bound)
    shards = max(1, -(-rows.observed["rows"] // SHARD_ROWS))
    d = rows.withColumns({"bucket": bucket, "bucket_bound": bound, "shard": F.pmod("deal", F.lit(shards * 8))})
    counts = d.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")
    starts = written(counts.withColumn("first", before).drop("n"), "pack-starts")
    within = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("length", key)) - 1
    d = d.withColumn("within", within).join(starts, ["bucket", "shard"]).withColumn("place", F.col("first") + F.col("within"))
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_bound"), F.lit(1))), F.lit(1)).cast("long")
    return d.select(
        key, "length", F.col("bucket").cast("int").alias("bucket"), "bucket_bound",
        F.floor(F.col("place") / room).cast("long").alias("batch"), (F.col("place") % room).cast("long").alias("slot"), (F.col("bucket_bound") - F.col("length")).alias("padding"),
    )
