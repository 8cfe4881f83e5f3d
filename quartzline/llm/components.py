"""Connected components of an edge list by alternating large and small stars, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.session import counted, discard, rows, written


def large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node sends its smallest neighbour, or itself, to its larger neighbours. Edges are (u, v), u > v. Also the table of the smallest."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join's two sides are plain shuffles and a hot node can be split.
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def small_star(edges: DataFrame) -> DataFrame:
    """Every node sends its smallest neighbour to itself and to its smaller neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    sent = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return sent.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge, component being the smallest node reachable.

    Loops and repeated edges don't matter; edges with a null end are left out. A hot node's edges combine on the map side and its join can be split.
    A round's tables are deleted once the next one is written. Rounds end when one changes nothing; its edges are compared by count and sum of hashes,
    which are taken while they are written, the first edges' too: edges that are stars to their least nodes need one round.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNull() | F.col(b).isNull()).alias("gap"))
    hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    e = counted(e.where(~F.col("gap") & (F.col("u") != F.col("v"))).select("u", "v").distinct(), "edges", hashes=hashes)
    while rows(e):
        sent, least = large_star(e)
        before, e = e, counted(small_star(sent), "stars", hashes=hashes)
        discard(before, least)
        if e.observed == before.observed:
            break
    # A forest of stars: v is the centre of each.
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
