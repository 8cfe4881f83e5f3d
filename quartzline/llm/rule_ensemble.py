"""Quality classifier: a sparse rule ensemble over text statistics.

A forest of shallow trees is grown on labelled documents; every path from a root to an inner node or leaf is a rule, a conjunction of
comparisons of statistics. A lasso logistic regression over the rules' 0/1 columns keeps few of them. The fitted rules
compile into one Spark column expression, so scoring is a projection over the whole table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzline.llm.text_stats import with_base_stats
from quartzline.session import written

STATS = ("s_words", "s_length", "s_symbols", "s_dup_lines", "s_repeats", "s_distinct", "s_upper", "s_digits", "s_marks", "s_line", "s_bars")
TREES, DEPTH, LASSO, SEED = 16, 3, 0.002, 11
#: At most about so many labelled documents, by hash of their id, train the ensemble.
TRAIN_ROWS = 10_000
FOLDS, HELD_OUT = 3, 1


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, a struct of all columns of docs, and the statistics STATS, double); all zero for null and empty texts."""
    d = with_base_stats(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("__text")), "__text")
    t, w = F.col("__t"), F.col("__words")
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    count = lambda c: F.length(t) - F.length(F.translate(t, c, ""))
    return d.withColumns(
        {
            "s_words": F.log1p("n_words"),
            "s_length": F.col("word_chars") / n,
            "s_symbols": F.col("n_symbols") / chars,
            "s_dup_lines": F.col("n_dup_lines") / F.greatest(F.size("__lines"), F.lit(1)),
            "s_repeats": F.col("n_repeat_words") / n,
            "s_distinct": F.size(F.array_distinct(w)) / n,
            "s_upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
            "s_digits": count("0123456789") / chars,
            "s_marks": count("!?") / n,
            "s_line": F.log1p(F.col("n_words") / F.greatest(F.size("__lines"), F.lit(1))),
            "s_bars": count("|") / n,
        }
    ).select("row", *STATS)


@dataclass
class RuleEnsemble:
    """Rules are tuples of (statistic, above, threshold); the score is the logistic of intercept plus the weights of those that hold."""

    rules: list[tuple[tuple[str, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def holds(rule: tuple[tuple[str, bool, float], ...]) -> Column:
    out = F.lit(True)
    for name, above, threshold in rule:
        out = out & (F.col(name) > threshold if above else F.col(name) <= threshold)
    return out


def paths_of(tree: str, names: tuple[str, ...]) -> list[tuple[tuple[str, bool, float], ...]]:
    """All conjunctions along a printed tree's branches, each path's prefixes included."""
    found, path = [], []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[2])], m[3] == ">", float(m[4])))]
            found.append(tuple(dict.fromkeys(c for _, c in path)))
    return found


def fit(train: DataFrame) -> RuleEnsemble:
    """train: STATS and label (0 or 1; null labels are left out). Other columns are ignored, repeated rows count as often.

    With one label only, the ensemble is a constant beside it; with no rows, 0.5.
    """
    train = written(train.where(F.col("label").isNotNull()).select(*STATS, F.col("label").cast("double")), "rules-train")
    n, good = train.agg(F.count("*"), F.sum("label")).first()
    if not n or good in (0, n):
        return RuleEnsemble(intercept=0.0 if not n else 4.0 if good else -4.0)
    into = VectorAssembler(inputCols=list(STATS), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, subsamplingRate=0.8, featureSubsetStrategy="onethird", seed=SEED).fit(into.transform(train))
    rules = sorted({r for t in forest.trees for r in paths_of(t.toDebugString, STATS)})
    if not rules:
        return RuleEnsemble(intercept=4.0 if 2 * good > n else -4.0)
    columns = array_to_vector(F.array(*[holds(r).cast("double") for r in rules]))
    lasso = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, maxIter=60).fit(written(train.select(columns.alias("features"), "label"), "rules-holding"))
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]
    return RuleEnsemble([r for r, _ in kept], [w for _, w in kept], float(lasso.intercept))


def remainder(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> RuleEnsemble:
    """From the labelled rows outside the held-out fold. Conflicting labels of a document count by majority, ties as 1.

    Rows with a null key or label are left out. Rows of docs that repeat a labelled key train as often. Other columns are ignored.
    """
    known = labels.where((remainder(F.col(key)) != HELD_OUT) & F.col(label).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    n = known.count()
    if n > TRAIN_ROWS:
        known = known.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / n))
    # TRAIN_ROWS bounds the broadcast.
    train = with_stats(docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(known), key))
    return fit(train.select(*STATS, "row.label"))


def scored(docs: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier). Null text counts as empty; a column score is replaced, all others stay as they are."""
    kept = [c for c in docs.columns if c.lower() != "score"]
    return with_stats(docs, text).select(*[F.col("row").getField(c).alias(c) for c in kept], model.score().alias("score"))


def accepted(docs: DataFrame, model: RuleEnsemble, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs that score least or more, with their columns as they are, a column score included."""
    d = with_stats(docs, text).select("row", model.score().alias("score"))
    # A filter would be pushed below the statistics and repeat each of them for every rule that names it; a generator stays where it is.
    d = d.select("row", F.explode(F.when(F.col("score") >= least, F.array(F.lit(True)))))
    return d.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs. Repeated rows repeat; other columns are never inputs."""
    d = scored(docs.select("doc_id", "text"), learn(docs, labels))
    return d.select("doc_id", (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
