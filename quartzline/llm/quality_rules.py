"""Quality rules: robust multivariate outliers per language and source.

Every document's statistics become a transformed vector. For each (lang, source) group the minimum-covariance-determinant estimate is
found by concentration steps: the share SUPPORT of the group's rows nearest by Mahalanobis distance gives the next mean and covariance. They
run from two starts, medians with median deviations and plain moments, until the determinant stops falling, and the start of
the least determinant is kept. Rows beyond the chi-squared cutoff are rejected.

Groups of all sizes are treated alike: a group's moments are taken together with PRIOR rows of its language's, and a language's with as
many of all rows', so that a group of three rows is judged mostly by its language and one of thousands by itself.

All steps are aggregates that combine on the map side (moments and percentile sketches), so a group that holds a third
of all rows costs no more than its share. The estimates are a table of one row per group, which is broadcast to the rows
up to GROUPS groups and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzline.llm.joins import near
from quartzline.llm.text_stats import with_base_stats
from quartzline.session import discard, written

DIMS = ("x0", "x1", "x2", "x3", "x4")
K = range(len(DIMS))
PAIRS = [(i, j) for i in K for j in K if i <= j]
#: Least standard deviation of each transformed statistic; keeps estimates of groups without any spread regular.
FLOOR = (0.5, 0.08, 0.25, 0.08, 0.08)
SUPPORT = 0.75
#: Concentration steps end when the mean logarithm of the determinants falls by less than ENOUGH, or after so many.
STEPS, ENOUGH = 8, 0.01
PRIOR = 30
#: Chi-squared quantiles for five degrees of freedom: the median, and the cutoff at 1 - 1e-6.
MEDIAN, CUTOFF = 4.3515, 35.888
GROUPS = 100_000
#: Relative rank error of the percentile sketches is the inverse; groups of fewer rows have exact percentiles.
ACCURACY = 1000


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vectors(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    d = with_base_stats(docs.select(*keys, F.col(lang).alias("__lang"), F.col(source).alias("__source"), F.col(text).alias("__text")), "__text")
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    null = F.lit("\u0000null")
    language = F.coalesce("__lang", null)
    return d.select(
        *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), language.alias("language"), F.concat(language, F.lit("\u0001"), F.coalesce("__source", null)).alias("group"),
        F.log1p("n_words").alias("x0"),
        F.log(chars / n).alias("x1"),
        F.log1p(100.0 * F.col("n_symbols") / chars).alias("x2"),
        (F.col("n_repeat_words") / n).alias("x3"),
        F.log1p(20.0 * F.col("n_dup_lines") / n).alias("x4"),
    )


def cholesky(model: DataFrame, kept: list[str]) -> DataFrame:
    """kept columns, and from columns c_ij of covariances columns l_ij of their lower factor, one dimension a stage."""
    made: list[str] = []
    for j in K:
        under = f"c{j}{j} + {FLOOR[j] ** 2!r}D" + "".join(f" - l{j}{m} * l{j}{m}" for m in range(j))
        model = model.selectExpr(*kept, *made, *[f"c{i}{k}" for i, k in PAIRS if i >= j], f"sqrt(greatest({under}, {FLOOR[j] ** 2 / 100!r}D)) AS l{j}{j}")
        below = [f"(c{j}{i}" + "".join(f" - l{i}{m} * l{j}{m}" for m in range(j)) + f") / l{j}{j} AS l{i}{j}" for i in range(j + 1, len(DIMS))]
        if below:
            model = model.selectExpr("*", *below)
        made += [f"l{i}{j}" for i in range(j, len(DIMS))]
    return model.selectExpr(*kept, *made, "2 * (" + " + ".join(f"ln(l{i}{i})" for i in K) + ") AS log_det")


def distances(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution with the columns m_i and l_ij."""
    for i, x in enumerate(DIMS):
        rows = rows.withColumn(f"y{i}", F.expr(f"({x} - m{i}" + "".join(f" - l{i}{j} * y{j}" for j in range(i)) + f") / l{i}{i}"))
    return rows.withColumn("d2", F.expr(" + ".join(f"y{i} * y{i}" for i in K)))


MOMENTS = [*[f"s{i}" for i in K], *[f"q{i}{j}" for i, j in PAIRS]]


def sums() -> list[Column]:
    each = [DIMS[i] for i in K] + [f"{DIMS[i]} * {DIMS[j]}" for i, j in PAIRS]
    return [F.expr("cast(count(*) as double) AS n"), *[F.expr(f"sum({x}) AS {c}") for c, x in zip(MOMENTS, each, strict=True)]]


def models(own: DataFrame, prior: float) -> DataFrame:
    """(start, language, group, n, m_i, l_ij, log_det) from each group's sums.

    Means of first and second order are taken together with prior rows of the language's, and those with prior rows of all.
    """
    total = lambda c, keys: f"sum({c}) OVER (PARTITION BY {keys})"
    widths = (("a", "start"), ("b", "start, language"))
    d = own.selectExpr("*", *[f"{total(c, keys)} AS {k}_{c}" for k, keys in widths for c in ("n", *MOMENTS)])
    d = d.selectExpr("start", "language", "group", "n", *[f"({c} + {prior} * (b_{c} + {prior} * a_{c} / a_n) / (b_n + {prior})) / (n + {prior}) AS {c}" for c in MOMENTS])
    d = d.selectExpr("start", "language", "group", "n", *[f"s{i} AS m{i}" for i in K], *[f"q{i}{j} - s{i} * s{j} AS c{i}{j}" for i, j in PAIRS])
    return cholesky(d, ["start", "language", "group", "n", *[f"m{i}" for i in K]])


def halfway(x: Column, share: float = 0.5) -> Column:
    return F.percentile_approx(x, F.lit(share), F.lit(ACCURACY))


def first_sums(rows: DataFrame) -> DataFrame:
    """Each group's sums as the two starts give them: 0 by medians and median absolute deviations, 1 by the plain moments."""
    middle = written(rows.groupBy("language", "group").agg(F.count("*").cast("double").alias("n"), *[halfway(F.col(x)).alias(f"m{i}") for i, x in enumerate(DIMS)]), "mcd-median")
    off = near(rows, middle.drop("language"), "group", limit=GROUPS).groupBy("group").agg(*[halfway(F.abs(F.col(x) - F.col(f"m{i}"))).alias(f"d{i}") for i, x in enumerate(DIMS)])
    n, m = F.col("n"), [F.col(f"m{i}") for i in K]
    robust = middle.join(off, "group").select(
        F.lit(0).alias("start"), "language", "group", "n", *[(n * m[i]).alias(f"s{i}") for i in K],
        *[(n * (m[i] * m[j] + (2.2 * F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0)))).alias(f"q{i}{j}") for i, j in PAIRS],
    )
    return robust.unionByName(rows.groupBy("language", "group").agg(*sums()).withColumn("start", F.lit(1)))


def estimates(rows: DataFrame, prior: float = PRIOR) -> DataFrame:
    """One row per group: means m_i, factors l_ij, log_det, the weight of the rows behind them, the distance that cuts off SUPPORT of the rows, and the scale that matches the median distance to chi-squared's.

    rows: language, group and the vectors. Empty for no rows.
    """
    model = written(models(first_sums(rows), prior), "mcd-start")
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    level = None
    for _ in range(STEPS):
        far = distances(near(both, model.drop("language"), ["start", "group"], limit=GROUPS)).select("start", "language", "group", *DIMS, "d2")
        cut = written(far.groupBy("start", "group").agg(halfway(F.col("d2"), SUPPORT).alias("cut")), "mcd-cut")
        kept = near(far, cut, ["start", "group"], limit=GROUPS).where(F.col("d2") <= F.col("cut"))
        before, model = model, written(models(kept.groupBy("start", "language", "group").agg(*sums()), prior), "mcd-step")
        discard(before, cut)
        now = model.agg(F.sum(F.col("n") * F.col("log_det")) / F.sum("n")).first()[0]
        if now is None or level is not None and level - now < ENOUGH:
            break
        level = now
    columns = [c for c in model.columns if c not in ("start", "group")]
    best = written(model.groupBy("group").agg(F.min_by(F.struct(*columns), F.struct("log_det", "start")).alias("b")).select("group", "b.*"), "mcd-best")
    # A group's median distance is taken together with its language's and that of all rows, as its moments are.
    d2 = distances(near(rows, best.drop("language"), "group", limit=GROUPS)).select("language", "group", "d2")
    null = F.lit(None).cast("string")
    levels = [F.struct(a.alias("l"), b.alias("g")) for a, b in ((F.col("language"), F.col("group")), (F.col("language"), null), (null, null))]
    half = written(d2.select(F.explode(F.array(*levels)).alias("k"), "d2").groupBy("k.l", "k.g").agg(halfway(F.col("d2")).alias("half"), halfway(F.col("d2"), SUPPORT).alias("cut"), F.count("*").alias("n")), "mcd-half")
    whole = half.where(F.col("l").isNull()).first()
    near_to = lambda wider: (F.col("n") * F.col("half") + prior * wider) / (F.col("n") + prior)
    language = half.where(F.col("l").isNotNull() & F.col("g").isNull()).select("l", near_to(F.lit(whole["half"] if whole else None)).alias("wider"))
    scale = half.where(F.col("g").isNotNull()).join(language, "l").select(F.col("g").alias("group"), "cut", F.greatest(near_to(F.col("wider")) / MEDIAN, F.lit(1.0)).alias("scale"))
    return written(best.join(scale, "group").withColumn("weight", F.col("n") + prior), "mcd")


def farness() -> Column:
    """The distance d2 over the group's scale. A row that took part in its estimate is measured against the estimate without it.

    Else a row could hide itself in a small group: its own weight bounds its distance from the mean that it is part of.
    """
    rest = "(weight - 1)"
    return F.expr(f"CASE WHEN d2 > cut THEN d2 WHEN d2 < {rest} THEN weight / {rest} * d2 / (1 - d2 / {rest}) WHEN d2 >= {rest} THEN 1e9D END / scale")


def quality_verdicts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys, the base statistics, base_failed, distance (double) and kept (boolean), one row per input row.

    Null lang or source form groups of their own; null or empty text has no words and fails the base rules. Repeated rows
    give repeated results; other columns are ignored; an empty table gives an empty result. Rows that fail the base rules don't enter the
    estimates and are not kept; in groups where none pass they have no distance. Columns named like the statistics may be keys only under other names.
    """
    rows = written(vectors(docs, lang, source, text, keys), "mcd-vectors")
    model = estimates(rows.where(~F.col("base_failed")).select("language", "group", *DIMS))
    d = distances(near(rows, model.select("group", *[c for c in model.columns if c[0] in "ml" and c not in ("language", "log_det")], "scale", "cut", "weight"), "group", "left", limit=GROUPS))
    far = farness()
    return d.select(*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", far.alias("distance"), (~F.col("base_failed") & F.coalesce(far <= CUTOFF, F.lit(True))).alias("kept"))
