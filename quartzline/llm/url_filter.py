"""URL filters: host and path rules first, then gradient-boosted trees over lexical features of the URL."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzline.llm.joins import near
from quartzline.llm.text_stats import SPACES, word_count
from quartzline.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the production list.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
FEATURES = ("f_length", "f_host", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_fragment", "f_extension", "f_https", "f_rate", "f_share")
#: At most so many labelled URLs, by hash order, train the trees.
TRAIN_ROWS = 50_000
#: Suffix statistics of a URL leave out its own one of so many folds.
FOLDS = 5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host and path together, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last to match is the longest
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def entropy(s: Column) -> Column:
    """Shannon entropy in bits of a string's characters."""
    n = F.length(s).cast("double")
    term = lambda c: (lambda p: -p * F.log2(p))((n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda a, c: a + F.when(F.length(c) > 0, term(c)).otherwise(0.0))).otherwise(0.0)


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that one URL alone gives, and its suffix. df has url, host and path."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(u).cast("double")
    count = lambda s, c: (F.length(s) - F.length(F.translate(s, c, ""))).cast("double")
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    return df.withColumns(
        {
            "f_length": n,
            "f_host": F.length("host").cast("double"),
            "f_depth": count(F.col("path"), "/"),
            "f_labels": count(F.col("host"), "."),
            "f_digits": F.when(n > 0, count(u, "0123456789") / n).otherwise(0.0),
            "f_entropy": entropy(F.col("host")),
            "f_params": F.when(query == "", 0.0).otherwise(1.0 + count(query, "&")),
            "f_hyphens": count(F.col("host"), "-"),
            "f_fragment": F.contains(u, F.lit("#")).cast("double"),
            "f_extension": F.col("path").rlike(r"\.[A-Za-z0-9]+$").cast("double"),
            "f_https": F.startswith(u, F.lit("https:")).cast("double"),
            "suffix": F.concat(F.regexp_extract("host", r"([^.]*)$", 1), F.lit("/"), F.regexp_extract("path", r"^/([A-Za-z]{0,3})(?:/|$)", 1)),
        }
    )


def page_label(source: Column) -> Column:
    """1 where a page's text, without tags, scripts and styles, is under 50 words or over 5% symbols: what a blocked page looks like; 0 else.

    Both patterns are linear: what one has passed it never reads again.
    """
    text = F.regexp_replace(F.coalesce(source, F.lit("")), r"(?i)<(?:script|style)[^<]*+(?:<(?!/(?:script|style))[^<]*+)*+", " ")
    text = F.regexp_replace(text, r"<[^<>]*+>?", " ")
    chars = F.length(F.translate(text, SPACES, ""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%|", ""))
    return F.when((word_count(text) < 50) | (20 * symbols > chars), 1.0).otherwise(0.0)


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(url, F.lit("")), F.lit("suffix")), F.lit(FOLDS)).cast("int")


def suffix_statistics(known: DataFrame) -> tuple[DataFrame, float]:
    """(suffix, n, bad: arrays of the labelled URLs and of those labelled 1 in each fold), and the share of label 1 among all."""
    by = [F.col("fold") == k for k in range(FOLDS)]
    n = F.array(*[F.count_if(f) for f in by]).alias("n")
    stats = written(known.groupBy("suffix").agg(n, F.array(*[F.sum(F.when(f, F.col("label")).otherwise(0.0)) for f in by]).alias("bad")), "url-suffixes")
    total = lambda c, zero: F.sum(F.aggregate(c, zero, lambda a, x: a + x))
    rows, bad = stats.agg(total("n", F.lit(0).cast("long")), total("bad", F.lit(0.0))).first()
    return stats, bad / rows if rows else 0.0


def with_suffix_features(rows: DataFrame, stats: DataFrame, prior: float) -> DataFrame:
    """Adds f_rate, the smoothed share of label 1 among the URLs of one suffix, and f_share, what part of all URLs they are.

    Both leave out the URLs of the row's own fold, so that no URL meets its own label in them.
    """
    both = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) - F.element_at(c, F.col("fold") + 1)
    d = near(rows, stats, "suffix", "left")
    d = d.withColumns({"__n": F.coalesce(both(F.col("n")), F.lit(0.0)), "__bad": F.coalesce(both(F.col("bad")), F.lit(0.0))})
    all_rows = stats.agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 1
    return d.withColumns({"f_rate": (F.col("__bad") + 20 * prior) / (F.col("__n") + 20), "f_share": F.col("__n") / all_rows}).drop("n", "bad", "__n", "__bad")


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def boosted(known: DataFrame, stats: DataFrame, prior: float):
    """Boosted trees over the features of labelled URLs, of which TRAIN_ROWS by hash take part; None where all labels are one."""
    n, bad = known.agg(F.count("*"), F.sum("label")).first()
    if not 0 < (bad or 0.0) < n:
        return None
    train = known if n <= TRAIN_ROWS else known.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / n))
    train = assembled(with_suffix_features(train, stats, prior).select(*FEATURES, "label")).select("features", "label")
    return GBTClassifier(maxIter=12, maxDepth=4, maxBins=32, stepSize=0.2, seed=7).fit(train)


def log_loss(score: Column) -> Column:
    p = F.greatest(F.least(score, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.avg(-F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def fitted(known: DataFrame, stats: DataFrame, prior: float):
    """Boosted trees, or None where they don't help: trees of two thirds of the hosts must score the URLs of the others better than the share of label 1 does.

    Without labelled URLs of other hosts nothing speaks against them.
    """
    aside = F.pmod(F.xxhash64("host", F.lit("check")), F.lit(3)) == 0
    rest = known.where(~aside)
    own_stats, own_prior = suffix_statistics(rest)
    trees = boosted(rest, own_stats, own_prior)
    if trees is not None:
        loss, plain = with_score(known.where(aside), trees, own_stats, own_prior).agg(log_loss(F.col("score")), log_loss(F.lit(own_prior))).first()
        if loss is not None and loss >= plain:
            return None
    return boosted(known, stats, prior)


def with_score(rows: DataFrame, trees, stats: DataFrame, prior: float) -> DataFrame:
    """Adds score, the probability of label 1."""
    if trees is None:
        return rows.withColumn("score", F.lit(prior))
    return trees.transform(assembled(with_suffix_features(rows, stats, prior))).withColumn("score", vector_to_array("probability")[1])


def features_of(rows: DataFrame) -> DataFrame:
    """Adds host, path and the lexical features to rows with url."""
    return lexical(rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})).withColumn("fold", fold(F.col("url")))


def url_verdicts(pages: DataFrame, rules=RULES, url: str = "url", keys: tuple[str, ...] = ("page_id",), labelled: DataFrame | None = None, source: str = "html") -> DataFrame:
    """The keys, host, path, rule, verdict (allow or block) and score (probability of block), one row per input row.

    labelled: (url, label 0 or 1) rows that train the trees, 1 being block; null labels are left out. By default the pages themselves are
    labelled by page_label() of their source column; without that column there are no labels. The rules' verdicts train nothing. Suffix
    statistics are over all labelled URLs, by pair of top-level domain and first short path segment. Null or malformed URLs have empty host and
    path and are scored like any other. Without labels of both kinds, or where trees don't help, the labels' majority, or allow, decides. Repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty result.
    """
    own = labelled is None and source in pages.columns
    label = page_label(F.col(source)) if own else F.lit(None).cast("double")
    rows = features_of(pages.select(*keys, F.col(url).alias("url"), label.alias("label")))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = written(rows.withColumns({"rule": name, "said": verdict}), "urls")
    if labelled is not None:
        known = written(features_of(labelled.select("url", F.col("label").cast("double")).where(F.col("label").isNotNull())), "urls-labelled")
    else:
        known = rows.where(F.col("label").isNotNull())
    stats, prior = suffix_statistics(known)
    scored = with_score(rows, fitted(known, stats, prior), stats, prior)
    method = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*keys, "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score")


def held_out(labelled: DataFrame) -> DataFrame:
    """(label, score, prior) of the labelled URLs of every third host by hash, scored by trees and statistics of the other hosts."""
    known = written(features_of(labelled.select("url", F.col("label").cast("double")).where(F.col("label").isNotNull())), "urls-labelled")
    aside = F.pmod(F.crc32("host"), F.lit(3)) == 1
    train = known.where(~aside)
    stats, prior = suffix_statistics(train)
    return with_score(known.where(aside), fitted(train, stats, prior), stats, prior).select("label", "score", F.lit(prior).alias("prior"))
