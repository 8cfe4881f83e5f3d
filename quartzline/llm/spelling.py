"""Spelling variant grouping: words at one inserted, deleted or replaced code point from each other, found without making their pairs.

Words are ranked by count, then code-point order, so that the best of several words is the least rank. For replacements each word joins one group
for each of its positions, keyed by (position, what stands before, what stands after). Such a group has one word for each letter at most; its size
and its two least ranks are all that a member needs. For insertions and deletions the forms a word takes by losing one code point meet the vocabulary
under the form itself. A word's near words differ from it in one way only, so counts add up and least ranks combine.

Group keys are polynomials of the code points modulo 2^127 - 1, so that a word of any length costs a fixed number of bytes a position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzline.llm.arrow import map_rows
from quartzline.session import discard, written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many (document, run) keys, by checksum, loses a code point.
SLIP = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5

PRIME = 2**127 - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F % PRIME
INVERSE = pow(BASE, -1, PRIME)
#: The group position of the forms that lack one code point.
LACKING = -1


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all runs of letters, lower-cased in A-Z, some of which lose a code point by a checksum of document and run.

    Null texts have no runs; a null key counts as an empty string in the checksum. Rows that repeat a key count each. Occurrences are summed on
    the map side, so a word that makes up a third of all is one row a task.
    """
    runs = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))
    d = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    d = d.select(F.when(h % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return d.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def halves(key: int) -> tuple[int, int]:
    return key >> 64, (key & (2**64 - 1)) - 2**63


def group_keys(rank: int, word: str) -> list[tuple[int, int, int, int, bool]]:
    """(position, two halves of the key, rank, whole) of every group that a word joins; whole marks the word's own form."""
    codes = [ord(c) for c in word]
    before, power = [0], 1  # before[i]: the polynomial of the first i code points
    powers = []
    for c in codes:
        powers.append(power)
        before.append((before[-1] + c * power) % PRIME)
        power = power * BASE % PRIME
    total = before[-1]
    out = [(LACKING, *halves(total), rank, True)]
    for i, c in enumerate(codes):
        out.append((i, *halves((total - c * powers[i]) % PRIME), rank, False))
        if i == 0 or codes[i - 1] != c:  # inside a run of one letter all deletions give one form
            out.append((LACKING, *halves((before[i] + (total - before[i + 1]) * INVERSE) % PRIME), rank, False))
    return out


def near_words(ranked: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words are near each and the least rank among them, for words that have any. ranked: rank, word."""
    rows = map_rows(ranked.select("rank", "word"), group_keys, "pos int, k1 long, k2 long, rank long, whole boolean")
    group = Window.partitionBy("pos", "k1", "k2")
    in_order = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own, other = F.when(F.col("whole"), F.col("rank")), F.when(~F.col("whole"), F.col("rank"))
    d = rows.withColumns(
        {
            "size": F.count("*").over(in_order),
            "first": F.first("rank").over(in_order),
            "second": F.nth_value("rank", 2).over(in_order),
            "shorter": F.max(own).over(in_order),
            "longer": F.count(other).over(in_order),
            "longest": F.min(other).over(in_order),
        }
    ).where(F.col("size") > 1)
    lacking = F.col("pos") == LACKING
    seen = F.when(~lacking, F.col("size") - 1).when(F.col("whole"), F.col("longer")).when(F.col("shorter").isNotNull(), 1)
    best = F.when(~lacking, F.when(F.col("first") == F.col("rank"), F.col("second")).otherwise(F.col("first"))).when(F.col("whole"), F.col("longest")).otherwise(F.col("shorter"))
    return d.select("rank", seen.cast("long").alias("seen"), best.alias("best")).where(F.col("seen") > 0).groupBy("rank").agg(F.sum("seen").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(rank, root): the last word that the forms lead to. forms: (rank, form_rank), a written table. Every round doubles the steps taken."""
    at = written(forms.select("rank", F.col("form_rank").alias("root"), F.lit(True).alias("moved")), "forms")
    while not at.where("moved").isEmpty():
        onward = at.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        after = written(at.join(onward, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        discard(at)
        at = after
    return at.select("rank", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    form: the near word of largest count, the first of equals, where it is TIMES as frequent; root: the word that forms lead to in the end, the word
    itself without one. Empty input gives empty output; other columns are ignored.
    """
    words = written(vocabulary(docs, key, text, least), "vocabulary")
    # Ids that grow with the order are enough to tell the better of two words.
    ranked = written(words.repartitionByRange(F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id()), "ranked")
    near = written(near_words(ranked), "near-words")
    counts = ranked.select("rank", "n")
    best = counts.select(F.col("rank").alias("best"), F.col("n").alias("best_n"))
    linked = near.join(counts, "rank").join(best, "best").withColumn("has", F.col("best_n") >= TIMES * F.col("n"))
    linked = written(linked.select("rank", "n_near", F.when(F.col("has"), F.col("best")).alias("form_rank"), F.when(F.col("has"), F.col("best_n")).alias("form_n")), "linked")
    roots = last_forms(linked.where(F.col("form_rank").isNotNull()))
    named = lambda r, w: ranked.select(F.col("rank").alias(r), F.col("word").alias(w))
    d = ranked.join(linked, "rank", "left").join(roots.withColumnRenamed("root", "root_rank"), "rank", "left")
    d = d.join(named("form_rank", "form"), "form_rank", "left").join(named("root_rank", "root"), "root_rank", "left")
    return d.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
  ) GROUP BY ALL
), bytes AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS h FROM bytes, t
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (SELECT word, n, i, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
less AS (SELECT DISTINCT word, n, p || s AS d FROM cut),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION ALL SELECT less.word, less.n, v.word, v.n FROM less JOIN v ON less.d = v.word
  UNION ALL SELECT v.word, v.n, less.word, less.n FROM less JOIN v ON less.d = v.word
), best AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM pairs GROUP BY word, n),
f AS (SELECT v.word, CASE WHEN m >= 5 * v.n THEN near END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f g ON g.word = walk.at WHERE g.form IS NULL
"""
