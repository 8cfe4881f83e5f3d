"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.75 or more, as connected components.

The size-aware heavy-light join. Sets up to a boundary size are small: each enumerates the subsets of as many shingles as it must share
with a small partner, and equal subsets are links. Every other link holds a large set, which scans the inverted lists of its rarest
shingles. The boundary is where the enumeration's cost exceeds the scan's.

Around this core:
* Documents of equal sets collapse to one node first.
* The global order of shingles puts frequent ones last, so passages that many documents share stay out of most prefixes. The table
  of frequent shingles is bounded; it only decides the order, never which links are found.
* Min-hash bands find most links of large groups of near copies beforehand, as stars. Lists that hold one component are dropped, so
  that such a group costs a few comparisons a member. The scan then finds every link between different components.
* The larger set of a pair probes, the smaller is indexed; both stop at the last position at which their first common shingle can stand.
* Every candidate pair is checked by exact intersection.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzline.llm.arrow import map_rows, slices
from quartzline.llm.components import components
from quartzline.llm.joins import near
from quartzline.session import counted, discard, rows, written

WORDS = 5
#: Similarity of 75 in 100.
NUMERATOR, DENOMINATOR = 75, 100
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
BANDS, BAND_ROWS = 8, 3
MULTIPLIERS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(1, BANDS * BAND_ROWS + 1)], dtype=np.uint64)
#: Shingles are counted within chunks of so many; those found twice in one are summed over all chunks.
CHUNK = 2_000_000
#: The most frequent shingles, at most so many and found at least so often, go last in the order.
FREQUENT, OFTEN = 100_000, 16
#: Sets up to this size can be small; a set of 16 has thousands of subsets to enumerate, more than its lists' entries by far.
SMALL = 16
#: A document's pairs are dealt to one task for each so many; its set is sent to each of them, which adds less than one set to HOT.
HOT = 128
#: Up to so many pairs, two numbers each, are broadcast to the sets of their first ends; beyond, these are shuffled.
BROADCAST_PAIRS = 500_000


def needed(total: int) -> int:
    """The intersection that two sets of so many elements together need: of sizes m and n, at least 75 / 175 of m + n."""
    return -(-NUMERATOR * total // (NUMERATOR + DENOMINATOR))


def needed_column(total: Column) -> Column:
    return F.ceil(total * NUMERATOR / F.lit(NUMERATOR + DENOMINATOR))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: five words each, or all words where there are fewer; none without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        x = x * MIX[0] + h[j : len(h) - k + 1 + j]
    x ^= x >> np.uint64(33)
    x *= MIX[1]
    x ^= x >> np.uint64(33)
    x *= MIX[2]
    x ^= x >> np.uint64(33)
    return np.unique(x)


def band_keys(h: np.ndarray) -> np.ndarray:
    least = (h[None, :] * MULTIPLIERS[:, None]).min(axis=1).reshape(BANDS, BAND_ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BAND_ROWS):
        keys = (keys * MIX[0] + least[:, j]) * MIX[1]
        keys ^= keys >> np.uint64(31)
    return keys


def longs(values: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if v is None else v.view(np.int64) for v in values], type=pa.list_(pa.int64()))


PROFILE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def profile(batches):
    """A row for each document: id, set size, digest of the set and band keys; and rows of (tokens, counts) found twice or more in a chunk.

    A chunk's shingles lie in one array, in which they are also sorted and counted.
    """
    held, size = np.empty(CHUNK, np.uint64), 0

    def counted(n):
        chunk = held[:n]
        chunk.sort()
        same = np.concatenate([[False], chunk[1:] == chunk[:-1], [False]])
        first, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())), longs([chunk[first]]), longs([last - first + 1])], schema=PROFILE)

    for batch in slices(batches):
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        n = len(sets)
        digests = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(digests, pa.binary()), longs([band_keys(h) if len(h) else None for h in sets]), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))],
            schema=PROFILE,
        )
        for h in sets:
            while len(h):
                part = h[: CHUNK - size]
                held[size : size + len(part)] = part
                size, h = size + len(part), h[len(part) :]
                if size == CHUNK:
                    yield counted(size)
                    size = 0
    if size:
        yield counted(size)


def prefixes(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(id, n, prefix, small): the shingles that a probing set must look up, rarest first; all of a set's shingles where it can be small."""
    order = np.argsort(frequent)
    frequent, counts = frequent[order], counts[order]

    def one(ident, text):
        h = shingles(text)
        n = len(h)
        if not n:
            return
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
            late = frequent[at] == h
            heavy = h[late]
            heavy = heavy[np.argsort(counts[at[late]], kind="stable")]
            h = np.concatenate([h[~late], heavy])
        probe = n - -(-NUMERATOR * n // DENOMINATOR) + 1
        # Copied, so that a waiting row doesn't hold the whole set.
        yield ident, n, h[:probe].copy().view(np.int64), h.view(np.int64) if n <= SMALL else None

    return map_rows(docs, one, "id long, n long, prefix array<long>, small array<long>")


def narrow(ident: int, text: str | None) -> list[tuple[int, int, np.ndarray]]:
    """(id, set size, distinct 16-bit hashes of the set's shingles)."""
    h = shingles(text)
    return [(ident, len(h), np.unique((h >> np.uint64(48)).astype(np.uint16)).view(np.int16))]


def wide(ident: int, text: str | None) -> list[tuple[int, int, np.ndarray]]:
    h = shingles(text)
    return [(ident, len(h), h.view(np.int64))]


def with_sets(pairs: DataFrame, sets: DataFrame, end: str, other: str, stored: DataFrame | None = None) -> DataFrame:
    """pairs with n and held of one end. The pairs of an end that has many are dealt over several tasks by their other end.

    stored: the same pairs as a written table, where pairs is none.
    """
    stored = pairs if stored is None else stored
    hot = stored.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("deals")).where(F.col("deals") > HOT)
    hot = counted(hot.select("id", F.ceil(F.col("deals") / HOT).cast("int").alias("deals")), "hot-ends") if rows(stored) > HOT else None
    if hot is None or not rows(hot):
        return pairs.join(sets.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("held").alias(f"held_{end}")), end)
    deals = F.coalesce("deals", F.lit(1))
    dealt = near(pairs.withColumn("id", F.col(end)), hot, "id", "left").select(*pairs.columns, F.pmod(F.xxhash64(other), deals).cast("int").alias("deal"))
    held = near(sets, hot, "id", "left").select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("held").alias(f"held_{end}"), F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    return dealt.join(held, [end, "deal"]).drop("deal")


def overlapping(pairs: DataFrame, docs: DataFrame, function, kind: str) -> DataFrame:
    """The pairs whose hashes overlap enough. Where hashes of one set coincide, each coincidence may hide one common shingle, so the
    lesser number of them is granted: no similar pair is lost, and with 64-bit hashes nothing is granted.
    """
    if not rows(pairs):
        return pairs
    ids = counted(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ids")
    sets = written(map_rows(near(docs, ids, "id", "left_semi"), function, f"id long, n long, held array<{kind}>"), "pair-sets")
    most = F.size(F.array_intersect("held_a", "held_b")) + F.least(F.col("n_a") - F.size("held_a"), F.col("n_b") - F.size("held_b"))
    if rows(pairs) <= BROADCAST_PAIRS:
        d = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("held").alias("held_a")).join(F.broadcast(pairs), "a")
    else:
        d = with_sets(pairs, sets, "a", "b")
    d = with_sets(d, sets, "b", "a", pairs)
    links = counted(d.where(most >= needed_column(F.col("n_a") + F.col("n_b"))).select("a", "b").distinct(), "links")
    discard(ids, sets)
    return links


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar: an upper bound from short hashes first, then the exact intersection."""
    pairs = counted(pairs.distinct(), "pairs")
    maybe = overlapping(pairs, docs, narrow, "short")
    links = overlapping(maybe, docs, wide, "long")
    discard(*{t.stored_at: t for t in (pairs, maybe) if t.stored_at != links.stored_at}.values())
    return links


def stars_to_least(members: DataFrame) -> DataFrame:
    """members: (key, id). Pairs of every member and the least id of its key."""
    least = written(members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where(F.col("a") != F.col("z")).select("key", "a"), "least")
    return members.join(least, "key").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct()


def subset_keys(ident: int, n: int, held: list[int], x: int) -> list[tuple[int, int, int, int, int]]:
    """(key, id, own size, lesser size, greater size): for each size up to x that a partner can have, the subsets that they must share."""
    out = []
    for m in range(math.ceil(n * NUMERATOR / DENOMINATOR), min(x, n * DENOMINATOR // NUMERATOR) + 1):
        low, high = min(m, n), max(m, n)
        for part in itertools.combinations(sorted(held), needed(n + m)):
            key = xxhash.xxh64_intdigest(np.array([low, high, *part], dtype=np.int64).tobytes())
            out.append((key - 2**63, ident, n, low, high))
    return out


def enumeration_cost(n: int) -> int:
    return sum(math.comb(n, needed(n + m)) for m in range(math.ceil(n * NUMERATOR / DENOMINATOR), n * DENOMINATOR // NUMERATOR + 1))


def boundary(listed: DataFrame) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, by the rows that each makes.

    listed: (id, n, size of the list). At most SMALL rows come to the driver.
    """
    work = listed.where(F.col("n") <= SMALL).groupBy("n").agg(F.sum("size").alias("scan"), F.countDistinct("id").alias("sets")).collect()
    best, x, total = 0, 0, 0
    for r in sorted(work, key=lambda r: r["n"]):
        total += r["sets"] * enumeration_cost(r["n"]) - r["scan"]
        if total <= best:
            best, x = total, r["n"]
    return x


def small_pairs(prefixed: DataFrame, x: int) -> DataFrame:
    """Pairs of small sets that share a subset. A key's sets of the one size all link with those of the other, so a star from each side's least id holds them together."""
    keys = map_rows(prefixed.where(F.col("n") <= x).select("id", "n", "small"), lambda ident, n, held: subset_keys(ident, n, held, x), "key long, id long, n long, low long, high long")
    keys = written(keys, "subsets")
    least = keys.groupBy("key", "low", "high").agg(F.min(F.when(F.col("n") == F.col("low"), F.col("id"))).alias("l"), F.min(F.when(F.col("n") == F.col("high"), F.col("id"))).alias("h"))
    d = keys.join(least, ["key", "low", "high"]).withColumn("a", F.when(F.col("n") == F.col("low"), F.col("h")).otherwise(F.col("l")))
    return d.where(F.col("a").isNotNull() & (F.col("a") != F.col("id"))).select("a", F.col("id").alias("b")).distinct()


def scan_pairs(rows: DataFrame, x: int) -> DataFrame:
    """Pairs in which the greater set, by (n, id), is larger than x and shares a listed shingle with one of another component.

    rows: (token, id, n, place, component). place counts from 1 in the set's order.
    """
    probe = rows.where(F.col("n") > x).select("token", F.col("id").alias("b"), F.col("n").alias("m"), F.col("place").alias("p"), F.col("component").alias("c"))
    index = rows.where(F.col("place") <= F.col("n") - needed_column(2 * F.col("n")) + 1)
    need = needed_column(F.col("n") + F.col("m"))
    fits = (F.col("component") != F.col("c")) & ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("id") < F.col("b"))))
    fits = fits & (F.col("n") * DENOMINATOR >= F.col("m") * NUMERATOR) & (F.col("place") <= F.col("n") - need + 1) & (F.col("p") <= F.col("m") - need + 1)
    return index.join(probe, (index["token"] == probe["token"]) & fits).select(F.col("id").alias("a"), "b").distinct()


def joined_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row of docs.

    Null and empty texts, and texts without words, have empty sets and are linked with nothing. Texts of fewer than five words
    are one shingle. Rows that repeat a key are one node, linked by any of its texts, and repeat here; rows with a null key take part in no link
    and are their own component, null. Other columns are ignored.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    profiles = written(docs.mapInArrow(profile, "id long, n long, digest binary, bands array<long>, tokens array<long>, counts array<long>"), "profiles")
    rows = profiles.where(F.col("digest").isNotNull()).select("id", "n", "digest", "bands")
    full = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    # Written, so that the join's two sides are plain shuffles and a hot digest can be split.
    classes = written(full.groupBy("digest").agg(F.min("id").alias("node")), "classes")
    nodes = written(full.join(classes, "digest").select("id", "n", "node", F.when(F.col("id") == F.col("node"), F.col("bands")).alias("bands")), "nodes")

    chosen = nodes.where(F.col("bands").isNotNull())
    links = verified(stars_to_least(chosen.select(F.explode("bands").alias("key"), "id")), docs)
    known = components(links).withColumnRenamed("node", "id")

    often = profiles.where(F.col("tokens").isNotNull()).select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy("x.tokens").agg(F.sum("x.counts").alias("n"))
    often = often.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "tokens").limit(FREQUENT).toArrow()
    frequent, counts = often["tokens"].to_numpy().view(np.uint64), often["n"].to_numpy()

    # Only ids that are no node, or lie in a component found already, need a word from this table.
    idle = nodes.groupBy("id").agg(F.max(F.col("bands").isNotNull()).alias("chosen")).where(~F.col("chosen")).select("id", F.lit(None).cast("long").alias("component"), F.lit(True).alias("idle"))
    other = counted(idle.unionByName(known.where(F.col("component") != F.col("id")).select("id", "component", F.lit(False).alias("idle"))), "other")
    own = near(prefixes(docs, frequent, counts), other, "id", "left").where(~F.coalesce("idle", F.lit(False)))
    prefixed = written(own.select("id", F.col("n").cast("int").alias("n"), F.coalesce("component", "id").alias("component"), "prefix", "small"), "prefixes")
    tokens = prefixed.select("id", "n", "component", F.posexplode("prefix").alias("place", "token")).withColumn("place", F.col("place") + 1)
    lists = tokens.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    listed = written(tokens.join(lists.where(F.col("low") != F.col("high")).select("token", "size"), "token"), "listed")
    x = boundary(listed)
    more = verified(small_pairs(prefixed, x).unionByName(scan_pairs(listed, x)), docs)
    discard(other, prefixed, listed)

    whole = components(links.unionByName(more)).withColumnRenamed("node", "of")
    member = nodes.select("id", "n", "node").join(whole, F.col("node") == F.col("of"), "left").select("id", "n", F.coalesce("component", "node").alias("component_id"))
    least = member.groupBy("id").agg(F.min("component_id").alias("component_id"))
    empty = rows.where((F.col("n") == 0) | F.col("id").isNull()).select("id", "n")
    out = full.select("id", "n").join(least, "id").unionByName(empty.join(least, "id", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""
