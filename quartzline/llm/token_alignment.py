"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often their pairs meet in the corpus.

The tokens of a text under both tokenizers are the two sides of a graph; two are linked where their byte ranges overlap. Union-find over the links gives the
connected components, which are exactly the minimal groups that start and end together in both. A link's pair of ids counts once for each document that
holds it, over the whole corpus.

Two passes over the documents: the first tokenizes, groups, and sums the pairs of millions of links before they are shuffled; the second looks
up each link's count. Pairs from a count upwards that leaves at most FREQUENT of them travel with the tasks; the counts of the rare others, of
which none is hot, are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quartzline.llm.arrow import slices
from quartzline.session import discard, written

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of links that a task holds before it sums them.
CHUNK = 4_000_000
#: At most so many pairs travel to the tasks with their counts; the rest is joined by a shuffle.
FREQUENT = 1_000_000
#: Fixed value: how the byte-level tokenizer cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_level(model: str) -> tuple[Callable[[str], np.ndarray], list[bytes]]:
    """The encoder of a byte-level BPE file's text, and the bytes of each id.

    Where ids are in the order of the merges, as they are in the file given, ranks say all and the faster encoder gives the same ids; it gives
    way to the file's own one for other files and for texts that it can't cut.
    """
    spec = json.loads(model)
    special = {t["content"] for t in spec["added_tokens"]}
    letters = byte_letters()
    entries = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    names = [b""] * (max(spec["model"]["vocab"].values()) + 1)
    for t, i in entries.items():
        names[i] = bytes(letters[c] for c in t)
    plain = Tokenizer.from_str(model)
    plain.encode_special_tokens = True
    own = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    if [entries.get(m) for m in merged] != list(range(256, 256 + len(merged))) or spec["normalizer"] or not spec["pre_tokenizer"].get("use_regex"):
        return own, names
    ranked = tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks={names[i]: i for i in entries.values()}, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            return ranked.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # the encoder panics where its pattern would take too many steps
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return own(text)

    return encode, names


def piece_level(model: bytes) -> tuple[Callable[[str], np.ndarray], list[bytes]]:
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = []
    for i in range(pieces.get_piece_size()):
        p = pieces.id_to_piece(i)
        names.append(bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace(SPACE, " ").encode())
    return lambda text: np.array(pieces.encode(text, num_threads=1), np.uint32), names


def lengths(names: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in names], np.int64)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (a, b) of all pairs of tokens whose byte ranges overlap, in order. Both sides cover the same bytes.

    Two ranges overlap in one stretch without an end inside, so each stretch between neighbouring ends of either side is one link.
    """
    if not len(a_ends):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a_at, b_at = np.zeros(a_ends[-1] + 1, bool), np.zeros(b_ends[-1] + 1, bool)
    a_at[a_ends] = b_at[b_ends] = True
    ends = np.flatnonzero(a_at | b_at)
    place = lambda at: np.cumsum(at)[ends] - at[ends]  # noqa: E731  ends of the side before this one
    return place(a_at), place(b_at)


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Union-find over all links at once: the least node that each of n nodes is connected with.

    Each round hooks the greater root of every link that is still open under the lesser one and then shortens all paths to their roots.
    """
    parent = np.arange(n)
    while len(u):
        low, high = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
        still = low != high
        u, v = u[still], v[still]
        parent[high[still]] = low[still]
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def digits(n: int) -> np.ndarray:
    """Row i: the decimal digits of i, right-aligned, 0 before them."""
    width = len(str(n - 1))
    ids = np.arange(n)
    out = np.empty((n, width), np.uint8)
    for k in range(width):
        out[:, width - 1 - k] = np.where((ids >= 10**k) | (k == 0), 48 + ids // 10**k % 10, 0)
    return out


def group_text(ids: np.ndarray, keys: np.ndarray, shown: np.ndarray) -> np.ndarray:
    """Rows of bytes that read a1,a2|b1;... once the zeros are taken out. keys: twice the group, plus 1 for the second side; ids in order of keys."""
    out = np.empty((len(ids), shown.shape[1] + 1), np.uint8)
    out[:, :-1] = shown[ids]
    same = np.append(keys[1:] == keys[:-1], False)
    out[:, -1] = np.where(same, ord(","), np.where(keys % 2 == 0, ord("|"), ord(";")))
    return out


ALIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
    + [("a", pa.binary()), ("b", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)
ALIGNED_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, pairs array<long>, counts array<long>"


def starts(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def aligner(byte_model: str, piece_model: bytes, chunk: int) -> Callable:
    """A function of Arrow batches (doc_id, text): a row for each document with its tokens and groups, and rows of pairs and in how many documents of a chunk."""

    def run(batches):
        encode_a, names_a = byte_level(byte_model)
        encode_b, names_b = piece_level(piece_model)
        len_a, len_b = lengths(names_a), lengths(names_b)
        shown = digits(max(len(names_a), len(names_b)))
        none, held, size = np.empty(0, np.uint32), [], 0

        def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
            if not text:
                return none, none
            a, b, raw = encode_a(" " + text), encode_b(text), (" " + text).encode()
            whole = b"".join(map(names_a.__getitem__, a.tolist())) == raw and b"".join(map(names_b.__getitem__, b.tolist())) == raw
            return (a, b) if whole else (none, none)

        def counted():
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in ALIGNED.types[:-2]] + [one(pairs), one(counts)], schema=ALIGNED)

        for batch in slices(batches):
            both = [tokens(t) for t in batch.column(1).to_pylist()]
            a_from, b_from = starts([a for a, _ in both]), starts([b for _, b in both])
            a, b = joined([a for a, _ in both]), joined([b for _, b in both])
            # The texts of a slice stand end to end, and no token crosses from one to the next.
            ia, ib = overlaps(np.cumsum(len_a[a]), np.cumsum(len_b[b]))
            group = components(ia, len(a) + ib, len(a) + len(b))
            keys = np.concatenate([2 * group[: len(a)], 2 * group[len(a) :] + 1])
            order = np.argsort(keys, kind="stable")
            text = group_text(np.concatenate([a, b])[order], keys[order], shown)
            bounds = a_from + b_from
            shas = ["" if lo == hi else hashlib.sha256(text[lo:hi].tobytes().translate(None, b"\0")[:-1]).hexdigest() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            link_from = np.searchsorted(ia, a_from)
            n = len(both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(a_from)), pa.array(np.diff(b_from)), pa.array(per_text(group[: len(a)] == np.arange(len(a)), a_from)), pa.array(np.diff(link_from)), pa.array(shas, pa.string())]
                + [pa.array([x.astype("<u4").tobytes() if max(len(len_a), len(len_b)) > 1 << 16 else x.astype("<u2").tobytes() for x in side], pa.binary()) for side in zip(*both, strict=True)]
                + [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))],
                schema=ALIGNED,
            )
            space = len(len_a) * len(len_b)
            distinct = np.unique(np.repeat(np.arange(n), np.diff(link_from)) * space + a[ia].astype(np.int64) * len(len_b) + b[ib]) % space
            held.append(distinct)
            size += len(distinct)
            if size > chunk:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return run


FOUND = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<long>, times array<long>"


def finder(len_a: np.ndarray, len_b: np.ndarray, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Callable:
    """A function of Arrow batches (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a, b): sums over the links whose pair is among the frequent
    ones (sorted), and the other pairs of each document with how often it links them.
    """
    kind = "<u4" if max(len(len_a), len(len_b)) > 1 << 16 else "<u2"

    def run(batches):
        for batch in slices(batches):
            sides = [[np.frombuffer(x, kind) for x in c.to_pylist()] for c in batch.columns[-2:]]
            a_from, (a, b) = starts(sides[0]), map(joined, sides)
            ia, ib = overlaps(np.cumsum(len_a[a]), np.cumsum(len_b[b]))
            first, link_from = a[ia].astype(np.int64), np.searchsorted(ia, a_from)
            pair = first * len(len_b) + b[ib]
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            count = np.where(known, counts[at], 0) if len(pairs) else np.zeros(len(pair), np.int64)
            space = len(len_a) * len(len_b)
            rare, times = np.unique((np.repeat(np.arange(batch.num_rows), np.diff(link_from)) * space + pair)[~known], return_counts=True)
            rare_from = pa.array(np.searchsorted(rare, np.arange(batch.num_rows + 1) * space), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(per_text(known & (count == best[first]), link_from)), pa.array(per_text(count, link_from)), pa.ListArray.from_arrays(rare_from, pa.array(rare % space)), pa.ListArray.from_arrays(rare_from, pa.array(times, pa.int64()))],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rare", "times"],
            )

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many documents each pair of ids is linked."""
    d = aligned.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    return d.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))


def least_frequent(counts: DataFrame, most: int) -> int:
    """The level of counts from which on at most so many pairs are left, and past all levels if there is none. Levels are eighths of powers of two, so few rows come here."""
    levels = sorted(((r["level"], r["count"]) for r in counts.groupBy(level(F.col("n")).alias("level")).count().collect()), reverse=True)
    total, least = 0, 1 << 30
    for at, n in levels:
        total += n
        if total > most:
            break
        least = at
    return least


def level(n):
    return F.floor(F.log2(n) * 8)


def alignments(docs: DataFrame, tokenizers: str = TOKENIZERS, frequent: int = FREQUENT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs (doc_id, text).

    A: space + text in the byte-level vocabulary; B: the text in pieces, which add the space. Null and empty texts, and those that either side doesn't
    give back byte by byte, have no tokens: zeros and an empty digest. Rows that repeat a doc_id, or have none, count as documents of their own;
    other columns are ignored; empty input gives empty output. tokenizers: the folder of the two vocabularies, read on the driver.
    """
    with open(f"{tokenizers}/{BYTE_BPE}", encoding="utf-8") as f:
        byte_model = f.read()
    with open(f"{tokenizers}/{PIECE_BPE}", "rb") as f:
        piece_model = f.read()
    len_a, len_b = lengths(byte_level(byte_model)[1]), lengths(piece_level(piece_model)[1])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    aligned = written(d.mapInArrow(aligner(byte_model, piece_model, chunk), ALIGNED_DDL).withColumn("row", F.monotonically_increasing_id()), "aligned", "zstd")
    counts = written(pair_counts(aligned), "pair-counts")
    best = np.zeros(len(len_a), np.int64)
    found = counts.groupBy(F.floor(F.col("pair") / len(len_b)).alias("a")).agg(F.max("n").alias("n")).toArrow()  # at most a row for each id of A
    best[found["a"].to_numpy()] = found["n"].to_numpy()
    least = least_frequent(counts, frequent)
    known = counts.where(level(F.col("n")) >= least).toArrow()
    order = np.argsort(known["pair"].to_numpy())
    find = finder(len_a, len_b, known["pair"].to_numpy()[order], known["n"].to_numpy()[order], best)
    sums = aligned.where(F.col("pairs").isNull()).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b").mapInArrow(find, FOUND)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    others = counts.where(level(F.col("n")) < least)
    if others.isEmpty():
        return sums.select(*names)
    sums = written(sums, "sums")
    discard(aligned)
    of = F.floor(F.col("pair") / len(len_b))
    tops = others.join(F.broadcast(counts.groupBy(of.alias("of")).agg(F.max("n").alias("top"))), of == F.col("of")).select("pair", "n", (F.col("n") == F.col("top")).alias("is_best"))
    more = sums.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times")).join(tops, "pair")
    more = more.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"))
    added = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return sums.join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "more_best"), added("count_sum", "more_sum"), "groups_sha256")
