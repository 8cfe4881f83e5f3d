"""Spelling variants, WARC archives and token alignment against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import gzip
import hashlib
import itertools
import json
import os
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import TEXTS, docs_frame, sentence
from tokenizers import Tokenizer

from quartzline.llm import spelling, token_alignment, warc

# op11


def brute_variants(docs, least=5):
    count = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    form, found = {}, {}
    for w in n:
        others = sorted((v for v in n if v != w and near(v, w)), key=lambda v: (-n[v], v))
        found[w] = len(others)
        form[w] = others[0] if others and n[others[0]] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], found[w], n.get(form[w]))
    return out


def spelled(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, word string, n long, rank string, pos int, root string")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(d).collect()}


def test_variants_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    letters = "abéz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(150)]
    words += ["banana", "bananna", "banna", "baanana", "Straße", "straße", "aaaaaa", "aaaaaaa", "aaaaaaaa", "kitten" * 40, "kitten" * 40 + "s", "ÀÀÀÀÀÀ", "×÷×÷×÷"]
    words += [w[:i] + c + w[i + k :] for w in words[:40:4] for i, c, k in ((2, "", 1), (3, "b", 1), (4, "z", 0))]
    weight = [20 if k % 4 == 0 and k < 150 else 1 for k in range(len(words))]
    docs = [(None if i % 50 == 0 else i % 90, " ".join(rng.choices(words, weight, k=60)), "x", 1, "x", 1, "x") for i in range(120)]
    docs += [(200 + i, text, "x", 1, "x", 1, "x") for i, text in enumerate(["chained " * 30] * 10 + ["chaineds " * 5] * 8 + ["chainedsz " * 2] * 3)]
    docs += [docs[5], docs[5], (7, None, "x", 1, "x", 1, "x"), (8, "", "x", 1, "x", 1, "x"), (9, "1_2-3", "x", 1, "x", 1, "x")]
    want = brute_variants([(i, t) for i, t, *_ in docs])
    assert spelled(spark, docs) == want
    assert sum(v[0] is not None for v in want.values()) > 10 and any(w != v[1] and v[0] != v[1] for w, v in want.items()) and any(not v[3] for v in want.values())


def test_variants_of_long_words_ties_and_nothing(spark):
    long = "q" * 3000
    rows = [(i, f"{long} {long}x abcdefg abcdefh abcdefi abcdefi abcdefi abcdefi abcdefi " + "zabcdef " * 6, "x", 1, "x", 1, "x") for i in range(6)]
    got = spelled(spark, rows)
    assert got == brute_variants([(i, t) for i, t, *_ in rows])
    assert got["abcdefg"][0] == "abcdefi" and got[long][3] == 1
    assert spelled(spark, []) == {} and spelled(spark, [(1, None, "x", 1, "x", 1, "x")]) == {}


def test_group_keys_are_equal_for_equal_groups_only():
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(400)}
    wild, cut = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        lacking = set()
        for pos, k1, k2, _, whole in spelling.group_keys(1, w):
            if pos >= 0:
                wild[pos, k1, k2].add((pos, w[:pos], w[pos + 1 :]))
            elif whole:
                cut[k1, k2].add(w)
            else:
                lacking.add((k1, k2))
        forms = {w[:i] + w[i + 1 :] for i in range(len(w))}
        assert len(lacking) == len(forms)
        for f in forms & words:
            assert (spelling.group_keys(1, f)[0][1:3]) in lacking
    assert all(len(v) == 1 for v in wild.values()) and all(len(v) == 1 for v in cut.values())


# op12

URLS = ["http://www.example.com/a?b=1#c", "https://Example.COM/a?b=1", "ftp://b.example.com", None, "no scheme", "http://example.com/a b\r\nX: y", "http://é.example/ü", "", "http://x.org/" + "p" * 5000]


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "d", "t") for r in rows], "page_id long, url string, html string, key string, digest string, payload string")


def brute_records(rows):
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = raw in first and i != first[raw]
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=repr)


def page_rows():
    rng = random.Random(5)
    bodies = [None, "", "x" * 99, "é" * 50, "y" * 100, "<html>" + "long " * 60_000, *(sentence(rng, 40) for _ in range(12))]
    rows = [(i, URLS[i % len(URLS)], rng.choice(bodies)) for i in range(300, 0, -1)]
    return rows + [(None, "http://a.b/", "y" * 100), (None, None, None), rows[4], rows[4], (7, "http://other.org/", rows[9][2])]


def test_pages_come_back_from_archives_by_their_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)  # many blocks; and many captures of one key over several of them
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5_000)
    rows = page_rows()
    got = warc.page_records(pages_frame(spark, rows).repartition(5), str(tmp_path / "w"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_records(rows)
    assert warc.page_records(pages_frame(spark, [])).count() == 0
    assert warc.page_records(pages_frame(spark, rows)).columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives_are_gzip_members_that_other_readers_understand(spark, tmp_path):
    rows = page_rows()
    folder = str(tmp_path / "w")
    captures = warc.write_archives(pages_frame(spark, rows).repartition(3), folder).collect()
    seen = 0
    for name in os.listdir(folder):
        whole = gzip.open(f"{folder}/{name}").read()
        at = 0
        while at < len(whole):
            head, _, rest = whole[at:].partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1" and all(re.match(r"[\w-]+: [^\r\n]*$", x) for x in lines[1:])
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            if fields["WARC-Type"] == "response":
                http, _, payload = rest[:n].partition(b"\r\n\r\n")
                assert f"Content-Length: {len(payload)}".encode() in http and fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Profile"] == warc.PROFILE and fields["WARC-Refers-To"] and rest[:n].endswith(b"\r\n\r\n")
            seen += fields["WARC-Type"] != "warcinfo"
            at += len(head) + 4 + n + 4
    assert seen == len(captures) == len(rows)


def test_index_finds_what_a_scan_finds_and_reads_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 10)
    folder = str(tmp_path / "w")
    pages = pages_frame(spark, [(i, f"http://h{i % 37}.example.org/p{i % 211}", "body") for i in range(2000)] + [(5000 + i, "http://hot.org/", "b") for i in range(900)])
    captures = warc.write_archives(pages.repartition(4), folder)
    parts = warc.build_index(captures, folder)
    all_rows = [tuple(r) for r in captures.collect()]
    keys = sorted({r[0] for r in all_rows})
    assert sum(p.lines for p in parts.collect()) == len(all_rows) and keys[0].startswith("org,")
    asked = [keys[0], keys[-1], keys[500], "org,hot)/", "", "zzz", "org,example,h1)/p", keys[500]]
    got = warc.lookup(spark.createDataFrame([(k,) for k in asked], "key string"), parts, folder)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in all_rows if r[0] in asked)
    records = warc.read_records(got, folder).collect()
    assert len(records) == got.count() and all(r.payload in (b"body", b"b") for r in records)
    # The directory is sparse, and each part's blocks are in order.
    for p in parts.collect():
        data = open(f"{folder}/{p.part}", "rb").read()
        directory = json.loads(zlib.decompress(data[p.directory_at : p.directory_at + p.directory_bytes], 31))
        assert len(directory) == -(-p.lines // 10) and [x[0] for x in directory] == sorted(x[0] for x in directory)


def test_url_keys(spark):
    d = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = [r[0] for r in d.select(warc.url_key(F.col("url"))).collect()]
    assert got[:5] == ["com,example,www)/a?b=1", "com,example)/a?b=1", "com,example,b)", "", ")no scheme"]


# op13

ODD = ["", None, " ", "\n\n \t", "a▁b", "<|endoftext|> <s></s> <unk> <0x41>", "日本語のテキスト 한국어", "👩‍👩‍👧‍👦 emoji 🏴", "ﬁ ① ½ é é", "\0nul\0", "x" * 3000, " " * 2000 + "end", "don't WE'LL 12345678 3.14", "नमस्ते दुनिया", "same", "same"]


def brute_alignment(texts):
    """Per text with lists: pairs of tokens by byte ranges, groups by common ends."""
    folder = token_alignment.TOKENIZERS
    spec = json.load(open(f"{folder}/byte_bpe_50k.json"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter, k = {}, 0
    for b in range(256):
        letter[chr(b if b in plain else 256 + k)] = b
        k += b not in plain
    entry = {i: t for t, i in spec["model"]["vocab"].items()}
    a_model = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    docs, holding = [], collections.Counter()
    for t in texts:
        a = a_model.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        raw_a = [bytes(letter[c] for c in entry[i]) for i in a]
        pieces = [b_model.id_to_piece(i) for i in b]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            docs.append(None)
            continue
        ends_a, ends_b = list(itertools.accumulate(map(len, raw_a))), list(itertools.accumulate(map(len, raw_b)))
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
        cuts, text, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for c in cuts:
            p, q = ends_a.index(c) + 1, ends_b.index(c) + 1
            text.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        docs.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(text).encode()).hexdigest()))
        holding.update(set(links))
    best = {}
    for (x, _), n in holding.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*d[:3], len(d[3]), sum(holding[x] == best[x[0]] for x in d[3]), sum(holding[x] for x in d[3]), d[4]))
    return out


@pytest.mark.parametrize(("frequent", "chunk"), [(token_alignment.FREQUENT, token_alignment.CHUNK), (40, 300), (0, 1)])
def test_alignment_is_that_of_plain_loops(spark, frequent, chunk):
    rng = random.Random(6)
    syllables = ["ver", "tion", "Über", "é", "na", " ", "  ", "'s", "42", "\n", "的", "—"]
    texts = ODD + TEXTS + ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    got = token_alignment.alignments(docs_frame(spark, texts), frequent=frequent, chunk=chunk)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = {r[0]: tuple(r[1:]) for r in got.collect()}
    want = brute_alignment(texts)
    assert [rows[i] for i in range(len(texts))] == want
    assert want[4] == want[0] == (0, 0, 0, 0, 0, 0, "") and sum(w[2] != w[3] for w in want) > 20


def test_alignment_of_nothing_and_of_repeated_and_null_ids(spark):
    assert token_alignment.alignments(docs_frame(spark, [])).count() == 0
    d = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (None, None)], "doc_id long, text string")
    rows = sorted(map(tuple, token_alignment.alignments(d).collect()), key=repr)
    assert len(rows) == 4 and {r[6] for r in rows} == {0, 3 * rows[0][4]}


def test_union_find_is_that_of_sets():
    rng = np.random.default_rng(7)
    for n in (1, 2, 10, 300):
        for _ in range(30):
            u, v = rng.integers(0, n, n // 2 + 1), rng.integers(0, n, n // 2 + 1)
            group = {i: {i} for i in range(n)}
            for x, y in zip(u, v, strict=True):
                both = group[x] | group[y]
                for k in both:
                    group[k] = both
            assert token_alignment.components(u, v, n).tolist() == [min(group[i]) for i in range(n)]
    chain = rng.permutation(20_000)
    assert set(token_alignment.components(chain[:-1], chain[1:], 20_000)) == {0}


def test_both_byte_level_encoders_agree_on_every_kind_of_character():
    model = open(f"{token_alignment.TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8").read()
    encode, names = token_alignment.byte_level(model)
    plain = Tokenizer.from_str(model)
    plain.encode_special_tokens = True
    texts = [f" a{chr(c)}b {chr(c)}{chr(c)}1 {chr(c)}" for c in range(0, 0x20000, 13) if not 0xD800 <= c <= 0xDFFF]
    for t, e in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(t).tolist() == e.ids and b"".join(names[i] for i in e.ids) == t.encode()
