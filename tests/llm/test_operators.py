"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzline.llm import chat_trees, components, html_text, matroska, mixing, packing, pii, quality_rules, rule_ensemble, similarity_join, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_words string, score string, size string"


def docs_frame(spark, texts, sources=None, extra="x"):
    rows = [(i, t, "en" if i % 3 else None, (sources or ["a", "b", None])[i % 3] if sources is None else sources[i], extra, extra, extra) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


TEXTS = ["", None, " \t\n", "one", "Émile ünï €", "a b a b a b", "x" * 200_000, "word " * 5000, "same text", "same text"]


# op1


def test_media_round_trip(spark):
    rows = {r.doc_id: r for r in matroska.text_media(docs_frame(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (len(raw), len(payload))
        assert rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and rows[i].tail_crc32 == zlib.crc32(payload[-32:])
    assert rows[8][1:] == rows[9][1:] and rows[0][1:] == rows[1][1:]
    assert matroska.text_media(docs_frame(spark, [])).count() == 0


def test_packet_table_reads_every_lacing_and_reports_broken_files(spark):
    def block(kind, sizes, data):
        if kind == matroska.XIPH:
            head = bytes([len(sizes) - 1]) + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
        elif kind == matroska.FIXED:
            head = bytes([len(sizes) - 1])
        elif kind == matroska.EBML_LACING:
            head = bytes([len(sizes) - 1]) + matroska.vint(sizes[0])
            for a, b in itertools.pairwise(sizes[:-1]):
                head += (b - a + 8191 | 1 << 14).to_bytes(2, "big")
        else:
            head = b""
        return matroska.element(matroska.SIMPLE_BLOCK, matroska.vint(1) + b"\x00\x05" + bytes([0x80 | kind << 1]) + head + data)

    for kind, sizes in ((0, [7]), (1, [300, 5, 9]), (2, [4, 4, 4]), (3, [10, 700, 3, 8])):
        data = bytes(random.Random(kind).randrange(256) for _ in range(sum(sizes)))
        cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.number(matroska.TIMESTAMP, 100) + block(kind, sizes, data)  # of unknown size
        found, _ = matroska.packets(matroska.HEADER + matroska.element(matroska.SEGMENT, cluster))
        assert [p[3] for p in found] == sizes and {p[1] for p in found} == {105}
        assert b"".join((matroska.HEADER + matroska.element(matroska.SEGMENT, cluster))[p[2] : p[2] + p[3]] for p in found) == data
    files = matroska.encode_texts(docs_frame(spark, ["a" * 6000, None])).unionByName(spark.createDataFrame([(9, 0, bytearray(b"\x1a\x45\xdf")), (8, 0, None)], "doc_id long, n_bytes long, media binary"))
    rows = matroska.packet_table(files).collect()
    assert collections.Counter(r.doc_id for r in rows) == {0: 11, 1: 1, 9: 1, 8: 0} | {8: 0} or collections.Counter(r.doc_id for r in rows)[0] == 11
    assert [r.error for r in rows if r.doc_id == 9] != [None]


# op2


def test_optimal_bounds_match_enumeration():
    rng = random.Random(1)
    for _ in range(30):
        edges = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in edges]
        k = rng.randrange(1, 5)
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= e) - e) for e, c in zip(edges, counts))
        best = min(cost([*c, edges[-1]]) for r in range(min(k, len(edges))) for c in itertools.combinations(edges[:-1], r))
        got = packing.optimal_bounds(*(np.array(x, float) for x in (edges, counts, [e * c for e, c in zip(edges, counts)])), k)
        assert len(got) <= k and got[-1] == edges[-1] and cost(got) == best


def test_packing_fills_batches_within_the_budget(spark):
    rng = random.Random(2)
    texts = [sentence(rng, rng.choice([0, 1, 5, 50, 400])) for _ in range(150)] + [None, sentence(rng, 900)]
    rows = packing.pack(docs_frame(spark, texts).unionByName(docs_frame(spark, texts[:1])), buckets=4, budget=500).collect()
    assert len(rows) == len(texts) + 1
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.length <= r.bucket_bound and r.padding == r.bucket_bound - r.length
        batches[r.bucket, r.batch].append(r)
    for rs in batches.values():
        assert len(rs) == 1 or len(rs) * rs[0].bucket_bound <= 500
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    for b in {r.bucket for r in rows}:  # all batches of a bucket but the last are full
        sizes = [len(batches[b, k]) for k in range(len([1 for x in batches if x[0] == b]))]
        assert set(sizes[:-1]) <= {sizes[0]} and sizes[-1] <= sizes[0]
    assert packing.pack(docs_frame(spark, [])).count() == 0


def test_long_lengths_are_bound_by_lengths_that_occur(spark, monkeypatch):
    frame = lambda lengths: spark.createDataFrame([(x,) for x in lengths], "length long")
    assert packing.bucket_bounds(frame([1025] * 9)) == [1025]
    assert packing.bucket_bounds(frame([1025, 1026, 1030]), 3) == [1025, 1026, 1030]
    monkeypatch.setattr(packing, "BINS", 2)
    assert packing.bucket_bounds(frame([7, 1025, 1026, 1030]), 3) == [7, 1030]


def test_packing_is_exact_whatever_the_number_of_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "BINS", 2)
    lengths = [7, 1025, 1025, 1026, 1030, 1030, 1030]
    rows = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long"), text="n", length=F.col("n"), buckets=3).collect()
    assert sorted((r.length, r.bucket_bound) for r in rows) == [(7, 7), (1025, 1026), (1025, 1026), (1026, 1026), (1030, 1030), (1030, 1030), (1030, 1030)]
    assert sum(r.padding for r in rows) == 2


# op3

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def good(kind, hit):
        d = re.sub("[^0-9]", "", hit)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in hit.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if good(k, m[0])]


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(5)
    texts = ["", None, "a@b.c%d@e.f x..y@z-.q. a@b@c.d", "1.2.3.4.5.6.7.8 1.1.1.256 010.0255.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 4", "+49 (30) 123-4567 +1 +12345", "€é 4111111111111111 +44 20 7946 0958é", "9" * 50_000, "a" * 50_000 + "@", "1 " * 20_000]
    texts += ["".join(rng.choice("ab1234 5.@+-(é\n") for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = {r.doc_id: r for r in pii.span_digests(docs_frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (t, spans, rows[i].spans)
        assert [rows[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in spans) for k in BASE]
    assert pii.span_digests(docs_frame(spark, [])).count() == 0


def test_revealing_terms_are_found_and_texts_rewritten(spark):
    plain = [f"the common words of document {i} are the same" for i in range(60)]
    held = [f"the reply of Zebulon Quark goes to the box me@site{1}.org on the {d}" for d in ("monday", "friday")]
    docs = docs_frame(spark, plain + held)
    spans = {r.doc_id: r.spans.split(",") for r in pii.span_digests(docs).collect()}
    words = lambda i: {held[i - 60][int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans[i]}
    assert {"me@site1.org", "Zebulon", "Quark"} <= words(60) and "the" not in words(60) and "monday" not in words(60)
    assert all(spans[i] == [""] for i in range(60))
    out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert [out[i] for i in range(60)] == plain and "[EMAIL]" in out[60] and "Zebulon" not in out[60] and out[60].endswith("on the monday")
    assert pii.sanitised(docs).columns == docs.columns


def test_revealing_terms_far_away_and_in_other_documents_are_replaced(spark):
    far = " the" * 60
    plain = [f"the common words of document {i} are the same" for i in range(300)] + ["the house of Quark alone"]
    held = [f"me@site1.org{far} Zebulon Quark" for _ in range(2)] + [f"orgé one@site2.org\x01éab{far} Solitary"]
    docs = docs_frame(spark, plain + held)
    out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert [out[i] for i in range(300)] == plain[:300] and "Quark" not in out[300] and out[300].startswith("the house of ")
    assert all(out[i].startswith("[EMAIL] the the") and not {"Zebulon", "Quark"} & set(out[i].split()) for i in (301, 302))
    assert out[303].endswith("Solitary")
    rows = {r.doc_id: r for r in pii.span_digests(docs, whole=True).collect()}
    assert rows[300].n_email == 0 and len(rows[300].spans.split(",")) == 1 and len(rows[303].spans.split(",")) == 1
    assert pii.sanitised(docs_frame(spark, [])).count() == 0


# op4


def water_fill(sizes, weights=(5, 2, 1), epochs=2, budget=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, clamped = {}, set()
    while True:
        free = budget * sum(sizes.values()) - sum(epochs * sizes[s] for s in clamped)
        rest = sum(w[s] for s in names if s not in clamped)
        target = {s: epochs * sizes[s] if s in clamped else free * w[s] / rest for s in names}
        over = {s for s in names if target[s] > epochs * sizes[s] + 1e-9}
        if not over:
            return target
        clamped |= over


def test_mix_meets_clamped_targets(spark):
    rng = random.Random(7)
    sources = [rng.choice(["hot"] * 6 + ["b", "c", "é", None]) for _ in range(600)]
    texts = [None if i % 50 == 0 else sentence(rng, rng.randrange(60)) for i in range(600)]
    docs = docs_frame(spark, texts, sources)
    rows = mixing.mix_sizes(docs).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for s, t in zip(sources, texts):
        sizes[s] += len(WORD.findall(t or ""))
    expected = water_fill(dict(sizes))
    for r in rows:
        s = sources[r.doc_id]
        taken[s] += r.taken
        assert abs(r.target - expected[s]) < 1e-6 and r.source_size == sizes[s] and r.taken <= 2 * r.size
    assert all(abs(taken[s] - expected[s]) <= 30 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sizes(docs.repartition(7)).collect()))
    copies = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in rows if r.size) and mixing.mixed(docs).columns == docs.columns
    assert mixing.mix_sizes(docs_frame(spark, [])).count() == 0 and mixing.mix_sizes(docs_frame(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0


# op5


def brute_components(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_join_matches_brute_force(spark):
    rng = random.Random(11)
    shared = sentence(rng, 60)
    texts = [None, "", " \n ", "A b", "a  B", "a b c", "the end of it all", "THE end of it all", "é É", "É É"]
    for n in (5, 6, 8, 9, 12, 30, 120, 300):
        base = sentence(rng, n).split()
        for k in range(7):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(n)] = f"edit{rng.randrange(9)}"
            texts.append(" ".join(w))
        texts += [" ".join(base + base[: n // 8]), " ".join(base[: n - n // 9])]
    texts += [shared + " " + sentence(rng, n) for n in (5, 10, 15, 20, 25, 100)] + [sentence(rng, 40) + " " + shared for _ in range(25)] + ["z " * 30_000]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_join.joined_components(docs_frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_join_edge_tables(spark):
    assert similarity_join.joined_components(docs_frame(spark, [])).count() == 0
    twice = docs_frame(spark, ["a b c d e f", None]).unionByName(docs_frame(spark, ["a b c d e f", None]))
    assert sorted(tuple(r) for r in similarity_join.joined_components(twice).collect()) == [(0, 2, 0), (0, 2, 0), (1, 0, 1), (1, 0, 1)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (100, 101)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# op6


def test_html_keeps_the_article_alone(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies, really, many of them, and more.</div><div id="main"><h1>Title &amp; more</h1><p>First,   paragraph&nbsp;with <b>bold</b>, commas, and a long enough text to count for something in the end.
    <p>Second a &lt; b <br>after break, also with some commas, to be a good paragraph of text.<ul><li>Item one<li>Item two</ul><!-- hidden --><form>Name <input></form><div class="comments"><p>Reader says, well, this is a comment.</p></div></div>
    <aside><p>Side, bar, text, here.</p></aside><div class=ad>Buy, buy, buy, now.</div><footer>&copy; foot</footer></body></html>"""
    expected = "Title & more\n\nFirst, paragraph with bold, commas, and a long enough text to count for something in the end.\n\nSecond a < b after break, also with some commas, to be a good paragraph of text.\n\nItem one\n\nItem two"
    assert html_text.main_text(page) == expected
    assert html_text.main_text("<body><nav>x</nav><article><h1>A</h1><p>b</article><footer>c") == "A\n\nb"
    assert html_text.main_text("<article><p>cut off &am") == "cut off &am"
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (3, "v", "", "x"), (4, "w", "<p>" + "long, text " * 20_000, "x")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    assert rows[1].text == expected and rows[1].n_chars == len(expected) and (rows[2].text, rows[3].text) == ("", "") and rows[4].n_chars == 220_000 - 1
    assert html_text.extract_text(pages).count() == 5 and html_text.extract_text(pages.limit(0)).count() == 0


# op7


def test_html_keeps_a_wrapper_whose_name_holds_a_hint():
    prose = "".join(f"<p>Paragraph {i} of the article, with clauses, and enough words to count as prose in the score.</p>" for i in range(4))
    side = "<div class='sidebar'><p>Side links, and more of them, that nobody reads.</p></div>"
    for name in ("class='layout with-sidebar'", "class='post no-comments'", "class='content-widget'", "id='search-result'"):
        for inner in (prose, f"<article>{prose}</article>"):
            text = html_text.main_text(f"<body><div {name}>{inner}{side}</div><div class='ad'>Buy</div></body>")
            assert text.count("of the article") == 4 and "Side links" not in text and "Buy" not in text, name
    text = html_text.main_text(f"<body><div class='sidebar'><main>{prose}</main></div></body>")
    assert text.count("of the article") == 4
    text = html_text.main_text(f"<body><article><h1>Title</h1><div class='entry no-comments'>{prose}</div></article></body>")
    assert text.count("of the article") == 4 and "Title" in text
    replies = "<div class='comment-list'><article><p>" + "A reply, and a long one, " * 60 + "</p></article></div>"
    assert "A reply" not in html_text.main_text(f"<body><article>{prose}</article>{replies}</body>")


def test_rules_learn_and_never_see_held_out_labels(spark):
    rng = random.Random(3)
    texts = [sentence(rng, rng.randrange(20, 90)) if i % 3 else "### " * rng.randrange(5, 40) + sentence(rng, 20) for i in range(240)] + ["", None]
    labels = spark.createDataFrame([(i, int(i % 3 > 0) if zlib.crc32(str(i).encode()) % 3 != 1 else 9) for i in range(0, 240)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in rule_ensemble.quality_scores(docs_frame(spark, texts), labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [i for i in range(240) if rows[i].held_out]
    assert sum(rows[i].predicted == int(i % 3 > 0) for i in held) >= 0.95 * len(held)
    none = rule_ensemble.quality_scores(docs_frame(spark, ["a", None]), labels.limit(0))
    assert [r.score for r in none.collect()] == [0.5, 0.5] and rule_ensemble.quality_scores(docs_frame(spark, []), labels).count() == 0


def test_paths_are_conjunctions():
    tree = "DecisionTree\n  If (feature 0 <= 1.5)\n   If (feature 1 > 2.0)\n    Predict: 1.0\n   Else (feature 1 <= 2.0)\n    Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 0.0\n"
    assert rule_ensemble.paths_of(tree, ("a", "b")) == [(("a", False, 1.5),), (("a", False, 1.5), ("b", True, 2.0)), (("a", False, 1.5), ("b", False, 2.0)), (("a", True, 1.5),)]


# op8


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "\\\\l<", "</turn>\n", "<text><turn>", "a\\l<b\nß", "x" * 50_000, r"\### Assistant: </turn> ok"]
    rows = [(c, k, ("user", "assistant", "<system>")[k % 3], odd[(c + k) % len(odd)]) for c in range(9) for k in range(c % 5 + 1)] + [(50, 1, "assistant", "tie"), (50, 1, "assistant", "tie"), (50, 1, None, "tie")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string")
    got = {r.conv_id: r for r in chat_trees.chat_digests(d).collect()}
    assert len(got) == 10
    for c, r in got.items():
        turns = sorted(((t, role or "", text or "") for i, t, role, text in rows if i == c))
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest()), c
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_trees.chat_digests(d.limit(0)).count() == 0


def test_reply_trees_rank_their_paths(spark):
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 4, 2.0), (2, 1, None, None), (3, 9, 77, 1.0)]
    d = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    got = collections.defaultdict(list)
    for r in sorted(chat_trees.best_paths(d, keep=2).collect(), key=lambda r: -r.up):
        got[r.tree, r.rank].append(r.node)
    assert got == {(1, 1): [1, 3, 4, 5], (1, 2): [1, 2], (2, 1): [1], (3, 1): [9]}
    long = spark.createDataFrame([(1, k, k - 1 if k else None, 0.0) for k in range(150)], "tree long, node long, parent long, score double")
    assert chat_trees.best_paths(long).count() == 150


# op9


def test_urls(spark):
    urls = ["http://A.Example.org/es/1?x=/y#z", "https://example.org/en/12", "https://example.org", "//x", None, "", "ftp://com/fr/", "http://x.com/de/a", "http://notexample.org/es/", "http://a.net/p://q/r", "http://q.net?x#y", "http://sub.com/fr/://", "HTTP://İ.com/FR/"] * 3
    rows = url_filter.url_verdicts(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()
    assert len(rows) == len(urls)
    for r in rows:
        u = urls[r.page_id] or ""
        m = re.search(r"://([^/?#]*)([^?#]*)", u, re.S)
        host, path = (m[1].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), m[2]) if m else ("", "")
        fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[0]) and r.verdict == (best[1] or r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_boosted_trees_learn_from_labelled_urls(spark):
    bad = [(f"http://win{i}{i * 7 % 10}{i * 3 % 10}.net/a/{i}?a=1&b=2&c=3", 1) for i in range(80)]
    good = [(f"https://quiet.net/essays/{'abcdefgh'[i % 8]}", 0) for i in range(80)]
    labelled = spark.createDataFrame(bad[:60] + good[:60], "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(bad[60:] + good[60:])], "page_id long, url string")
    rows = url_filter.url_verdicts(pages, rules=(), labelled=labelled).collect()
    assert sum((r.verdict == "block") == (r.page_id < 20) for r in rows) >= 38


# op10


def test_base_rules_and_outliers(spark):
    rng = random.Random(9)
    clean = [". ".join(sentence(rng, 12) for _ in range(rng.randrange(5, 30))) for _ in range(300)]
    bad = ["### $$$ " * 60 + sentence(rng, 80), "\n".join(["same old line here"] * 5 + [sentence(rng, 60)] * 2)]
    texts = clean + bad + ["", None, "short one", "a b c " * 40, "a a a", " \n x\n x\n"]
    rows = {r.doc_id: r for r in quality_rules.quality_verdicts(docs_frame(spark, texts, ["hot"] * len(texts))).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t[:50])
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert all(rows[i].kept for i in range(300)) and not rows[300].kept
    assert quality_rules.quality_verdicts(docs_frame(spark, [])).count() == 0
    assert not any(r.kept for r in quality_rules.quality_verdicts(docs_frame(spark, ["x", None])).collect())
