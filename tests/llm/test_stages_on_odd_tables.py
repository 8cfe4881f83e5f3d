"""Every pipeline stage on nulls, empty texts, repeated rows, shared ids, clashing columns and empty tables."""

import random

import pytest
from test_operators import sentence

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size string, score double, draw string, row string, node long, id long, component_id long, __t string"


def odd_rows():
    rng = random.Random(21)
    good = [sentence(rng, rng.randrange(60, 120)) for _ in range(40)]
    texts = [*good, None, "", " \n\t", "x", "y " * 30_000, good[3], good[3] + " end", "mail me@here.org or 10.0.0.1"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, good[3]), (3, good[3]), (5, sentence(rng, 80)), (5, ""), (7, good[8]), (None, good[1]), (None, None), (2, None)]
    return [(i, t, "en" if k % 3 else None, "ab"[k % 2] if k % 5 else None, None if k % 7 == 0 else k, k, f"s{k}", 0.1, "d", "r", k, k, k, "t") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, 1) for i in range(20)] + [(4, None), (None, 0), (900, 0)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages():
    return dict(corpus_pipeline.STAGES)


def test_stages_keep_rows_and_columns(spark, folder, stages):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    as_rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    kept = stages["quality classifier"](spark, docs, folder)
    assert kept.columns == docs.columns and as_rows(kept) == sorted(rows, key=repr)  # labels of one kind reject nothing
    clean = stages["PII"](spark, docs, folder)
    assert clean.columns == docs.columns and [r for r in as_rows(clean) if r[1] is None or "[" not in r[1]] == [r for r in sorted(rows, key=repr) if r[1] is None or "@" not in r[1]]
    mix = stages["mixing"](spark, docs, folder)
    assert mix.columns == docs.columns and set(mix.collect()) <= set(docs.collect())
    packed = stages["packing"](spark, docs, folder)
    assert packed.count() == len(rows) and "batch" in packed.columns


def test_duplicates_keep_texts_that_are_not_linked(spark, folder, stages):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = stages["n-gram Jaccard join"](spark, docs, folder)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    texts = [r[1] for r in rows]
    assert got.count((3, texts[3])) == 1 and not any(i in (45, 46) for i, _ in got)  # copies and near copies go
    assert {t for i, t in got if i == 5} == {texts[5], "", texts[50]}  # one id, three texts
    assert {(i, t) for i, t in got if i == 7} == {(7, texts[7]), (7, texts[8])} and (8, texts[8]) not in got  # the copy of the smallest id stays
    assert (None, texts[1]) in got and (None, None) in got and {(40, None), (41, ""), (42, " \n\t"), (2, None)} <= set(got)
    assert {t for t in texts if t} - {texts[46]} == {t for _, t in got if t}
    again = stages["n-gram Jaccard join"](spark, docs.repartition(5), folder)
    assert sorted(map(repr, got)) == sorted(repr((r.doc_id, r.text)) for r in again.collect())


def test_stages_on_an_empty_table(spark, folder, stages):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in stages.items():
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name
