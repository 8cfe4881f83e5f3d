"""The corpus pipeline on a small corpus: every stage's decisions take effect."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    good = [text(rng.randrange(60, 120)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(good)] + [(200 + i, "### $$$ " * 30 + text(30)) for i in range(40)] + [(300, good[5]), (301, good[6] + " end"), (302, good[7] + " mail me@here.org now")]
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(not 200 <= i < 300)) for i, _ in rows if i % 2 == 0], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sf_dir = str(tmp_path)
    out = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir)
        kept[name] = out
        if name != "packing":
            assert out.columns == docs.columns
    ids = {r.doc_id for r in kept["quality classifier"].collect()}
    assert ids == {i for i, _ in rows if not 200 <= i < 300}
    ids = {r.doc_id for r in kept["n-gram Jaccard join"].collect()}
    assert ids == set(range(120))
    packed = out.collect()
    assert {r.doc_id for r in packed} <= set(range(120))
    assert kept["mixing"].count() == len(packed)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)
    one = kept["PII"].where(F.col("text").contains("@"))
    assert one.count() == 0


def test_row_counts_and_settled_steps_need_no_jobs(spark):
    """What each job leaves on the driver adds up over the steps: tables are counted as they are written, and steps without rows are left out."""
    from quartzline.llm.components import components
    from quartzline.session import counted, rows

    def jobs(group, action):
        spark.sparkContext.setJobGroup(group, group)
        out = action()
        spark.sparkContext.setJobGroup("", "")
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    for n in (0, 7):
        t = counted(spark.range(100).where(f"id < {n}").selectExpr("id", "id % 2 AS rest").distinct(), "numbers")
        assert jobs(f"counted-{n}", lambda: rows(t))[1] == 0  # noqa: B023
        assert rows(t) == t.count() == n
    edges = spark.createDataFrame([(1, 2), (3, 1), (5, 9), (7, 7), (None, 4), (2, 1)], "a long, b long")
    found, ran = jobs("stars", lambda: components(edges))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (9, 5)]
    assert ran <= 12, ran
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r["component"] for r in components(chain).collect()} == {0}
    assert components(edges.where("a > 100")).count() == 0

    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(20)] + [(50, " ".join(f"w3x{i}" for i in range(30)) + " more")], "doc_id long, text string")
    kept, ran = jobs("near", lambda: corpus_pipeline.near_duplicates(spark, docs, ""))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
    assert ran <= 90, ran
