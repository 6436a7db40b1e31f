"""The pipeline's stages on a small table."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.exists(corpus_pipeline.MODEL), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.cut(out)
    assert 0 < docs.count() < 1.3 * before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count() and "piece_ids" in last.columns


def test_one_of_each_group_stays(spark):
    same = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, same, "en", "s", 1), (2, same, "en", "s", 1), (1, same, "en", "s", 1), (3, "other words stand in this text", "en", "s", 1), (None, "no id here", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [-1, 1, 3]


def test_near_copies_with_odd_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (1, b), (2, b), (3, a), (2, c), (None, d), (None, d), (None, c), (4, ""), (4, ""), (5, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for x in (docs, docs.repartition(5)):
        out = corpus_pipeline.drop_near_copies(spark, x, "")
        assert out.columns == docs.columns
        assert sorted(((r.doc_id or 0, r.text or "") for r in out.collect())) == [(0, ""), (0, d), (1, a), (1, b), (2, c), (4, ""), (5, "")]


def test_rejected_language(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the water and stone", "en", "s", 1) for i in range(20)] + [(30, "123 !!", "en", "s", 1), (31, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.keep_languages(spark, docs, "").collect()} == set(range(20))


@pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.exists(corpus_pipeline.MODEL), reason="no test tables")
def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, copy int, piece_ids string"
    rows = [(1, "the water and the stone", "en", "s", 1), (1, "the water and the stone", "en", "s", 1), (None, "a stone by the water", None, None, None), (2, "", "en", "s", 0), (3, None, None, None, None)]
    odd = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    for docs in (odd, odd.limit(0)):
        for name in ("toxicity", "language", "mix"):
            assert set(stages[name](spark, docs, DATA).columns) <= set(docs.columns), name
    kept = stages["toxicity"](spark, odd, DATA).groupBy("doc_id", "text").count().collect()
    assert {(r.doc_id, r.text): r["count"] for r in kept}[(1, "the water and the stone")] == 2
    assert len(kept) == 4
    mixed = {(r.doc_id, r.text): r["count"] for r in stages["mix"](spark, odd, DATA).groupBy("doc_id", "text").count().collect()}
    assert mixed.get((1, "the water and the stone"), 0) % 2 == 0
    out = stages["encode"](spark, odd, DATA).collect()
    assert len(out) == 5 and [r.n_pieces for r in out if r.doc_id in (2, 3)] == [0, 0]
    assert stages["encode"](spark, odd.limit(0), DATA).count() == 0
