"""Queries of corpus operators against their SQL on the small tables."""

import os

import duckdb
import pytest

from meterloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = c.execute(queries.ORACLES[name])
    names = [d[0] for d in got.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(names).collect()) == sorted(got.fetchall())


def test_shingles_of_the_sql(spark, tmp_path):
    """Null, empty and short texts, other letters, and white space that doesn't part words."""
    texts = [None, "", " \t", "one", "One", "a b", "A\x0bb", "a\u00a0b c d", "É f g h", "é f g h", "a b c a b c a b c", "x\x00y z w", "x\x00y Z w"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    want = {r[0]: r[1:] for r in c.execute("SELECT doc_id, n_shingles, component_id FROM (" + queries.OP1_SQL + ")").fetchall()}
    from meterloom.llm.ngram_jaccard import join_classes

    assert {r.doc_id: (r.n_shingles, r.component_id) for r in join_classes(docs, k=3, p=90, q=100).collect()} == want
