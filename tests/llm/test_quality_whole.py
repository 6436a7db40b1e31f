"""The quality model learns from every trusted document that isn't kept for the thresholds."""

import inspect

from pyspark.sql import functions as F

from meterloom.llm import quality_kn
from meterloom.llm.exchange import expand


def test_all_trusted_texts_are_counted(spark):
    """More trusted documents than the 4,000 that were counted at most."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("abcdefgh").alias("text"))
    counts, _ = quality_kn.fit(docs, docs.select("doc_id"))
    assert sum(int(expand(r.b).sum()) for r in counts.collect()) == 5000 * 8
    assert "sample" not in inspect.signature(quality_kn.quality).parameters


def test_texts_stay_where_they_are_when_trusted_ids_are_few(spark):
    """The texts of all documents were shuffled to find the trusted ones once their ids were over Spark's threshold."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("abcdefgh").alias("text"))
    ids = docs.select("doc_id").where("doc_id % 3 = 0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, shuffled in ((1 << 20, False), (100, False), (99, True)):
            found = quality_kn.rows_of(docs, ids, most)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert ("SortMergeJoin" in plan) == shuffled and ("BroadcastHashJoin" in plan) != shuffled
            assert sorted(r.doc_id for r in found.collect()) == list(range(0, 300, 3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
