"""What a step has shuffled, and tables that nothing reads any more, don't stay on disk."""

import os
import time

import pyarrow.dataset as ds
from pyspark.sql import functions as F

from meterloom.llm.common import cut, freed, shared_root
from meterloom.llm.ngram_jaccard import join_classes


def shuffle_files(spark) -> int:
    return sum(f.getName().startswith("shuffle_") for f in list_of(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))


def list_of(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def test_the_last_jobs_shuffle_is_freed(spark):
    """One look of the driver's JVM left the last job's shuffle in place."""
    freed(spark.range(1))
    time.sleep(1)
    before = shuffle_files(spark)
    made = freed(cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()))
    time.sleep(1)
    assert shuffle_files(spark) <= before
    assert made.count() == 7


def test_the_join_leaves_no_texts_and_sketches(spark):
    """Texts, sketches and pairs stayed in the shared folder until the session's end."""
    root = shared_root(spark).removeprefix("file://").removeprefix("file:")
    there = set(os.listdir(root))
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*words[: 40 - i % 2], f"x{i // 4}"])) for i in range(12)], "doc_id long, text string")
    classes = join_classes(docs, k=3, p=60, q=100)
    made = [set(ds.dataset(os.path.join(root, d), format="parquet").schema.names) for d in set(os.listdir(root)) - there]
    assert made and not any(x & {"text", "s0", "sig", "pivot"} for x in made)
    assert sorted((r.doc_id, r.component_id) for r in classes.collect()) == [(i, 0) for i in range(12)]
