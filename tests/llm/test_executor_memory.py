"""What earlier steps took of an executor's memory isn't kept beside what the next stage takes."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys, time, psutil
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline

spark = SparkSession.builder.master("local-cluster[2,1,1200]").config("spark.executor.memory", "1200m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def resident():
    own = [p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
    return sorted(p.memory_info().rss >> 20 for p in own)

docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
docs = corpus_pipeline.cut(docs)
corpus_pipeline.STAGES[3][1](spark, docs, "").collect()  # classes are loaded
grown = spark.range(0, 6_000_000, 1, 2).groupBy(F.col("id") % 2).agg(F.max(F.size(F.array_distinct(F.array(F.lit(1))))), F.size(F.collect_list(F.col("id"))))
grown.collect()
before = resident()
corpus_pipeline.STAGES[3][1](spark, docs, "").collect()
time.sleep(1)
print("MEMORY", *before, *resident(), flush=True)
spark.stop()
"""


@pytest.mark.skipif(not os.path.isdir("/proc"), reason="reads /proc")
def test_stage_begins_with_small_heaps(tmp_path):
    pytest.importorskip("psutil")
    pytest.importorskip("corpus_pipeline")
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"PYTHONPATH": str(HERE), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    said = subprocess.run([sys.executable, "-c", SCRIPT, f"file://{tmp_path}/shared"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "MEMORY" in said.stdout, said.stderr[-3000:]
    a, b, c, d = map(int, said.stdout.rpartition("MEMORY")[2].split())
    assert c + d < 0.8 * (a + b), (a, b, c, d)


def test_workers_give_back(spark):
    """An array under glibc's moving threshold stays in the process when freed, until it is given back."""
    from meterloom.llm.common import blocks

    def rest(batches):
        import numpy as np
        import pyarrow as pa

        def mb():
            return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20

        for b in batches:
            for _ in blocks(iter([b]), "text"):
                some = [np.ones(12_000) for _ in range(2000)]  # 190 MB of small arrays, and one that stays behind them
                last = np.ones(12_000)
                del some
                held = mb()
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([mb()])], ["held", "rest"])
            del last

    r = spark.createDataFrame([("a b c",)], "text string").coalesce(1).mapInArrow(rest, "held long, rest long").first()
    assert r.held - r.rest > 100, r
