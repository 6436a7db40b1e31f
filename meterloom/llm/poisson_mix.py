"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the mixed corpus over its own share of the
input. Each document's count inverts the Poisson distribution with that mean at a uniform
number hashed from seed, doc_id, text and copy, so counts don't depend on partitions or
reruns. Copies are dealt out by a hash of seed, document and copy number and sorted by it
within partitions, which orders the whole table at random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 16.0


def uniform(*columns: Column) -> Column:
    """In (0, 1), from 52 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 12).cast("double") + 0.5) / float(1 << 52)


def poisson_inverse(rate: Column, u: Column, steps: int) -> Column:
    """The least k with P(Poisson(rate) <= k) > u, for rates up to CHUNK; k ends at `steps`."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.when(s["cdf"] > u, s).otherwise(F.struct((s["k"] + 1).alias("k"), p.alias("p"), (s["cdf"] + p).alias("cdf")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None, size: float) -> DataFrame:
    """(source, rate): target rows over actual rows of each source.

    `weights` holds sources' target weights (others 0); None asks for equal weights. The mixed
    corpus has about `size` times the rows of docs."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    counts = counts.withColumn("weight", F.lit(1.0)) if weights is None else counts.withColumn("weight", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce("source", F.lit(""))), F.lit(0.0)) if weights else F.lit(0.0))
    rows, total = counts.agg(F.sum("n"), F.sum("weight")).first()
    scale = float(rows or 0) * size / total if total else 0.0
    return counts.select(F.col("source").alias("mix_source"), (F.lit(scale) * F.col("weight") / F.col("n")).alias("mix_rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = 7) -> DataFrame:
    """docs with each row repeated a Poisson number of times, and `copy` (0, 1, ...), shuffled globally.

    Null sources are a source of their own (weight key "" in `weights`). Rows alike in doc_id and
    text get equal counts. An empty table gives none. All columns are kept; `copy` is replaced if
    docs has it."""
    rate = rates(docs, weights, size)
    # Spark broadcasts the rates when their measured size is small, and else splits the rows of hot sources.
    joined = docs.join(rate, F.col("source").eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    # A Poisson variable of a large mean is a sum of variables of means up to CHUNK.
    parts = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / CHUNK)).cast("int")
    steps = int(CHUNK + 12 * math.sqrt(CHUNK) + 20)
    count = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + poisson_inverse(F.col("mix_rate") / parts, uniform(F.lit(seed), F.col("doc_id"), F.xxhash64("text"), i), steps))
    copies = joined.withColumn("mix_count", count).where("mix_count > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("mix_count") - 1)))
    dealt = copies.withColumn("mix_order", F.xxhash64(F.lit(seed + 1), "doc_id", F.xxhash64("text"), "copy")).drop("mix_rate", "mix_count")
    return dealt.repartition("mix_order").sortWithinPartitions("mix_order").drop("mix_order")
