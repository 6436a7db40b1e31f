"""A corpus from raw documents: filtered, deduplicated, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm.common import cut, relieved, table
from meterloom.llm.language_id import UNKNOWN, identify
from meterloom.llm.ngram_jaccard import join_classes
from meterloom.llm.piece_transducer import encode
from meterloom.llm.poisson_mix import mix_sources
from meterloom.llm.toxicity import toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts score the class prior; repeated rows go or stay alike."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where("score < 0.5").select(docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language (no letters, or no text) go; so do all where no text has a known language."""
    return identify(docs).where(F.col("lang_pred") != UNKNOWN).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest doc_id, then hash of its text; a null doc_id comes last.

    Texts without words are near copies of nothing; of those with the same doc_id and text one row stays."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        kept = join_classes(docs, k=5, p=80, q=100).where("doc_id = component_id").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    # Ids don't tell rows apart: the join is by row.
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    classes = join_classes(rows.select(F.col("_row").alias("doc_id"), "text"), k=5, p=80, q=100).withColumnRenamed("doc_id", "_row")
    named = rows.select("_row", "doc_id", F.xxhash64("text").alias("_hash")).join(classes, "_row")
    copies, alone = F.col("n_shingles") > 0, (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = F.struct(F.when(copies, F.col("component_id")).when(~alone, F.col("_row")), F.when(alone, F.col("doc_id")), F.when(alone, F.col("_hash")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_hash", "_row"))
    kept = named.groupBy(group.alias("g")).agg(first.alias("first")).select("first._row")
    return rows.join(kept, "_row", "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of a corpus of the same size. Null sources are one source; rows alike in doc_id and text get equal counts."""
    return mix_sources(docs, weights=None, size=1.0).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of each text's pieces, none for null and empty texts; one row a row."""
    return encode(docs, MODEL).select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


def _fresh(stage: Stage) -> Stage:
    """stage, begun with executors' heaps free of what earlier stages have left."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        relieved(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _fresh(drop_toxic)),
    ("language", _fresh(keep_languages)),
    ("near_copies", _fresh(drop_near_copies)),
    ("mix", _fresh(mix)),
    ("encode", _fresh(encode_pieces)),
]

#: Classifiers, the similarity join and the encoding aren't SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
