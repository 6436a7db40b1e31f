"""The queries of the corpus operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm.common import fold_of, table
from meterloom.llm.embedding_dedup import near_vectors
from meterloom.llm.html_template import extract_main
from meterloom.llm.imatch import fingerprints_with_next
from meterloom.llm.language_id import fit as fit_languages
from meterloom.llm.language_id import identify
from meterloom.llm.ngram_jaccard import join_classes
from meterloom.llm.piece_transducer import round_trip
from meterloom.llm.pitman_yor import score_texts
from meterloom.llm.poisson_mix import mix_sources
from meterloom.llm.quality_kn import quality
from meterloom.llm.toxicity import toxicity

#: A public byte-pair model with byte fallback.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(table(spark, sf_dir, "documents"), k=3, p=90, q=100)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_next(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs, folds=4, held=2)
    return identify(docs.drop("lang"), model=model).select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every whole text, and whether decoding gives the text back (marks of white space in
    the text itself come back as spaces, as the model has it)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = round_trip(docs, MODEL)
    same = F.col("decoded") == F.translate("text", "\u2581", " ")
    return both.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", same.alias("round_trip"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"), folds=5, held=0)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))


def op8_quality_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity under text labelled as of good quality, and whether the document is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality(docs, trusted).select("doc_id", "lang", "perplexity", "threshold", "keep")


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), folds=7, held=2)


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weight for every source, at the corpus's own size."""
    return mix_sources(table(spark, sf_dir, "documents"), weights=None, size=1.0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_imatch": op3_imatch,
    "op4_language_id": op4_language_id,
    "op5_piece_transducer": op5_piece_transducer,
    "op6_toxicity": op6_toxicity,
    "op7_html_template": op7_html_template,
    "op8_quality_kn": op8_quality_kn,
    "op9_pitman_yor": op9_pitman_yor,
    "op10_poisson_mix": op10_poisson_mix,
    "pipeline": pipeline,
}

#: Shingles as text, all pairs of documents that share one, and what they reach.
OP1_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) m USING (doc_id)"""

#: All pairs of vectors, and what they reach. The query has the same rows where hashing misses no pair (expected recall 0.995).
OP2_SQL = """WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, (SELECT min(b) FROM reach r WHERE r.a = e.vec_id) AS component_id, (SELECT min(b) FROM reach r WHERE r.a = e.vec_id) = e.vec_id AS kept FROM embeddings e"""

ORACLES: dict[str, str] = {"op1_ngram_jaccard": OP1_SQL, "op2_embedding_dedup": OP2_SQL}
