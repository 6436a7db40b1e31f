"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and grams is trained with NumPy from confirmed toxic
documents and unlabelled text. With class prior pi the risk is
pi R_P(+) + max(0, R_U(-) - pi R_P(-)) under the logistic loss; where the second term turns
negative, the step goes against it, as in non-negative risk estimation. An L1 proximal step
keeps words that tell nothing at weight 0. Words are those whose presence tells positives from
unlabelled text best, named by their 64-bit hashes.

The samples for the fit are bounded by documented parameters: `positives` confirmed toxic
documents and `unlabelled` documents, those with the smallest hashes of their doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import NOT_LETTERS, U64, blocks, cut, fold_of, mix, schema_with, signed, words

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, place) of each run of four bytes inside a word, as a 32-bit number."""
    n = len(data)
    if n < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    inside = ~NOT_LETTERS[data]
    joined = inside[1:] & inside[:-1]
    joined[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)] - 1] = False
    at = np.flatnonzero(joined[:-2] & joined[1:-1] & joined[2:])
    b = _LOW[data].astype(np.uint32)
    return b[at] | b[at + 1] << np.uint32(8) | b[at + 2] << np.uint32(16) | b[at + 3] << np.uint32(24), at


def gram_key(gram: np.ndarray) -> np.ndarray:
    return mix(gram.astype(U64) + U64(0x6A09E667F3BCC909))


def present(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of the distinct words and four-byte grams of each document."""
    w = words(data, offsets, gap=NOT_LETTERS)
    gram, at = grams(data, offsets)
    pair = np.unique(((np.searchsorted(offsets, at, "right") - 1).astype(U64) << U64(32)) | gram)
    h = np.concatenate([w.hash, gram_key(pair & U64(0xFFFFFFFF))])
    d = np.concatenate([w.doc, (pair >> U64(32)).astype(np.int64)])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, p, u): in how many positive and unlabelled documents each word occurs. Input: text, positive."""
    for batch, data, offsets in blocks(batches, "text"):
        h, d = present(data, offsets)
        side = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[d]
        key, at = np.unique(h, return_inverse=True)
        yield pa.RecordBatch.from_arrays([signed(key), pa.array(np.bincount(at, side, len(key)).astype(np.int64)), pa.array(np.bincount(at, ~side, len(key)).astype(np.int64))], ["h", "p", "u"])


def chosen_words(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(positive, features) with the places in keys of the words that each document has."""
    for batch, data, offsets in blocks(batches, "text"):
        h, d = present(data, offsets)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        on = keys[at] == h
        ends = np.cumsum(np.bincount(d[on], minlength=batch.num_rows))
        features = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(at[on].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(1), features], ["positive", "features"])


def nn_pu(doc: np.ndarray, feature: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the non-negative PU risk; document doc[i] has feature[i], each once."""
    n = len(positive)
    l1 = float(np.clip(0.006 / np.sqrt(max(1, positive.sum())), 2e-4, 3e-3))  # fewer examples, fewer words
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[feature], n) + b
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        minus = np.logaddexp(0, z)
        negative = minus[~positive].sum() / n_u - prior * minus[positive].sum() / n_p
        g = np.where(positive, -prior * s / n_p, s / n_u)  # of R_U(-) - pi R_P(-)
        g = np.where(positive, prior * (s - 1) / n_p, 0) + g if negative >= 0 else -g
        gw, gb = np.bincount(feature, g[doc], n_features), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w = w - step * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, positives: int = 6000, unlabelled: int = 12000, features: int = 2048) -> tuple[np.ndarray, np.ndarray, float]:
    """(word hashes, weights, bias). Labels come from rows outside the held-out fold only; without
    any toxic label every text scores the prior."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of("doc_id", folds) != held))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    prior = float(np.clip((toxic or 0) / n if n else 0.05, 0.005, 0.5))
    order = F.xxhash64("doc_id", F.lit(5))
    p = known.where("toxic = 1").select("doc_id", F.lit(True).alias("positive")).orderBy(order, "doc_id").limit(positives)
    u = docs.where("doc_id is not null").select("doc_id", F.lit(False).alias("positive")).orderBy(order, "doc_id").limit(unlabelled)
    # At most positives + unlabelled rows.
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(p.union(u)), "doc_id").select("text", "positive"))
    counts = sample.mapInArrow(word_counts, "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    n_p, n_u = sample.where("positive").count(), sample.where("not positive").count()
    rate_p, rate_u = F.col("p") / max(n_p, 1), F.col("u") / max(n_u, 1)
    tells = F.col("p") * F.log((rate_p + 1e-9) / (rate_u + 0.25 / max(n_u, 1)))
    best = counts.where("p >= 3").select("h", tells.alias("tells")).where("tells > 8").orderBy(F.desc("tells"), "h").limit(features).collect()
    keys = np.sort(np.array([r.h for r in best], np.int64).view(U64))
    if not len(keys):
        return np.zeros(0, U64), np.zeros(0), float(np.log(prior / (1 - prior)))
    got = sample.mapInArrow(lambda x: chosen_words(x, keys), "positive boolean, features array<int>").toArrow()
    lists = got.column("features").combine_chunks()
    doc = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    w, b = nn_pu(doc, lists.flatten().to_numpy(), got.column("positive").to_numpy().astype(bool), len(keys), prior)
    return keys[w != 0], w[w != 0], b


def score(batches: Iterator[pa.RecordBatch], keys: np.ndarray, weights: np.ndarray, bias: float, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """known: the grams among the keys, for a first look-up by a small hash."""
    maybe = np.zeros(1 << 20, bool)
    maybe[(known * np.uint32(2654435761)) >> np.uint32(12)] = True
    for batch, data, offsets in blocks(batches, "text"):
        n, z = batch.num_rows, np.full(batch.num_rows, bias)
        if len(keys):
            w = words(data, offsets, gap=NOT_LETTERS)
            gram, at = grams(data, offsets)
            on = maybe[(gram * np.uint32(2654435761)) >> np.uint32(12)]
            at, h = at[on], np.concatenate([w.hash, gram_key(gram[on])])
            doc = np.concatenate([w.doc, np.searchsorted(offsets, at, "right") - 1])
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            on = keys[place] == h
            pair = np.unique(doc[on] * len(keys) + place[on])
            z += np.bincount(pair // len(keys), weights[pair % len(keys)], n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*batch.schema.names, "score"])


def grams_among(keys: np.ndarray) -> np.ndarray:
    """The grams whose keys are among `keys`, by inverting the mixing step."""
    inverse1, inverse2 = (U64(pow(x, -1, 1 << 64)) for x in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9))

    def unshift(x: np.ndarray, k: int) -> np.ndarray:
        y = x
        for _ in range(64 // k):
            y = x ^ (y >> U64(k))
        return y

    x = unshift(unshift(unshift(keys, 31) * inverse1, 27) * inverse2, 30) - U64(0x6A09E667F3BCC909)
    return x[x < U64(1 << 32)].astype(np.uint32)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **fit_options) -> DataFrame:
    """docs (doc_id, text and any other columns) with `score`, from 0 to 1, higher where toxicity is likelier.

    Null, empty and wordless texts score the class prior as the model has it. Repeated rows score
    alike. A column named score in docs is replaced."""
    keys, weights, bias = fit(docs, labels, folds, held, **fit_options)
    docs = docs.drop("score")
    known = grams_among(keys)
    return docs.mapInArrow(lambda x: score(x, keys, weights, bias, known), schema_with(docs, ("score", "double")))
