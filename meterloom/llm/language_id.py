"""Language identification of mixed text: script ranges, per-word scores, and Viterbi over words.

Letters' lead bytes give a word's script, which leaves the languages that use it. A word scores
for each of those the sum of log-probabilities of its byte trigrams (with the word's ends),
less that of the best language, floored. Viterbi over a document's words adds a penalty for
each switch of language and labels spans. All documents of a block go through Viterbi in step,
so NumPy works on a column of documents at a time.

The model is learned from a bounded sample of labelled documents: `sample` rows, those with the
smallest hashes of their doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import NOT_LETTERS, Words, blocks, fold_of, schema_with, words

SLOTS = 1 << 16
UNKNOWN = "und"
#: First lead byte of each script's range in UTF-8, in order (fixed values of Unicode's blocks).
SCRIPTS = [(0x00, "latin"), (0xCD, "greek"), (0xD0, "cyrillic"), (0xD4, "armenian"), (0xD6, "hebrew"), (0xD8, "arabic"), (0xE0, "indic"), (0xE1, "other"), (0xE2, "symbols"), (0xE3, "kana"), (0xE4, "han"), (0xEA, "hangul"), (0xEE, "private"), (0xEF, "wide"), (0xF0, "astral")]
_SCRIPT = np.searchsorted([b for b, _ in SCRIPTS], np.arange(256), "right") - 1
_LOW = np.arange(256, dtype=np.int64)
_LOW[65:91] += 32


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (slot, language): log-probability
    allowed: np.ndarray  # (script, language)


def slots(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) of every byte trigram of each word, whose ends count as a byte each."""
    n = w.end - w.start
    word = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.start, n)
    b = _LOW[data]
    here = b[at]
    before = np.where(at > w.start[word], b[np.maximum(at - 1, 0)], 1)
    after = np.where(at + 1 < w.end[word], b[np.minimum(at + 1, len(b) - 1)], 2)
    key = (before << 16) | (here << 8) | after
    return ((key * 0x9E3779B1) >> 13) & (SLOTS - 1), word


def script_of(data: np.ndarray, w: Words) -> np.ndarray:
    """Script of each word: that of its first byte outside ASCII if that's not Latin, else of its first byte."""
    lead = _SCRIPT[data]
    lead = np.where((data >= 0x80) & (data < 0xC0), 0, lead)  # bytes inside a character
    total = np.maximum.reduceat(lead, w.start) if len(w.start) else np.zeros(0, np.int64)
    return total


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, slot, n): trigram counts (kind 0) and words by script (kind 1). Input: text, lang."""
    for batch, data, offsets in blocks(batches, "text"):
        w = words(data, offsets, gap=NOT_LETTERS)
        langs, which = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
        slot, word = slots(data, w)
        lang = which[w.doc]
        for kind, key, size in ((0, lang[word] * SLOTS + slot, SLOTS), (1, lang * len(SCRIPTS) + script_of(data, w), len(SCRIPTS))):
            n = np.bincount(key, minlength=1)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(langs[some // size].astype(object), pa.string()), pa.array(np.full(len(some), kind, np.int32)), pa.array((some % size).astype(np.int32)), pa.array(n[some])], ["lang", "kind", "slot", "n"])


def fit(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = 20000) -> Model:
    """Learn from text and non-null lang of documents outside the held-out fold."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held))
    chosen = train.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample).distinct()
    # At most `sample` ids.
    rows = train.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").select("text", "lang")
    got = rows.mapInArrow(counts, "lang string, kind int, slot int, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table, scripts = np.zeros((SLOTS, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    column = got["lang"].map(place).to_numpy(np.int64) if len(got) else np.zeros(0, np.int64)
    grams = (got["kind"] == 0).to_numpy(bool)
    table[got["slot"].to_numpy(np.int64)[grams], column[grams]] = got["n"].to_numpy()[grams]
    scripts[got["slot"].to_numpy(np.int64)[~grams], column[~grams]] = got["n"].to_numpy()[~grams]
    log = np.log((table + 0.2) / (table.sum(0) + 0.2 * SLOTS)) if langs else table
    return Model(langs, log.astype(np.float32), scripts >= 0.02 * scripts.sum(0) if langs else scripts > 0)


def word_scores(data: np.ndarray, w: Words, model: Model, floor: float = -12.0) -> np.ndarray:
    """(word, language): log-probability less that of the best language, at least `floor`."""
    out = np.zeros((len(w.start), len(model.langs)), np.float32)
    if not len(w.start):
        return out
    ends = np.cumsum(w.end - w.start)
    at = 0
    while at < len(w.start):  # windows of bounded size
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18), "right")))
        part = Words(w.hash[at:to], w.doc[at:to], w.start[at:to], w.end[at:to], w.n_docs)
        slot, word = slots(data[part.start[0] : part.end[-1]], Words(part.hash, part.doc, part.start - part.start[0], part.end - part.start[0], w.n_docs))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[at:to] = np.add.reduceat(model.table[slot], first, axis=0)
        at = to
    can = model.allowed[script_of(data, w)]
    can |= ~can.any(axis=1, keepdims=True)
    out[~can] = -np.inf
    return np.maximum(out - out.max(axis=1, keepdims=True), np.where(can, floor, 2 * floor)).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Language of each word. lengths: words of each document, whose words follow one another."""
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    n, k = scores.shape
    own = np.arange(k, dtype=np.min_scalar_type(max(k - 1, 0)))
    back = np.zeros((n, k), own.dtype)
    v = np.zeros((len(size), k), np.float32)
    final = np.zeros(len(size), np.int64)
    for t in range(longest):
        a = active[t]
        x = v[:a]
        best = x.argmax(axis=1)
        jump = x[np.arange(a), best] - penalty
        take = jump[:, None] > x
        at = first[:a] + t
        back[at] = np.where(take, best[:, None], own)
        v[:a] = np.where(take, jump[:, None], x) + scores[at]
    final = v.argmax(axis=1)
    label = np.zeros(n, np.int64)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        label[at] = final[:a]
        final[:a] = back[at, final[:a]]
    return label


def predict(batches: Iterator[pa.RecordBatch], model: Model, penalty: float, spans: bool) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in blocks(batches, "text", 1 << 21):
        n, k = batch.num_rows, len(model.langs)
        w = words(data, offsets, gap=NOT_LETTERS)
        letters = np.bincount(w.doc, minlength=n) > 0
        ascii_letter = np.zeros(n, bool)
        low = _LOW[data]
        where = np.flatnonzero((low >= 97) & (low <= 122))
        ascii_letter[np.searchsorted(offsets, where, "right") - 1] = True
        for i in np.flatnonzero(letters & ~ascii_letter):  # few: without a letter of ASCII
            letters[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
        share, pred = np.zeros(n), np.full(n, UNKNOWN, object)
        label = np.zeros(len(w.start), np.int64)
        if k:
            label = viterbi(word_scores(data, w, model), w.counts(), penalty)
            amount = np.bincount(w.doc * k + label, (w.end - w.start).astype(float), n * k).reshape(n, k)
            total = amount.sum(axis=1)
            best = amount.argmax(axis=1)
            share = np.where(letters, amount[np.arange(n), best] / np.maximum(total, 1), 0.0)
            pred = np.where(letters, np.array(model.langs, object)[best], UNKNOWN)
        out = [*batch.columns, pa.array(pred, pa.string()), pa.array(share)]
        if spans:
            out.append(span_lists(data, offsets, w, label, letters, model.langs))
        yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, "lang_pred", "score", *["spans"] * spans])


def span_lists(data, offsets, w: Words, label, letters, langs: list[str]) -> pa.Array:
    """For each document its spans in order: language, first byte, byte after the last."""
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(label)]])[: len(at)] - 1
    at, last = at[letters[w.doc[at]]], last[letters[w.doc[at]]]
    doc = w.doc[at]
    ends = np.cumsum(np.bincount(doc, minlength=w.n_docs))
    fields = [pa.array(np.array(langs, object)[label[at]] if langs else [], pa.string()), pa.array(w.start[at] - offsets[doc]), pa.array(w.end[last] - offsets[doc])]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.StructArray.from_arrays(fields, ["lang", "start", "end"]))


def identify(docs: DataFrame, penalty: float = 12.0, folds: int = 4, held: int = 2, spans: bool = False, model: Model | None = None, **fit_options) -> DataFrame:
    """docs with lang_pred (a learned language, or `und` for null texts and texts without a letter) and
    score, the share of the text's letters in spans of that language (0 for `und`).

    With spans=True also `spans`, an array of (lang, start, end) in bytes of UTF-8. Without any
    labelled text everything is `und`. Rows that repeat are labelled alike, an empty table gives
    no rows. Columns of docs with these names are replaced."""
    model = model or fit(docs, folds, held, **fit_options)
    docs = docs.drop("lang_pred", "score", *["spans"] * spans)
    more = [("spans", "array<struct<lang:string,start:bigint,end:bigint>>")] * spans
    return docs.mapInArrow(lambda x: predict(x, model, penalty, spans), schema_with(docs, ("lang_pred", "string"), ("score", "double"), *more))
