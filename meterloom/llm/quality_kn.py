"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

N-grams are of five UTF-8 bytes. Raw counts of the highest order and continuation counts of the
orders below come from all trusted documents but those kept for the thresholds, counted on the
cluster by key. Each order has the three
discounts of modified Kneser-Ney from its counts of counts; probabilities are interpolated down
to a uniform distribution over bytes.

The counts stay on the cluster in shards by the two bytes before the last one: the orders from
three to five of an n-gram, and of its contexts, share these, so a shard can tell probabilities
without the others. The two lowest orders, 65,536 probabilities whatever the sample, go along
with the tasks. Documents are packed into blocks of bounded size; each block's distinct n-grams
go to their shards, are joined there with the counts, and their log probabilities come back to
the block, which adds them up by document. A shard has more copies the more blocks there are,
each for some of the blocks, so a frequent pair of bytes has no task of its own.

A document is rejected when its perplexity is over its language's threshold: a quantile of that
language's trusted documents that the model hasn't seen, a fourth of all, times a slack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import U64, as_buffers, blocks, cut, drop_cut, freed, mix, schema_with, signed
from meterloom.llm.exchange import SCHEMA, batches_of, by_shard, each, expand, message, squeeze, stage

START = 0xFF  # never a byte of UTF-8
ORDER, SHARDS = 5, 64
STEPS = 1 << 10  # log probabilities travel in steps of 1/1024 of a bit; a mean of many is far closer
GRAMS, LOW, COUNTS_OF_COUNTS, ASK, ANSWER, PACKED = range(6)


def histories(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte the n-gram of `order` bytes that ends with it, as a number; START stands before a text."""
    out = data.astype(U64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order):
        before = np.full(len(data), START, U64)
        before[k:] = data[: len(data) - k]
        before[place < k] = START
        out |= before << U64(8 * k)
    return out.astype(np.int64)


def shard_of(gram: np.ndarray) -> np.ndarray:
    """The shard of n-grams by the two bytes before the last one."""
    return (mix((gram >> 8 & 0xFFFF).astype(U64)) % U64(SHARDS)).astype(np.int64)


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2, and 3 or more, from how many counts are 1, 2, 3 and 4 (n[1] to n[4])."""
    if not n[1] or not n[2]:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[1] / (n[1] + 2 * n[2])
    d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
    return np.array([0, *(float(np.clip(x, 0.05, i - 0.05)) for i, x in enumerate(d[1:], 1))])


def orders(grams: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(n-grams in order, counts) of the orders 5 to 3 and continuation counts of order 2, from distinct n-grams in order."""
    out = {ORDER: (grams, counts)}
    for k in range(ORDER - 1, 1, -1):
        # Continuation counts: in how many n-grams of the next order each is the end.
        key, at = np.unique(out[k + 1][0] & (1 << 8 * k) - 1, return_inverse=True)
        out[k] = key, np.bincount(at, minlength=len(key))
    return out


def gather(rows: list[tuple]) -> Iterator[tuple]:
    """A shard's n-grams and counts; its part of the counts of order 2, and its counts of counts."""
    shard, grams, n = rows[0][1], np.concatenate([expand(r[4]) for r in rows]), np.concatenate([expand(r[5]) for r in rows])
    key, at = np.unique(grams, return_inverse=True)
    found = orders(key, np.bincount(at, n, len(key)).astype(np.int64))
    yield message(GRAMS, shard, 0, squeeze(found[ORDER][0], True), squeeze(found[ORDER][1]))
    for gram, times in zip(*found[2]):
        yield message(LOW, int(gram), 0, n=int(times))
    for k in range(3, ORDER + 1):
        for i in range(1, 5):
            yield message(COUNTS_OF_COUNTS, k, i, n=int((found[k][1] == i).sum()))


class Low:
    """Probabilities of the two lowest orders, and the discounts of the others."""

    def __init__(self, pairs: dict[int, int], counts_of_counts: dict[int, list[int]]):
        two = np.zeros((256, 256))
        for gram, n in pairs.items():
            two[gram >> 8, gram & 0xFF] = n
        one = (two > 0).sum(axis=0)
        d, total = discounts([int((one == i).sum()) for i in range(5)])[np.minimum(one, 3)], max(one.sum(), 1)
        spare = d.sum() / total if one.any() else 1.0
        self.one = np.maximum(one - d, 0) / total + spare / 256
        d, total = discounts([int((two == i).sum()) for i in range(5)])[np.minimum(two, 3).astype(int)], two.sum(axis=1, keepdims=True)
        spare = np.where(total > 0, d.sum(axis=1, keepdims=True) / np.maximum(total, 1), 1.0)
        self.two = np.maximum(two - d, 0) / np.maximum(total, 1) + spare * self.one
        self.discounts = {k: discounts(n) for k, n in counts_of_counts.items()}


class High:
    """The orders from three on of one shard."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: Low):
        self.low, self.levels = low, []
        found = orders(grams, counts)
        for k in range(3, ORDER + 1):
            key, n = found[k]
            contexts, at = np.unique(key >> 8, return_inverse=True)
            d = low.discounts[k][np.minimum(n, 3)]
            total = np.bincount(at, n, len(contexts))
            self.levels.append((k, key, np.maximum(n - d, 0) / total[at], contexts, np.bincount(at, d, len(contexts)) / total))

    def log2(self, grams: np.ndarray) -> np.ndarray:
        """log2 of the probability of the last byte of each n-gram."""
        p = self.low.two[grams >> 8 & 0xFF, grams & 0xFF].copy()
        for k, keys, value, contexts, spare in self.levels:
            if not len(keys):
                continue
            gram = grams & (1 << 8 * k) - 1
            at = np.minimum(np.searchsorted(contexts, gram >> 8), len(contexts) - 1)
            p *= np.where(contexts[at] == gram >> 8, spare[at], 1.0)
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            p += np.where(keys[at] == gram, value[at], 0.0)
        return np.log2(p)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in blocks(batches, "text"):
        key, n = np.unique(histories(data, offsets), return_counts=True)
        yield pa.RecordBatch.from_arrays([signed(key), pa.array(n)], ["key", "n"])


def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, place in by_shard(shard_of(key), SHARDS):
            yield message(GRAMS, i, 0, squeeze(key[place]), squeeze(n[place]))


def rows_of(docs: DataFrame, ids: DataFrame, most: int = 1 << 20) -> DataFrame:
    """The rows of docs whose doc_id is one of ids. Up to `most` ids go along with the tasks, whatever Spark takes their
    size to be, so texts stay where they are; with more, both sides are shuffled if Spark's threshold says so."""
    few = ids.limit(most + 1).count() <= most
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def fit(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, Low]:
    """(counts by shard, the two lowest orders), from the texts of all of the trusted doc_ids."""
    rows = rows_of(docs.select("doc_id", "text"), trusted).select("text")
    counts = rows.mapInArrow(gram_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    made = freed(cut(stage([counts.mapInArrow(lambda x: batches_of(to_shards(x)), SCHEMA)], gather, SHARDS)))
    # At most 65,536 pairs of bytes, and twelve counts.
    small = made.where(F.col("kind") != GRAMS).groupBy("kind", "dst", "src").agg(F.sum("n").alias("n")).collect()
    of_counts = {k: [0] * 5 for k in range(3, ORDER + 1)}
    for r in small:
        if r.kind == COUNTS_OF_COUNTS:
            of_counts[r.dst][r.src] = r.n
    return made.where(F.col("kind") == GRAMS), Low({r.dst: r.n for r in small if r.kind == LOW}, of_counts)


def pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Blocks of about `size` bytes of text, with all columns. Rows keep their order in a block."""
    task, number = (TaskContext.get().partitionId() if TaskContext.get() else 0), 0
    for batch, data, _ in blocks(batches, "text", size):
        held = pa.BufferOutputStream()
        with pa.ipc.new_stream(held, batch.schema) as out:
            out.write_batch(batch)
        yield message(PACKED, (task << 24) + number, 0, zstandard.compress(held.getvalue(), 9), n=len(data))
        number += 1


def unpack(row: tuple) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(rows, distinct n-grams in order, place among them of each byte's)."""
    rows = pa.ipc.open_stream(zstandard.decompress(row[4])).read_all()
    grams, at = np.unique(histories(*as_buffers(rows.column("text"))), return_inverse=True)
    return rows, grams, at


def requests(row: tuple, copies: int) -> Iterator[tuple]:
    _, grams, _ = unpack(row)
    for i, place in by_shard(shard_of(grams), SHARDS):
        yield message(ASK, i * copies + row[1] % copies, row[1], squeeze(grams[place], True))


def answer(rows: list[tuple], low: Low, copies: int) -> Iterator[tuple]:
    """Log probabilities for each block that asked this copy of a shard; without counts, of the lower orders."""
    known = next((r for r in rows if r[0] == GRAMS), None)
    none = np.zeros(0, np.int64)
    model = High(*((expand(known[4], True), expand(known[5])) if known else (none, none)), low)
    for r in rows:
        if r[0] == ASK:
            yield message(ANSWER, r[2], r[1] // copies, squeeze(np.round(-STEPS * model.log2(expand(r[4], True)))))


def perplexities(rows: list[tuple]) -> pa.Table:
    """A block's rows but their text, with perplexity."""
    docs, grams, at = unpack(next(r for r in rows if r[0] == PACKED))
    answers, value = {r[2]: r for r in rows if r[0] == ANSWER}, np.zeros(len(grams))
    for i, place in by_shard(shard_of(grams), SHARDS):
        value[place] = expand(answers[i][4]) / -STEPS
    n = np.diff(as_buffers(docs.column("text"))[1])
    total = np.bincount(np.repeat(np.arange(len(n)), n), value[at], len(n))
    found = pa.array(2.0 ** (-total / np.maximum(n, 1)), mask=n == 0)
    return docs.drop_columns(["text"]).append_column("perplexity", found)


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, slack: float = 1.1, block: int = 4 << 20) -> DataFrame:
    """The rows of docs (doc_id, text, lang and others) but their text, with perplexity by byte, threshold and keep.

    Null and empty texts have no perplexity and aren't kept. A language's threshold is `slack` times
    the `quantile` of the perplexities of its trusted documents outside the model's; languages with
    fewer than 20 of these, and null, take that of all. Without any, nothing is rejected but empty
    texts. Rows that repeat are scored alike and come back as often; columns of docs with the names of
    the new ones are replaced."""
    trusted = trusted.select("doc_id").where("doc_id is not null").distinct()
    unseen = F.pmod(F.xxhash64("doc_id", F.lit(81)), F.lit(4)) == 0
    docs = docs.drop("perplexity", "threshold", "keep")
    counts, low = fit(docs, trusted.where(~unseen))
    packed = cut(docs.mapInArrow(lambda x: batches_of(pack(x, block)), SCHEMA))
    n_blocks = packed.count()
    copies = n_blocks // 64 + 1
    spread = counts.withColumn("dst", F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: F.col("dst") * copies + i)))
    asked = each(packed, lambda r: requests(r, copies))
    answered = stage([spread, asked], lambda rows: answer(rows, low, copies), SHARDS * copies)
    schema = schema_with(docs.drop("text"), ("perplexity", "double"))

    def run(group: pa.Table) -> pa.Table:
        return perplexities(list(zip(*(group.column(i).to_pylist() for i in range(group.num_columns)))))

    scored = cut(packed.unionByName(answered).repartition(max(n_blocks, min(2 * n_blocks, 64), 1), "dst").groupBy("dst").applyInArrow(run, schema))
    drop_cut(packed)
    good = scored.select("doc_id", "lang", "perplexity").join(trusted.where(unseen), "doc_id", "left_semi")
    at = F.percentile_approx("perplexity", quantile, 10_000).alias("t")
    found = good.groupBy("lang").agg(at, F.count("*").alias("n")).collect()  # a row for each language
    whole = good.agg(at).first()["t"]
    limit = F.lit(whole).cast("double") * slack
    for r in found:
        if r.lang is not None and r.t is not None and r.n >= 20:
            limit = F.when(F.col("lang") == r.lang, F.lit(r.t * slack)).otherwise(limit)
    out = scored.withColumn("threshold", limit)
    return out.withColumn("keep", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
