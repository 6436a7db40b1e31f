"""Modified Kneser-Ney by shards against plain dictionaries over one text at a time."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from meterloom.llm import quality_kn as op


def plain(texts):
    """A function from (context of four bytes, byte) to its probability."""
    grams = {5: Counter()}
    for t in texts:
        b = bytes([op.START] * 4) + t.encode()
        grams[5].update(b[i : i + 5] for i in range(len(b) - 4))
    for k in range(4, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d, total, kinds = {}, {}, {}
    for k, c in grams.items():
        d[k] = op.discounts([sum(n == i for n in c.values()) for i in range(5)])
        total[k], kinds[k] = Counter(), defaultdict(float)
        for g, n in c.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += d[k][min(n, 3)]

    def p(context, byte):
        value = 1 / 256
        for k in range(1, 6):
            h = context[len(context) - k + 1 :] if k > 1 else b""
            if total[k][h]:
                n = grams[k][h + byte]
                value = max(n - d[k][min(n, 3)], 0) / total[k][h] + kinds[k][h] / total[k][h] * value
        return value

    return p


def test_perplexities_against_plain_counts(spark):
    rng = random.Random(5)
    words = ["water", "stöne", "light", "river", "house", "ab", "zq"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(60)] + ["", "Zebra qqq ü", "x"]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, threshold int")
    trusted = spark.range(50).withColumnRenamed("id", "doc_id")
    seen = {r.doc_id for r in trusted.where("pmod(xxhash64(doc_id, 81), 4) <> 0").collect()}
    p = plain([t for i, t in enumerate(texts) if i in seen])
    for block in (4 << 20, 64):
        out = {r.doc_id: r for r in op.quality(docs, trusted, block=block).collect()}
        assert len(out) == len(texts) and "text" not in out[0] and out[60].perplexity is None and not out[60].keep
        for i, t in enumerate(texts):
            b = bytes([op.START] * 4) + t.encode()
            if t:
                want = 2 ** (-sum(math.log2(p(b[k : k + 4], b[k + 4 : k + 5])) for k in range(len(b) - 4)) / (len(b) - 4))
                assert out[i].perplexity == pytest.approx(want, rel=4e-4)


def test_probabilities_sum_to_one():
    data, offsets = op.as_buffers(op.pa.array(["abracadabra", "abc", "cab cab"]))
    grams, n = np.unique(op.histories(data, offsets), return_counts=True)
    found = op.orders(grams, n)
    low = op.Low(dict(zip(found[2][0].tolist(), found[2][1].tolist())), {k: [0, *(int((found[k][1] == i).sum()) for i in range(1, 5))] for k in (3, 4, 5)})
    model = op.High(grams, n, low)
    for context in (b"abra", b"zzzz", b"\xff\xff\xff\xff", b"c ca"):
        asked = np.arange(256) + (int.from_bytes(context, "big") << 8)
        assert (2.0 ** model.log2(asked)).sum() == pytest.approx(1.0)


def test_repeated_null_and_long_rows(spark):
    long = "river light " * 50_000
    rows = [(1, "water", "en"), (1, "water", "en"), (None, "water", None), (2, None, "en"), (3, long, "fr")]
    out = op.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(1,), (7,), (None,)], "doc_id long")).collect()
    by = {(r.doc_id, r.perplexity) for r in out}
    assert len(out) == 5 and len(by) == 4 and [r.keep for r in out if r.doc_id == 2] == [False]
    assert op.quality(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.range(1).withColumnRenamed("id", "doc_id")).count() == 0
