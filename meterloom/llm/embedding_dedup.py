"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, components.

Each table cuts the space by `bits` random hyperplanes; two vectors at the similarity threshold
agree in a bit with probability 1 - angle/pi, and there are as many tables as it takes for such
a pair to meet in one of them with probability `recall` (closer pairs meet more surely). Bits
grow with the number of distinct vectors, so buckets keep their expected size.

Equal vectors are one node with a weight. Buckets of more than `block` nodes are dealt into
blocks by hash, and every pair of blocks is one matrix product of bounded size, so a hot bucket
is spread and nothing is dropped. A pair counts in the first table where it meets. Blocks give
sums of links and a spanning forest of their links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import U64, cut, mix, signed
from meterloom.llm.components import components

_planes: dict[tuple, np.ndarray] = {}


def table_shape(n: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """(bits, tables) for n distinct vectors."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / bucket)) if n > bucket else 8)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def codes(v: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Bucket of each row of v in each table."""
    key = (v.shape[1], bits, tables, seed)
    if key not in _planes:
        _planes.clear()
        _planes[key] = np.random.default_rng(seed).standard_normal((v.shape[1], bits * tables))
    side = (v @ _planes[key] > 0).reshape(len(v), tables, bits)
    return side @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, node, dim, v): node is the hash of the vector's values, null where it has no direction."""
    for batch in batches:
        ids, arr = batch.column(0), batch.column(1)
        n = batch.num_rows
        node, dim, raw = np.zeros(n, U64), np.zeros(n, np.int32), [None] * n
        offsets, flat = arr.offsets.to_numpy(), arr.values
        hole = flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        valid = arr.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.where(valid, offsets[1:] - offsets[:-1], 0)
        for d in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == d)
            at = offsets[:-1][rows][:, None] + np.arange(d)
            v = values[at] + 0.0
            good = np.isfinite(v).all(axis=1) & ~hole[at].any(axis=1) & (v != 0).any(axis=1)
            rows, v = rows[good], np.ascontiguousarray(v[good])
            salt = mix(np.arange(1, d + 1, dtype=U64))
            node[rows] = mix(mix(v.view(U64) ^ salt).sum(axis=1, dtype=U64) + U64(d))
            dim[rows] = d
            for r, x in zip(rows, v):
                raw[r] = x.tobytes()
        yield pa.RecordBatch.from_arrays([ids, pa.array(node.view(np.int64), mask=dim == 0), pa.array(dim), pa.array(raw, pa.binary())], ["vec_id", "node", "dim", "v"])


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def entries(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                rows = batch.filter(pa.array(dims == d))
                c = codes(unit(matrix(rows.column(3), int(d))), bits, tables, seed)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), t, np.int32)), pa.array(c[:, t]), *rows.columns], ["t", "key", "node", "w", "dim", "v"])


def meet(key: tuple, rows: pa.Table, bits: int, tables: int, seed: int, threshold: float) -> pa.Table:
    """(node, partner, links) of the links that a pair of blocks finds first in table t."""
    rows = rows.combine_chunks()
    t, d, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py(), key[4].as_py()
    node, w, part = (rows.column(x).to_numpy() for x in ("node", "w", "part"))
    raw = matrix(rows.column("v").chunk(0) if rows.num_rows else pa.array([], pa.binary()), d)
    v = unit(raw)
    n = len(v)
    links, label = np.zeros(n, np.int64), np.arange(n)
    a = np.flatnonzero(part == 0)
    b = a if i == j else np.flatnonzero(part == 1)
    if n > 1 and len(a) and len(b):
        s = v[a] @ v[b].T
        x, y = np.nonzero(s >= threshold - 1e-9)
        if i == j:
            x, y = x[x < y], y[x < y]
        edge = np.flatnonzero(np.abs(s[x, y] - threshold) < 1e-9)
        drop = np.zeros(len(x), bool)
        if len(edge):
            p, q = raw[a[x[edge]]], raw[b[y[edge]]]
            drop[edge] = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1))) < threshold
        if t:
            c = codes(v, bits, tables, seed)[:, :t]
            for lo in range(0, len(x), 1 << 17):
                drop[lo : lo + (1 << 17)] |= (c[a[x[lo : lo + (1 << 17)]]] == c[b[y[lo : lo + (1 << 17)]]]).any(axis=1)
        x, y = a[x[~drop]], b[y[~drop]]
        links += np.bincount(x, w[y], n).astype(np.int64) + np.bincount(y, w[x], n).astype(np.int64)
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    on = links > 0
    return pa.table({"node": node[on], "partner": node[label[on]], "links": links[on]})


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.995, bucket: int = 256, block: int = 1024, seed: int = 11) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite values link with nothing, and
    vectors of different length are not compared. A null vec_id keeps its row and isn't kept;
    repeated rows are separate vectors that link with each other. Other columns aren't read."""
    rows = cut(vectors.select("vec_id", "embedding").mapInArrow(nodes_of, "vec_id long, node long, dim int, v binary"))
    nodes = cut(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("w"), F.first("dim").alias("dim"), F.first("v").alias("v"), F.min("vec_id").alias("least_id")))
    bits, tables = table_shape(nodes.count(), threshold, recall, bucket)
    dealt = nodes.select("node", "w", "dim", "v").mapInArrow(lambda x: entries(x, bits, tables, seed), "t int, key long, node long, w long, dim int, v binary")
    keys = nodes.select("node", "w", "dim", "v").mapInArrow(lambda x: (y.select([0, 1, 4]) for y in entries(x, bits, tables, seed)), "t int, key long, dim int")
    sizes = cut(keys.groupBy("t", "key", "dim").agg(F.count("*").alias("c")).where("c > 1"))
    big = sizes.where(F.col("c") > block).withColumn("parts", F.ceil(F.col("c") / block).cast("int")).drop("c")
    dealt = dealt.join(big, ["t", "key", "dim"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("node", "t"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("t", "key", "dim", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("part"), "node", "w", "v")
    found = cut(dealt.groupBy("t", "key", "dim", "i", "j").applyInArrow(lambda key, x: meet(key, x, bits, tables, seed, threshold), "node long, partner long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found, "node", "partner")
    graph = nodes.select("node", "w", "least_id").join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = graph.groupBy("component").agg(F.min("least_id").alias("component_id"))
    graph = graph.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(cut(graph), "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
