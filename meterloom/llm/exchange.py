"""Messages between shards: rows of (kind, dst, src, n, a to f) whose binary columns hold arrays.

A stage gives each dst all its messages and makes new ones. Arrays of integers are written in as few
bytes as the largest needs, sorted ones as differences, so a message takes a fraction of what rows
of its entries would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

COLUMNS = "abcdef"
SCHEMA = "kind int, dst long, src long, n long, " + ", ".join(f"{c} binary" for c in COLUMNS)
ARROW = pa.schema([("kind", pa.int32()), ("dst", pa.int64()), ("src", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in COLUMNS)])


def squeeze(x: np.ndarray, ordered: bool = False) -> bytes:
    """Integers from -1 on; ordered ones ascend."""
    x = np.asarray(x, np.int64) + 1
    if ordered:
        x = np.diff(x, prepend=0)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 3)


def expand(data: bytes, ordered: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    x = np.zeros((planes.shape[1], 8), np.uint8)
    x[:, : data[0]] = planes.T
    x = x.view("<i8").ravel()
    return (np.cumsum(x) if ordered else x) - 1


def message(kind: int, dst: int, src: int, *blobs: bytes, n: int = 0) -> tuple:
    return (kind, dst, src, n, *blobs, *[None] * (len(COLUMNS) - len(blobs)))


def table_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(ARROW)], schema=ARROW)


def batches_of(rows: Iterator[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r[4:] if x)
        if size >= most:
            yield from table_of(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from table_of(held).combine_chunks().to_batches()


def stage(messages: list[DataFrame], work: Callable[[list[tuple]], Iterator[tuple]], shards: int) -> DataFrame:
    """work's messages for every dst, given the messages sent to it in the order of (kind, src)."""
    rows = reduce(DataFrame.unionByName, messages)

    def run(group: pa.Table) -> pa.Table:
        got = sorted(zip(*(group.column(f.name).to_pylist() for f in ARROW)), key=lambda r: (r[0], r[2]))
        return table_of(list(work(got)))

    # A count that is given outright keeps small messages with much work apart.
    return rows.repartition(max(shards, min(2 * shards, 64), 1), "dst").groupBy("dst").applyInArrow(run, SCHEMA)


def each(df: DataFrame, work: Callable[[tuple], Iterator[tuple]]) -> DataFrame:
    """work's messages for every message of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(m for b in batches for row in zip(*(b.column(f.name).to_pylist() for f in ARROW)) for m in work(row))

    return df.mapInArrow(run, SCHEMA)


def by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in order) of the shards that have any."""
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for i in np.flatnonzero(np.diff(ends)):
        yield int(i), order[ends[i] : ends[i + 1]]
