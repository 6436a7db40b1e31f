"""Shared pieces: tables cut in the shared folder, and hashing of words over Arrow batches.

Text is read as UTF-8 bytes with NumPy. A-Z is lower-cased; a word is a run of bytes
other than space and 0x09-0x0D, so bytes and code points give the same words. Word
hashes are 64-bit polynomial hashes followed by a mixing step.
"""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault("dir", tempfile.mkdtemp(prefix="cut-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which ends its lineage."""
    path = f"{shared_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(*made: DataFrame) -> None:
    """Delete the files of tables written by cut() that nothing reads any more, and shuffle files."""
    spark = made[0].sparkSession
    jvm, root = spark.sparkContext._jvm, shared_root(spark)
    for path in {f.rsplit("/", 1)[0] for df in made for f in df.inputFiles()}:
        if path.startswith((root, "file:" + root.removeprefix("file:").replace("///", "/"))):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    freed(made[0])


def freed(df: DataFrame) -> DataFrame:
    """df, a table that no longer needs what made it. Shuffle files of jobs that are done go when the driver's JVM
    finds them unused, so it is asked to look; what the last job made shows as unused at the second look only."""
    jvm = df.sparkSession.sparkContext._jvm
    for _ in range(2):
        jvm.java.lang.System.gc()
        time.sleep(0.2)
    return df


def relieved(spark: SparkSession) -> None:
    """Executors collect their garbage, which shrinks heaps that earlier steps have grown: a JVM keeps what it once
    took, beside its Python workers. Idle executors get one task each; those that are busy may be left out."""
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # without the driver
    if executors > 0:
        look = spark.range(0, executors, 1, executors).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc"))
        look.write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_with(df: DataFrame, *fields: tuple[str, str]) -> StructType:
    """df's schema and more columns, each a (name, type)."""
    return StructType(list(df.schema.fields) + [StructType.fromDDL(f"`{name}` {kind}").fields[0] for name, kind in fields])


def fold_of(column: str, folds: int):
    """crc32 of an integer column's text, mod folds; null counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fold_of_id(value, folds: int) -> int:
    return zlib.crc32(str(value).encode() if value is not None else b"") % folds


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    x &= (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
    return x ^ (x >> 31)


WINDOW = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but letters of ASCII and bytes of other characters.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, WINDOW + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            t = np.full(n, base, U64)
            t[0] = 1
            _powers[name] = np.multiply.accumulate(t)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of several documents in order: hash, document's place, first byte, byte after the last."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def as_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, gap: np.ndarray | None = None) -> Words:
    """Words of the documents data[offsets[i]:offsets[i+1]], in windows of bounded size that end between words.

    gap tells which bytes separate words, white space unless given."""
    gap = _GAP if gap is None else gap
    n, starts, ends, hashes, at = len(data), [], [], [], 0
    edges = np.zeros(n + 1, bool)
    edges[offsets] = True
    while at < n:
        to = min(n, at + WINDOW)
        while to < n and not (gap[data[to]] or edges[to]):
            step = np.flatnonzero(gap[data[to : to + WINDOW]] | edges[to : min(n, to + WINDOW)])
            to = to + int(step[0]) if len(step) else min(n, to + WINDOW)
        b = data[at:to]
        inside = ~gap[b]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edges[at + 1 : to]
        last[:-1] &= ~inside[1:] | edges[at + 1 : to]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power_tables(len(b) + 1)
        total = np.zeros(len(b) + 1, U64)
        np.cumsum(_BYTES[_LOWER[b] if lower else b] * up[: len(b)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U64) * U64(0xA24BAED4963EE407)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    none = np.zeros(0, np.int64)
    s = np.concatenate(starts) if starts else none
    return Words(np.concatenate(hashes) if hashes else none.astype(U64), np.searchsorted(offsets, s, "right") - 1, s, np.concatenate(ends) if ends else none, len(offsets) - 1)


def hash_word(word: str) -> int:
    """The hash that words() gives one word, as an unsigned integer."""
    return int(words(*as_buffers(pa.array([word]))).hash[0])


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `limit` bytes of text, one document at least, each with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = as_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    give_back()


def give_back() -> None:
    """Return to the system what this process has freed: workers that wait for their next task would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each document's distinct k-word shingles, sorted by document and hash.

    With 1 to k-1 words the whole sequence is one shingle; without words there is none."""
    n = len(w.hash)
    counts = w.counts()
    acc = np.zeros(n, U64)
    for j in range(k):
        factor = U64(mix_int(j + 1) | 1)
        acc[: n - j if j else n] += mix(w.hash[j:] + factor) * factor
    ends = np.cumsum(counts)
    place = np.arange(n) - (ends - counts)[w.doc]
    whole = place + k <= counts[w.doc]
    sh, doc = mix(acc[whole]), w.doc[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first, extra = (ends - counts)[short], np.zeros(len(short), U64)
        for j in range(k - 1):
            has = counts[short] > j
            factor = U64(mix_int(1000 + j) | 1)
            extra[has] += mix(w.hash[first[has] + j] + factor) * factor
        sh, doc = np.concatenate([sh, mix(extra ^ U64(0x5851F42D4C957F2D))]), np.concatenate([doc, short])
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return sh[new], doc[new]


def sums_by(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of uint64 values by group, mod 2**64."""
    out = np.zeros(n, U64)
    np.add.at(out, group, values)
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))
