"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into a normaliser (dummy prefix, white space escaped), a lexicon of
pieces with their prefixes, byte fallback for other characters, and weights in the tropical
semiring. Composed with an input it gives a lattice whose arcs are pieces between positions;
the encoding is the lattice's shortest path.

Unigram models weigh an arc by its negative log-probability. Byte-pair models weigh a pair of
neighbouring pieces: 0 when merging the two pieces' text by rank ends in just those pieces,
infinity otherwise. A sequence of pieces is the outcome of merging exactly if all its
neighbouring pairs are, so one path of finite weight remains and it is the model's encoding.

If no piece has a white-space mark after another character, no arc crosses such a place, and
the lattice falls apart into segments; equal segments of a block of text are composed once.
All lattices of a block advance together, one end position at a time, in NumPy.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meterloom.llm.common import U64, blocks, mix, schema_with

SPACE = "▁"
BASE = 0xD6E8FEB86659FD93 | 1
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _messages(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = number(i)
        kind = tag & 7
        if kind == 0:
            value, i = number(i)
        else:
            n, i = number(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class HashTable:
    """Places of distinct 64-bit keys, by open addressing over NumPy arrays."""

    def __init__(self, keys: np.ndarray):
        self.mask = U64((1 << max(4, int(len(keys) * 4).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, U64)
        self.at = np.full(int(self.mask) + 1, -1, np.int32)
        slot, todo = keys & self.mask, np.arange(len(keys))
        self.reach = 0
        while len(todo):
            self.reach += 1
            free = self.at[slot[todo]] < 0
            _, first = np.unique(slot[todo[free]], return_index=True)
            win = todo[free][first]
            self.at[slot[win]], self.keys[slot[win]] = win, keys[win]
            todo = np.setdiff1d(todo, win, assume_unique=True)
            slot[todo] = (slot[todo] + U64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & self.mask
        out = np.where(self.keys[slot] == keys, self.at[slot], -1)
        rest = np.flatnonzero((out < 0) & (self.at[slot] >= 0))
        for _ in range(self.reach):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + U64(1)) & self.mask
            hit = (self.keys[slot[rest]] == keys[rest]) & (self.at[slot[rest]] >= 0)
            out[rest[hit]] = self.at[slot[rest[hit]]]
            rest = rest[~hit & (self.at[slot[rest]] >= 0)]
        return out


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hash(text: str) -> int:
    s = symbols(text)
    return int((mix(s.astype(U64) + U64(0x51ED27)) * powers(len(s), BASE)).sum(dtype=U64)) if len(s) else 0


@dataclass
class Transducer:
    """A compiled model; plain arrays, so that tasks need no model file."""

    pieces: list[str]
    kinds: np.ndarray
    weights: np.ndarray  # of unigram arcs
    merges: bool
    dummy_prefix: bool
    collapse: bool  # runs of white space become one, ends are trimmed
    fallback: bool
    unknown: int
    bytes_at: np.ndarray  # id of each byte's piece, or -1
    words: bool  # segments are independent
    ids: np.ndarray = field(default=None)  # of lexicon entries
    table: HashTable = field(default=None)
    prefixes: HashTable = field(default=None)
    longest: int = 1
    key: np.ndarray = field(default=None)  # hash of each piece
    shift: np.ndarray = field(default=None)  # BASE to the power of its length
    rank: np.ndarray = field(default=None)
    left: np.ndarray = field(default=None)
    right: np.ndarray = field(default=None)


def compile_model(path: str) -> Transducer:
    """The transducer of a SentencePiece model file."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, trainer, normal = [], [], [], {}, {}
    for name, value in _messages(data):
        if name == 1:
            m = dict(_messages(value))
            pieces.append(m[1].decode())
            scores.append(struct.unpack("<f", m.get(2, b"\0\0\0\0"))[0])
            kinds.append(m.get(3, NORMAL))
        elif name == 2:
            trainer = dict(_messages(value))
        elif name == 3:
            normal = dict(_messages(value))
    if normal.get(2):
        raise ValueError("this model's character map isn't supported: only identity normalisation is")
    if trainer.get(3, 1) not in (1, 2):
        raise ValueError("only unigram and byte-pair models are supported")
    kinds, merges = np.array(kinds), trainer.get(3, 1) == 2
    bytes_at = np.full(256, -1, np.int64)
    for i in np.flatnonzero(kinds == BYTE):
        bytes_at[int(pieces[i][3:5], 16)] = i
    ids = np.flatnonzero((kinds == NORMAL) | (kinds == USER))
    t = Transducer(pieces, kinds, -np.array(scores, np.float64), merges, bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(trainer.get(35, 0)) and (bytes_at >= 0).all(), int(np.flatnonzero(kinds == UNKNOWN)[0]), bytes_at, not any(SPACE in pieces[i].lstrip(SPACE) for i in ids))
    t.ids = ids
    t.key = np.array([_hash(p) for p in pieces], U64)
    t.table = HashTable(t.key[ids])
    t.prefixes = HashTable(np.unique(np.array([_hash(p) for p in {pieces[i][:k] for i in ids for k in range(1, len(pieces[i]) + 1)}], U64)))
    t.longest = max((len(pieces[i]) for i in ids), default=1)
    t.shift = powers(max(map(len, pieces), default=0) + 1, BASE)[[len(p) for p in pieces]]
    if merges:
        _merge_tables(t, np.array(scores))
    return t


def _merge_tables(t: Transducer, scores: np.ndarray) -> None:
    """Ranks of the merges, and the two pieces that each piece is merged from (itself if none).

    Pieces of equal score merge leftmost first; among runs of one character that is the longer first."""
    order = sorted(t.ids, key=lambda i: (-scores[i], -len(t.pieces[i]), i))
    t.rank = np.full(len(t.pieces), 1 << 40, np.int64)
    t.rank[order] = np.arange(len(order))
    t.left, t.right = np.arange(len(t.pieces)), np.arange(len(t.pieces))
    known = {t.pieces[i]: i for i in t.ids}
    for i in t.ids:
        parts = list(t.pieces[i])
        while len(parts) > 1:
            found = [(t.rank[known[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in known]
            if not found:
                break
            _, k = min(found)
            if len(parts) == 2 and all(x in known for x in parts):
                t.left[i], t.right[i] = known[parts[0]], known[parts[1]]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) > 1:
            t.rank[i] = -1  # merging never makes this piece


def stays(t: Transducer, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the text of pieces a and b by rank ends in a and b.

    From the end back: the merge of the two that came last is undone, and the pieces that then face
    each other must not make a piece that would have merged before it."""
    out = (t.rank[a] >= 0) & (t.rank[b] >= 0)
    live = np.flatnonzero(out)
    x, y = a[live], b[live]
    before = np.full(len(live), 1 << 41, np.int64)  # the rank at which x or y goes on, where b's merge wins ties
    while len(live):
        joined = t.table.find(t.key[x] + t.key[y] * t.shift[x])
        rank = np.where(joined >= 0, t.rank[t.ids[joined]], 1 << 42)
        wrong = (rank >= 0) & (rank < before)
        out[live[wrong]] = False
        rx, ry = np.where(t.left[x] != x, t.rank[x], -1), np.where(t.left[y] != y, t.rank[y], -1)
        go = ~wrong & ((rx >= 0) | (ry >= 0))
        live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
        undo_x = rx > ry
        # A pair across the boundary lies right of all of a's other pairs and left of b's: it wins a tie against b only.
        before = np.where(undo_x, rx, ry + 1)
        x, y = np.where(undo_x, t.right[x], x), np.where(undo_x, y, t.left[y])
    return out


class Encoder:
    """Encodes blocks of texts; remembers which pairs of pieces stay, and paths of segments, in tables of fixed size."""

    SLOTS, POOL = 1 << 18, 1 << 22

    def __init__(self, t: Transducer):
        self.t = t
        self.pairs = np.full(1 << 21, -1, np.int64)
        self.stay = np.zeros(1 << 21, bool)
        self.names, self.at, self.width = np.zeros(self.SLOTS, U64), np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, np.int32)
        self.pool, self.used = np.zeros(self.POOL, np.int32), 0

    def valid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = (a << 32) | b
        slot = (pair * 0x9E3779B97F4A7C1 >> 24) & (len(self.pairs) - 1)
        miss = self.pairs[slot] != pair
        out = self.stay[slot]
        if miss.any():
            new = np.unique(pair[miss])
            ok = stays(self.t, new >> 32, new & 0xFFFFFFFF)
            out[miss] = ok[np.searchsorted(new, pair[miss])]
            at = (new * 0x9E3779B97F4A7C1 >> 24) & (len(self.pairs) - 1)
            self.pairs[at], self.stay[at] = -1, False
            _, last = np.unique(at, return_index=True)
            self.pairs[at[last]], self.stay[at[last]] = new[last], ok[last]
        return out

    def normal(self, text: str) -> str:
        if self.t.collapse:
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.t.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has)."""
        normal = [self.normal(x or "") for x in texts]
        sizes = np.array([len(x) for x in normal], np.int64)
        c = symbols("".join(normal))
        n = len(c)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        first = np.cumsum(sizes) - sizes
        start = np.zeros(n, bool)
        start[first[sizes > 0]] = True
        if self.t.words:
            mark = c == ord(SPACE)
            start[1:] |= mark[1:] & ~mark[:-1]
        begin = np.flatnonzero(start)
        length = np.diff(np.append(begin, n))
        up, down = powers(n + 1, BASE), powers(n + 1, pow(BASE, -1, 1 << 64))
        total = np.zeros(n + 1, U64)
        np.cumsum(mix(c.astype(U64) + U64(0x51ED27)) * up[:n], out=total[1:])
        name = mix((total[begin + length] - total[begin]) * down[begin] + length.astype(U64))
        name, one, which = np.unique(name, return_index=True, return_inverse=True)
        pool, offset, counts = self.segments(name, c, total, down, begin[one], length[one])
        per = counts[which]
        ends = np.cumsum(per)
        out = pool[np.arange(ends[-1]) - np.repeat(ends - per - offset[which], per)]
        doc = np.searchsorted(first[sizes > 0], begin, "right") - 1
        number = np.zeros(len(texts), np.int64)
        number[sizes > 0] = np.bincount(doc, per, (sizes > 0).sum()).astype(np.int64)
        return out, number

    def segments(self, name, c, total, down, begin, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each named segment's begin, how many it has)."""
        slot = (name & U64(self.SLOTS - 1)).astype(np.int64)
        known = (self.names[slot] == name) & (self.width[slot] > 0)
        offset, counts = self.at[slot].astype(np.int64), self.width[slot].astype(np.int64)
        new = np.flatnonzero(~known)
        if not len(new):
            return self.pool, offset, counts
        ids, counts[new] = self.paths(c, total, down, begin[new], length[new])
        offset[new] = np.cumsum(counts[new]) - counts[new]
        if self.used + len(ids) > self.POOL:  # start again; this block's old paths are copied out
            old = np.flatnonzero(known)
            ends = np.cumsum(counts[old])
            kept = self.pool[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts[old] - offset[old], counts[old])]
            offset[old] = ends - counts[old] + len(ids)
            self.width[:], self.used = 0, 0
            return np.concatenate([ids, kept]), offset, counts
        offset[new] += self.used
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.names[slot[new]], self.at[slot[new]], self.width[slot[new]] = name[new], offset[new], counts[new]
        return self.pool, offset, counts

    def paths(self, c, total, down, begin, length) -> tuple[np.ndarray, np.ndarray]:
        """Shortest paths of the lattices of c[begin:begin+length]: (ids one after another, how many each has)."""
        t = self.t
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)  # place in the segment
        real = np.repeat(begin, length) + at
        room = np.repeat(length, length) - at
        base = np.cumsum(length + 1) - length - 1  # a segment has one node more than symbols
        node = np.repeat(base, length) + at
        live = np.arange(len(real))
        froms, tos, labels = [], [], []
        for k in range(1, t.longest + 1):
            live = live[room[live] >= k]
            h = (total[real[live] + k] - total[real[live]]) * down[real[live]]
            found = t.table.find(h)
            if k == 1:
                lost = live[found < 0]
                froms.append(node[lost]), tos.append(node[lost] + 1), labels.append(np.full(len(lost), -1))
            hit = found >= 0
            froms.append(node[live[hit]]), tos.append(node[live[hit]] + k), labels.append(t.ids[found[hit]])
            live = live[t.prefixes.find(h) >= 0]
            if not len(live):
                break
        a, b, label = (np.concatenate(x) for x in (froms, tos, labels))
        if t.merges:
            keep = (label < 0) | (t.rank[label] >= 0)
            a, b, label = a[keep], b[keep], label[keep]
        nodes = int(length.sum() + len(length))
        place = np.zeros(nodes, np.int64)
        place[node] = at
        place[base + length] = length
        order = np.argsort(place[b], kind="stable")
        a, b, label = a[order], b[order], label[order]
        cuts = np.searchsorted(place[b], np.arange(1, int(length.max()) + 2))
        cost = np.full(nodes, np.inf)
        cost[base] = 0
        last, back = np.full(nodes, -2, np.int64), np.zeros(nodes, np.int64)
        for lo, hi in zip(cuts, cuts[1:]):
            x, y, piece = a[lo:hi], b[lo:hi], label[lo:hi]
            if t.merges:
                before = last[x]
                # Characters outside the lexicon merge with nothing.
                both = (before >= 0) & (piece >= 0)
                weight = np.zeros(len(x))
                weight[both] = np.where(self.valid(before[both], piece[both]), 0, np.inf)
            else:
                weight = np.where(piece >= 0, t.weights[piece], t.weights.max() + 10)
            way = cost[x] + weight
            best = np.lexsort((way, y))
            best = best[np.concatenate([[True], y[best][1:] != y[best][:-1]])] if len(best) else best
            best = best[np.isfinite(way[best])]
            cost[y[best]], last[y[best]], back[y[best]] = way[best], piece[best], x[best]
        segs, steps, got, codes = [], [], [], []
        seg, cur, step = np.arange(len(length)), base + length, 0
        while len(seg):
            segs.append(seg), steps.append(np.full(len(seg), -step)), got.append(last[cur]), codes.append(cur)
            cur, step = back[cur], step + 1
            more = cur > base[seg]
            seg, cur = seg[more], cur[more]
        seg, step, ids, end = (np.concatenate(x) for x in (segs, steps, got, codes))
        order = np.lexsort((step, seg))
        seg, ids, end = seg[order], ids[order], end[order]
        return self.without_lexicon(c, begin, base, seg, ids, end, len(length))

    def without_lexicon(self, c, begin, base, seg, ids, end, n) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the lexicon become the pieces of their bytes, or the unknown piece."""
        t, odd = self.t, np.flatnonzero(ids < 0)
        if len(odd) and t.fallback:
            char, which = np.unique(c[begin[seg[odd]] + end[odd] - base[seg[odd]] - 1], return_inverse=True)
            raw = [chr(x).encode("utf-8", "surrogatepass") for x in char]
            width = np.array([len(x) for x in raw])
            flat = t.bytes_at[np.frombuffer(b"".join(raw), np.uint8)]
            per = np.ones(len(ids), np.int64)
            per[odd] = width[which]
            to = np.cumsum(per)
            inner = np.arange(to[-1]) - np.repeat(to - per, per)
            source = np.zeros(len(ids), np.int64)
            source[odd] = (np.cumsum(width) - width)[which]
            wide = np.repeat(ids, per)
            ids = np.where(wide < 0, flat[np.minimum(np.repeat(source, per) + inner, len(flat) - 1)], wide)
            seg = np.repeat(seg, per)
        elif len(odd):
            ids[odd] = t.unknown
        return ids.astype(np.int32), np.bincount(seg, minlength=n)


class Decoder:
    """Turns ids back to text: pieces' bytes one after another, marks as spaces, the dummy prefix dropped."""

    def __init__(self, t: Transducer):
        self.t = t
        raw = []
        for p, kind in zip(t.pieces, t.kinds):
            raw.append(bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode())
        self.width = np.array([len(x) for x in raw])
        self.start = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        width = self.width[ids]
        ends = np.cumsum(width)
        data = self.flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width - self.start[ids], width)].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [x[1:] if self.t.dummy_prefix and x[:1] == " " else x for x in texts]


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "piece_ids") -> DataFrame:
    """docs with the ids of each text's pieces in `out`, an array of int (empty for null and empty texts).

    `model` is the path of a SentencePiece model file on the driver. A column `out` is replaced."""
    t = compile_model(model)
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(t)
        for batch, _, _ in blocks(batches, text, 1 << 18):
            ids, counts = encoder.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema_with(docs, (out, "array<int>")))


def round_trip(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with `piece_ids` as encode() gives them and `decoded`, the text that decode() makes of these, in one pass."""
    t = compile_model(model)
    docs = docs.drop("piece_ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(t), Decoder(t)
        for batch, _, _ in blocks(batches, text, 1 << 18):
            ids, counts = encoder.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(decoder.decode(ids.astype(np.int64), counts), pa.string())], [*batch.schema.names, "piece_ids", "decoded"])

    return docs.mapInArrow(run, schema_with(docs, ("piece_ids", "array<int>"), ("decoded", "string")))


def decode(rows: DataFrame, model: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """rows with the text of their ids in `out` (null ids: empty text). A column `out` is replaced."""
    t = compile_model(model)
    rows = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(t)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column(batch.schema.get_field_index(ids)).fill_null([])
                flat = lists.flatten().to_numpy().astype(np.int64)
                counts = np.diff(lists.offsets.to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoder.decode(flat, counts), pa.string())], [*batch.schema.names, out])

    return rows.mapInArrow(run, schema_with(rows, (out, "string")))
