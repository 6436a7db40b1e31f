"""Exact Jaccard self-join of word shingle sets by universe partition and pigeonhole.

Method. Set sizes fall into bands. Within a band, hashing sends every shingle to one of the
band's segments. Sets r and s with similarity of at least p/q differ in at most
H = (|r|+|s|)(q-p)/(q+p) shingles, so among segments that together tolerate H differences
(none in an exact segment, one in a deletion segment) one pair of segment subsets agrees
within its tolerance. An exact segment indexes its subset; a deletion segment indexes its
subset and the subset less any one shingle. How many segments of either kind a band has is
chosen by cost (`allocate`) from the number of other sets that share a shingle, measured over
all sets. A set is indexed in its own band and, when partners can be larger, in the next.
A set uses its band's segments in order until they tolerate its own largest H. Subsets that
could agree while empty count for nothing and aren't indexed, but for sets that then lack
segments; those index empty subsets too, so that two such sets still meet.

Equal sets are one node. Candidates of an index entry are first paired with one pivot of the
entry; once verified links have joined nodes into components, only entries that still hold
several components are paired on: members outside an entry's main component with all members
of other components. Pairs already in one component need no test, so no link between
components is lost and groups of near copies do not give all their pairs. A parity sketch of
2,048 bits bounds the difference from below and prunes exactly; what is left is verified on
whole texts.

Entries travel in squeezed arrays to shards that are ranges of signatures, and what a step has
shuffled is freed before the next one: a step's shuffle, not those of all, takes up disk.

Sets are named by a 64-bit hash of their content.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import U64, as_buffers, blocks, cut, drop_cut, freed, mix, mix_int, shingle_sets, signed, sums_by, words
from meterloom.llm.components import components
from meterloom.llm.exchange import COLUMNS, SCHEMA, batches_of, by_shard, expand, message, squeeze

GROWTH = 1.5
SKETCH = 32  # words of 64 bits
PAIR_COST, AGREE = 2.0, 0.05
#: Signatures are cut to so many bits. Those that agree by chance give pairs that the sketch or the texts rule out.
SIG_BITS = 48
SHARD = 1 << 21  # about so many entries a shard
OPEN, MET = range(2)
PART = 1024  # members of an entry in one part of the last round


def bands(limit: int) -> list[int]:
    """Lower ends of the size bands up to `limit`, and one more."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


def most_different(n, p: int, q: int):
    """The most shingles by which a set of n can differ from a partner that has similarity p/q."""
    return (n + n * q // p) * (q - p) // (q + p)


def allocate(size: int, units: int, shared: float) -> tuple[int, int]:
    """(deletion segments, exact segments) that tolerate units - 1 differences at least cost.

    The cost counts index entries, and candidates at PAIR_COST each. An entry is a candidate at most
    once, beside its signature's pivot: `shared` sets hold a given shingle, and each further shingle
    of a segment agrees with chance AGREE."""
    d = np.arange(units // 2 + 1)
    e = units - 2 * d
    d, e = d + d // 8 + (d > 0), e + e // 8 + 2 * (e > 0)  # spare ones in place of segments that stay empty
    g = size / (d + e)
    chance = np.minimum(1, shared * AGREE ** np.maximum(g - 1, 0))
    loose = np.minimum(1, shared * AGREE ** np.maximum(g - 2, 0))
    cost = e * (1 + PAIR_COST * chance) + d * (g + 1) * (1 + PAIR_COST * loose)
    best = int(np.argmin(cost))
    return int(d[best]), int(e[best])


def schemes(limit: int, p: int, q: int, shared: float, force_deletions: bool = False) -> list[tuple[int, int, int]]:
    """For each band (lower end, deletion segments, exact segments)."""
    ends, out = bands(limit), []
    for low, high in zip(ends, ends[1:]):
        units = most_different(high - 1, p, q) + 1
        d, e = (units // 2 + units // 16 + 1, units % 2) if force_deletions else allocate((low + high) // 2, units, shared)
        out.append((low, d, e))
    return out


def describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """doc_id, size, content hash, least shingle and parity sketch of each document's set."""
    for batch, data, offsets in blocks(batches, "text"):
        sh, doc = shingle_sets(words(data, offsets), k)
        n = batch.num_rows
        size = np.bincount(doc, minlength=n)
        name = mix(sums_by(mix(sh ^ U64(0x1B873593CC9E2D51)), doc, n) + size.astype(U64))
        least = np.zeros(n, U64)
        least[doc[::-1]] = sh[::-1]  # sorted by document and hash: the first of each stays
        bits = np.zeros((n, SKETCH), U64)
        slot = (mix(sh ^ U64(0x7FEB352D9E3779B9)) % U64(64 * SKETCH)).astype(np.int64)
        np.bitwise_xor.at(bits, (doc, slot // 64), U64(1) << (slot % 64).astype(U64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), signed(name), signed(least), *(signed(np.ascontiguousarray(bits[:, i])) for i in range(SKETCH))], ["doc_id", "n", "set_id", "least", *(f"s{i}" for i in range(SKETCH))])


def signatures(sh: np.ndarray, doc: np.ndarray, n_docs: int, plan: list[tuple[int, int, int]], p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) of all index entries."""
    size = np.bincount(doc, minlength=n_docs)
    need = most_different(size, p, q) + 1
    lows = np.array([low for low, _, _ in plan] or [1])
    own = np.maximum(np.searchsorted(lows, size, "right") - 1, 0)
    sigs, docs = [], []
    for up in (0, 1):
        band = own + up
        on = (need > 1) & (band < len(plan))
        if up:
            on &= size * q // p >= lows[np.minimum(band, len(lows) - 1)]
        for b in np.unique(band[on]):
            _, d, e = plan[b]
            chosen = np.flatnonzero(on & (band == b))
            place = np.full(n_docs, -1)
            place[chosen] = np.arange(len(chosen))
            of = place[doc]
            mine = of >= 0
            of, salt = of[mine], mix_int(int(b) + 77)
            h = mix(sh[mine] ^ U64(salt))
            m = d + e
            seg = (mix(h + U64(1)) % U64(m)).astype(np.int64)
            cell = of * m + seg
            count = np.bincount(cell, minlength=len(chosen) * m).reshape(-1, m)
            loose = np.arange(m) < d
            # Units of tolerance from segments whose shared subset can't be empty, in order until they suffice.
            units = np.cumsum(np.where(loose, 2 * (count >= 2), count >= 1), axis=1)
            live = np.concatenate([np.zeros((len(chosen), 1), int), units[:, :-1]], axis=1) < need[chosen][:, None]
            scant = units[:, -1] < need[chosen]
            step, tag = U64(0x2545F4914F6CDD1D), mix(np.arange(m, dtype=U64) + U64(mix_int(int(b) + 991)))
            total = sums_by(h, cell, len(chosen) * m) + count.ravel().astype(U64) * step
            cells = np.flatnonzero(live & ((count > 0) | scant[:, None]))
            sigs.append(mix(total[cells] + tag[cells % m]))
            docs.append(chosen[cells // m])
            some = np.flatnonzero(live.ravel()[cell] & loose[seg])
            some = some[(count.ravel()[cell[some]] > 1) | scant[of[some]]]
            sigs.append(mix(total[cell[some]] - h[some] - step + tag[seg[some]]))
            docs.append(chosen[of[some]])
    if not sigs:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(docs)


def index_entries(batches: Iterator[pa.RecordBatch], k: int, plan: list[tuple[int, int, int]], p: int, q: int, shards: int, most: int = 1 << 20) -> Iterator[tuple]:
    """Entries for the shards of their signatures: those that meet here are joined to one pivot, which alone goes
    on under the signature (OPEN); the others go along beside their pivot (MET), dealt by signature and member."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[tuple]:
        sig, member = np.concatenate([x for x, _ in held]) >> U64(64 - SIG_BITS), np.concatenate([x for _, x in held])
        held.clear()
        order = np.lexsort((member, sig))
        sig, member = sig[order].astype(np.int64), member[order]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        fresh = new.copy()
        fresh[1:] |= member[1:] != member[:-1]
        pivot = member[np.flatnonzero(new)][np.cumsum(new) - 1]
        met = fresh & ~new
        # Signatures are even over their range, so a range of them is a shard.
        ends = np.searchsorted(sig[new] * shards >> SIG_BITS, np.arange(shards + 1))
        for i in np.flatnonzero(np.diff(ends)):
            at = slice(ends[i], ends[i + 1])
            yield message(OPEN, int(i), 0, *packed_entries(sig[new][at], member[new][at]))
        sig, member, pivot = sig[met], member[met], pivot[met]
        to = (mix(member.view(U64) ^ mix(sig.astype(U64))) % U64(shards)).astype(np.int64)
        for i, place in by_shard(to, shards):
            yield message(MET, i, 0, *packed_entries(sig[place], member[place], pivot[place]))

    for batch, data, offsets in blocks(batches, "text"):
        sh, doc = shingle_sets(words(data, offsets), k)
        n = batch.num_rows
        size = np.bincount(doc, minlength=n)
        name = mix(sums_by(mix(sh ^ U64(0x1B873593CC9E2D51)), doc, n) + size.astype(U64)).view(np.int64)
        _, first = np.unique(name, return_index=True)
        if len(first) < n:
            keep = np.zeros(n, bool)
            keep[first] = True
            sh, doc = sh[keep[doc]], doc[keep[doc]]
        sig, of = signatures(sh, doc, n, plan, p, q)
        if len(sig):
            held.append((sig, name[of]))
        if sum(len(x) for x, _ in held) >= most:
            yield from flush()
    if held:
        yield from flush()


def packed_entries(sig: np.ndarray, *members: np.ndarray) -> tuple[bytes, ...]:
    """Entries sorted by signature: signatures, distinct members, and the places of each entry's members among these."""
    names, place = np.unique(np.concatenate(members), return_inverse=True)
    return squeeze(sig, True), names.astype("<i8").tobytes(), *(squeeze(x) for x in place.reshape(len(members), -1))


def unpacked_entries(sig: bytes, names: bytes, *places: bytes) -> tuple[np.ndarray, ...]:
    known = np.frombuffer(names, "<i8")
    return expand(sig, True), *(known[expand(x)] for x in places)


def stars(rows: list[tuple]) -> pa.Table:
    """A shard's entries that are not alone, each beside the least member as pivot; and those that met one before."""
    none = np.zeros(0, np.int64)
    opened = [unpacked_entries(*r[4:7]) for r in rows if r[0] == OPEN]
    sig, member = (np.concatenate([none, *x]) for x in zip(*opened)) if opened else (none, none)
    order = np.lexsort((member, sig))
    sig, member = sig[order], member[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    pivot = member[new][np.cumsum(new) - 1]
    on = pivot != member
    on[1:] &= new[1:] | (member[1:] != member[:-1])
    out = [(sig[on], pivot[on], member[on])]
    for r in rows:
        if r[0] == MET:
            sig, member, pivot = unpacked_entries(*r[4:8])
            out.append((sig, pivot, member))
    return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], ["sig", "pivot", "member"])


def expected_entries(nodes: DataFrame, plan: list[tuple[int, int, int]]) -> int:
    """About how many entries the sets make, twice as many as in their own bands."""
    lows, out = np.array([low for low, _, _ in plan] or [1]), 0.0
    by_size = nodes.groupBy(F.floor(F.log(F.col("n") + 0.5) / np.log(GROWTH)).alias("b")).agg(F.count("*").alias("c"), F.avg("n").alias("n")).collect()
    for r in by_size:  # a row for each band of sizes
        if plan:
            _, d, e = plan[max(int(np.searchsorted(lows, r.n, "right")) - 1, 0)]
            out += 2 * r.c * (e + d + r.n * d / max(d + e, 1))
    return int(out)


def verify(batches: Iterator[pa.RecordBatch], k: int, p: int, q: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose whole texts have similarity p/q or more, by about `limit` bytes of text, one pair at least."""
    for whole in batches:
        texts = [as_buffers(whole.column(i)) for i in (2, 3)]
        reach, at = sum(offsets for _, offsets in texts), 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(reach, reach[at] + limit, "right")) - 1)
            n = to - at
            sides = [shingle_sets(words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]), k) for data, offsets in texts]
            sh, doc = (np.concatenate(x) for x in zip(*sides))
            order = np.lexsort((sh, doc))
            sh, doc = sh[order], doc[order]
            same = (sh[1:] == sh[:-1]) & (doc[1:] == doc[:-1])
            both = np.bincount(doc[1:][same], minlength=n)
            union = np.bincount(doc, minlength=n) - both
            yield whole.select([0, 1]).slice(at, n).filter(pa.array((q * both >= p * union) & (union > 0)))
            at = to


def _within(p: int, q: int):
    """Condition on a pair of sets' sizes and sketches that no pair of similarity p/q fails."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(SKETCH)])
    return (apart * (p + q) <= (F.col("a_n") + F.col("b_n")) * (q - p)) & (F.least("a_n", "b_n") * q >= F.greatest("a_n", "b_n") * p)


def join_classes(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100, force_deletions: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links of Jaccard similarity p/q or more
    between sets of k-word shingles. Null and wordless texts have n_shingles 0 and link with
    nothing; a null doc_id keeps its row and is no component's smallest unless all are null.
    Rows that repeat come back as often. Other columns are not read."""
    docs = docs.select("doc_id", "text")
    sketch = [f"s{i}" for i in range(SKETCH)]
    sets = cut(docs.mapInArrow(lambda x: describe(x, k), "doc_id long, n long, set_id long, least long, " + ", ".join(f"{s} long" for s in sketch)))
    nodes = cut(sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "least", *sketch))))
    described, sets = sets, cut(sets.select("doc_id", "n", "set_id"))  # the sketches go on with the nodes alone
    drop_cut(described)
    limit, shared = nodes.groupBy("least").agg(F.count("*").alias("c"), F.max("n").alias("n")).agg(F.max("n"), F.sum(F.col("c") * (F.col("c") - 1)) / F.sum("c")).first()
    plan = schemes(int(limit or 0) * q // p + 1, p, q, float(shared or 0), force_deletions)

    shards = expected_entries(nodes, plan) // SHARD + 1
    entries = docs.mapInArrow(lambda x: batches_of(index_entries(x, k, plan, p, q, shards)), SCHEMA)

    def gather(group: pa.Table) -> pa.Table:
        return stars(list(zip(*(group.column(f).to_pylist() for f in ("kind", "dst", "src", "n", *COLUMNS)))))

    dealt = entries.repartition(max(shards, min(2 * shards, 64)), "dst")
    stars_of = freed(cut(dealt.groupBy("dst").applyInArrow(gather, "sig long, pivot long, member long")))

    def side(name: str, key: str) -> DataFrame:
        return involved.select(F.col("set_id").alias(key), F.col("n").alias(f"{name}_n"), *(F.col(s).alias(f"{name}_{s}") for s in sketch))

    def pruned(pairs: DataFrame) -> DataFrame:
        return freed(cut(pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").where(_within(p, q)).select("a", "b")))

    # Where ids tell rows apart, a set's least doc_id names one text; elsewhere one of its rows is picked.
    repeated = not sets.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").isEmpty()
    texts = None

    def verified(pairs: DataFrame) -> DataFrame:
        ta = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
        tb = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
        return freed(cut(pairs.join(tb, "b").join(ta, "a").select("a", "b", "text_a", "text_b").mapInArrow(lambda x: verify(x, k, p, q), "a long, b long")))

    def named(x: DataFrame) -> DataFrame:
        return x.select(F.least("pivot", "member").alias("a"), F.greatest("pivot", "member").alias("b"))

    # All pairs of an entry's pivot and member that the sketch does not rule out.
    near = cut(named(stars_of).distinct())
    involved = cut(nodes.join(near.select(F.col("a").alias("set_id")).union(near.select("b")).distinct(), "set_id", "left_semi"))
    pairs = pruned(near)
    drop_cut(near)
    needed = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "set_id")

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = nodes.join(ids, "set_id", "left_semi").select(F.col("doc_id").alias("want")).distinct()
        found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("want")), "left_semi")
        found = found.mapInArrow(lambda x: with_names(x, k), "set_id long, text string")
        return freed(cut(found.join(ids, "set_id", "left_semi").dropDuplicates(["set_id"]) if repeated else found))

    texts = fetch(needed)
    # The first tests take one partner of each set, then those between components that remain.
    links = verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    labels = freed(components(links))

    def open_rows(x: DataFrame, a: str, b: str) -> DataFrame:
        la = labels.select(F.col("node").alias(a), F.col("component").alias("ca"))
        lb = labels.select(F.col("node").alias(b), F.col("component").alias("cb"))
        return x.join(la, a, "left").join(lb, b, "left").withColumn("ca", F.coalesce("ca", a)).withColumn("cb", F.coalesce("cb", b)).where("ca != cb")

    more = verified(open_rows(pairs, "a", "b").select("a", "b"))
    if not more.isEmpty():
        links = links.union(more)
        labels = freed(components(links))
    # Entries that still hold several components: members outside the main one meet a varied member
    # of it, as long as that gives links, and then every member of another component.
    turn, last = 0, False
    while True:
        left = open_rows(stars_of, "pivot", "member").select("sig").distinct()
        held = stars_of.join(left, "sig", "left_semi")
        held = held.select("sig", F.col("pivot").alias("m")).union(held.select("sig", F.col("member").alias("m"))).distinct()
        held = freed(cut(held.join(labels.select(F.col("node").alias("m"), "component"), "m", "left").withColumn("component", F.coalesce("component", "m"))))
        by_part = held.groupBy("sig", "component").agg(F.count("*").alias("c"), F.max(F.struct(F.xxhash64("m", "sig", F.lit(turn)).alias("h"), "m"))["m"].alias("some"))
        main = by_part.groupBy("sig").agg(F.max(F.struct("c", "component", "some")).alias("main"), F.sum("c").alias("all")).where("all > 2").select("sig", "main.component", "main.some", (F.floor(F.col("all") / PART) + 1).alias("parts"))
        outside = held.join(main.withColumnRenamed("component", "mc"), "sig").where("component != mc").select("sig", F.col("m").alias("x"), F.col("component").alias("cx"), "some", "parts")
        if last:
            # Members of a large entry are dealt into parts; those outside the main component go to each part.
            mine = outside.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            whole = held.join(main.select("sig", "parts"), "sig").withColumn("part", F.pmod(F.xxhash64("m"), F.col("parts"))).drop("parts")
            other = mine.join(side("a", "x"), "x").join(whole.join(side("b", "m"), "m"), ["sig", "part"]).where((F.col("cx") != F.col("component")) & _within(p, q)).select("x", "m")
        else:
            other = outside.select("x", F.col("some").alias("m"))
        cross = pruned(other.select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
        more = None
        if not cross.isEmpty():
            rest = cross.select(F.col("a").alias("set_id")).union(cross.select("b")).distinct().join(texts, "set_id", "left_anti")
            texts = texts.union(fetch(rest))
            more = verified(cross)
        drop_cut(held)
        found = more is not None and not more.isEmpty()
        if found:
            links = links.union(more)
            labels = freed(components(links))
        if last:
            break
        turn += 1
        last = turn >= 3 or not found

    joined = nodes.select("set_id", F.col("doc_id").alias("least_id")).join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = cut(joined.join(smallest, "component").select("set_id", "component_id"))
    drop_cut(stars_of, pairs, nodes, involved, texts, links, labels)
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"))
    return rows.join(classes, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def with_names(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in blocks(batches, "text"):
        sh, doc = shingle_sets(words(data, offsets), k)
        size = np.bincount(doc, minlength=batch.num_rows)
        name = mix(sums_by(mix(sh ^ U64(0x1B873593CC9E2D51)), doc, batch.num_rows) + size.astype(U64))
        yield pa.RecordBatch.from_arrays([signed(name), batch.column(1)], ["set_id", "text"])
