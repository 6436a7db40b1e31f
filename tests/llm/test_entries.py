"""Index entries of the similarity join on their way to their shards."""

import numpy as np
import pyarrow as pa

from meterloom.llm import ngram_jaccard as nj
from meterloom.llm.ngram_jaccard import MET, OPEN, index_entries, packed_entries, schemes, stars, unpacked_entries


def texts(n: int) -> list[str]:
    rng = np.random.default_rng(5)
    return [" ".join(f"w{i}" for i in rng.integers(0, 5000, 300)) for _ in range(n)]


def test_packed_entries():
    rng = np.random.default_rng(1)
    sig = np.sort(rng.integers(0, 1 << 48, 5000))
    a, b = (rng.integers(-1 << 63, (1 << 63) - 1, 40)[rng.integers(0, 40, 5000)] for _ in range(2))
    assert all((x == y).all() for x, y in zip(unpacked_entries(*packed_entries(sig, a, b)), (sig, a, b)))


def test_entries_take_few_bytes():
    """Rows of three hashes took 29 bytes an entry in shuffle files."""
    batch = pa.record_batch({"doc_id": pa.array(range(400)), "text": texts(400)})
    plan = schemes(1000, 80, 100, 100.0)
    rows = list(index_entries(iter([batch]), 5, plan, 80, 100, 8))
    entries = sum(len(unpacked_entries(*r[4:7])[0]) for r in rows)
    assert entries > 20_000 and sum(len(x) for r in rows for x in r[4:] if x) < 12 * entries


def test_stars():
    """Each signature's members but the least, beside it, once; what met in a map task is passed on."""
    rng = np.random.default_rng(2)
    rows, pairs = [], set()
    for _ in range(5):
        sig, member = np.sort(rng.integers(0, 300, 200)), rng.integers(-50, 50, 200)
        rows.append((OPEN, 0, 0, 0, *packed_entries(sig, member)))
        pairs |= set(zip(sig.tolist(), member.tolist()))
    rows.append((MET, 0, 0, 0, *packed_entries(np.array([7]), np.array([99]), np.array([-99]))))
    least = {s: min(m for t, m in pairs if t == s) for s, _ in pairs}
    want = sorted([(s, least[s], m) for s, m in pairs if m != least[s]] + [(7, -99, 99)])
    assert sorted(zip(*(c.to_pylist() for c in stars(rows).columns))) == want
    assert stars([]).num_rows == 0


def test_shuffles_are_freed_step_by_step(spark, monkeypatch):
    """Before each further step of the join what earlier ones shuffled is given up."""
    calls = []
    monkeypatch.setattr(nj, "freed", lambda df: calls.append(df) or df)
    words = texts(30)
    docs = spark.createDataFrame([(i, words[i // 2] + (" end" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nj.join_classes(docs, k=5, p=80, q=100).collect()}
    assert got == {i: i - i % 2 for i in range(60)}
    # Entries, sketches, texts, tests and classes.
    assert len(calls) >= 5
