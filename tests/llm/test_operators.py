"""Each corpus operator against brute force on small tables, and its odd cases."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterloom.llm import common, components, embedding_dedup, html_template, imatch, language_id, ngram_jaccard, piece_transducer, pitman_yor, poisson_mix, quality_kn, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def frame(spark, texts, **more):
    rows = [(i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Random texts with exact and near copies, and odd ones."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [prose(rng, rng.randint(3, 200), vocabulary) for _ in range(40)]
    out = list(base)
    for b in base[:20]:
        out.append(b)
        for _ in range(3):
            w = b.split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    return [*out, None, "", " \t\n", "one", "One", "one two", "a b c", "A B\tc", prose(rng, 9000, vocabulary)]


def classes(sets, links):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(len(sets))]


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_words_and_folds():
    data, offsets = common.as_buffers(common.pa.array(["Ab  cd\té", None, "", "ab"]))
    w = common.words(data, offsets)
    assert w.counts().tolist() == [3, 0, 0, 1] and w.hash[0] == w.hash[3] == common.hash_word("aB")
    assert common.fold_of_id(12, 7) == zlib.crc32(b"12") % 7


def test_word_windows(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(2000))
    data, offsets = common.as_buffers(common.pa.array([text, "x" * 500, text[:100]]))
    whole = common.words(data, offsets)
    monkeypatch.setattr(common, "WINDOW", 97)
    parts = common.words(data, offsets)
    for name in ("hash", "doc", "start", "end"):
        assert (getattr(whole, name) == getattr(parts, name)).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    links = [(a, b) for a, b in edges if a is not None and a != b]
    want = classes(range(1100), links)
    nodes = {x for e in links for x in e}
    assert out == {x: want[x] for x in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k, p, force", [(3, 90, False), (5, 80, False), (3, 90, True), (2, 60, False)])
def test_similarity_join(spark, texts, k, p, force):
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j])]
    want = classes(sets, links)
    df = frame(spark, texts, set_id=["x"] * len(texts), component_id=["y"] * len(texts))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.join_classes(df, k, p, 100, force).collect()}
    assert out == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_similarity_join_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard.join_classes(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    out = collections.Counter((r.doc_id, r.component_id) for r in ngram_jaccard.join_classes(odd).collect())
    assert out == {(None, 3): 1, (3, 3): 2, (4, 4): 1}


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_verification_by_blocks_of_any_size(limit):
    left = ["a b c d", None, "a b", "", "x " * 500 + "y", "a b c d e f g h i j"]
    right = ["A b c d", "a b", None, "", "x " * 500 + "z", "a b c d e f g h i k"]
    ids = pa.array(range(6), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(left, pa.string()), pa.array(right, pa.string())], ["a", "b", "text_a", "text_b"])
    whole = [pa.RecordBatch.from_arrays(batch.columns, batch.schema.names), batch.slice(3, 3), batch.slice(0, 0)]
    got = [row["a"] for out in ngram_jaccard.verify(iter(whole), 3, 30, 100, limit) for row in out.to_pylist()]
    assert got == [0, 4, 5, 4, 5]


def test_allocation_tolerates_enough():
    for units in range(1, 60):
        for shared in (0.0, 10.0, 1e6):
            d, e = ngram_jaccard.allocate(9 * units, units, shared)
            assert 2 * d + e >= units


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    v = [x.tolist() for x in base] + [(x + rng.normal(0, s, 16)).tolist() for x in base[:30] for s in (0.0, 0.1, 0.25)]
    v += [(2 * base[0]).tolist(), None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0]]
    df = spark.createDataFrame([(i, x, "l") for i, x in enumerate(v)], "vec_id long, embedding array<double>, node string")
    good = [*range(151), 156]
    links = []
    for a in good:
        for b in good:
            if b < a and len(v[a]) == len(v[b]):
                x, y = np.array(v[a]), np.array(v[b])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9:
                    links.append((a, b))
    want, degree = classes(v, links), collections.Counter(x for e in links for x in e)
    for block in (1024, 8):
        out = {r.vec_id: r for r in embedding_dedup.near_vectors(df, recall=0.999999, block=block).collect()}
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in out.items()} == {i: (degree[i], want[i], want[i] == i) for i in range(len(v))}
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_fingerprints(spark, texts):
    df = frame(spark, [*texts, texts[0]], own=["c"] * (len(texts) + 1), block=["c"] * (len(texts) + 1))
    out = {r.doc_id: r for r in imatch.fingerprints_with_next(df).collect()}
    n = len(texts) + 1
    assert len(out) == n
    whole = [*texts, texts[0]]
    for i in range(n):
        t, nxt = whole[i] or "", whole[(i - 1) % n] or ""
        cut = len(t) // 3
        assert out[i].n_chars == len(t)
        assert out[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
    assert out[0].fingerprint == out[n - 1].fingerprint and out[0].near_next == 1.0
    assert imatch.fingerprints_with_next(df.limit(0)).count() == 0
    one = imatch.fingerprints_with_next(spark.createDataFrame([(None, "abc")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()


def test_neighbours_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "split_points", lambda docs, **_: [10, 11, 40, 80, 1000])
    df = spark.createDataFrame([(i, f"text number {i} {'w' * (i % 9)}") for i in range(0, 120, 3)] + [(9, "twin"), (None, "no id")], "doc_id long, text string")
    rows = sorted([(r.doc_id if r.doc_id is not None else -1, r.text) for r in df.withColumn("h", F.xxhash64("text")).orderBy(F.desc_nulls_last("doc_id"), F.desc("h")).collect()], key=lambda x: 0)
    want = set()
    for (_, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]]):
        cut = len(t) // 3
        want.add(hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())
    assert {r.edited_sha256 for r in imatch.fingerprints_with_next(df).collect()} == want


def test_languages(spark):
    rng = random.Random(2)
    words = {"aa": ["the", "and", "water", "stone"], "bb": ["der", "und", "wasser", "stein"], "cc": ["вода", "камень", "земля"]}
    made = [(prose(rng, 40, words[x]), x) for x in ("aa", "bb", "cc") for _ in range(40)]
    extra = [(None, None), ("", "aa"), ("12 !? 3", "aa"), (prose(rng, 30, words["aa"]) + " " + prose(rng, 60, words["bb"]), None)]
    df = frame(spark, [t for t, _ in made + extra], lang=[x for _, x in made + extra], lang_pred=["x"] * 124, score=["x"] * 124)
    out = {r.doc_id: r for r in language_id.identify(df, spans=True).collect()}
    assert all(out[i].lang_pred == x for i, (_, x) in enumerate(made))
    assert [out[120 + i].lang_pred for i in range(4)] == ["und", "und", "und", "bb"]
    spans = out[123].spans
    assert [s.lang for s in spans] == ["aa", "bb"] and 0.5 < out[123].score < 1
    whole = extra[3][0].encode()
    assert whole[spans[1].start :].decode() == whole.decode()[-len(whole[spans[1].start :].decode()) :]
    bare = language_id.identify(df.withColumn("lang", F.lit(None).cast("string")).drop("spans"))
    assert {r.lang_pred for r in bare.collect()} == {"und"}


def test_viterbi_against_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    lengths = np.array([4, 0, 6, 1])
    s = rng.normal(size=(11, 3)).astype(np.float32)
    got, at = language_id.viterbi(s, lengths, 0.7), 0
    for n in lengths:
        if n:
            part = s[at : at + n]
            best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(part[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:])))
            assert tuple(got[at : at + n]) == best
        at += n


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")
def test_pieces(spark, texts):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    odd = ["".join(rng.choice("ab the  ▁é執🙂\n\x00.0Z") for _ in range(rng.randint(0, 50))) for _ in range(300)] + [" " * 40 + "x", "x" * 700]
    whole = [t for t in texts if t is not None] + odd
    t = piece_transducer.compile_model(MODEL)
    e = piece_transducer.Encoder(t)
    for _ in range(2):  # the second time from the tables
        ids, counts = e.encode(whole)
        ends = np.cumsum(counts)
        assert [ids[b - n : b].tolist() for n, b in zip(counts, ends)] == sp.encode(whole)
    assert piece_transducer.Decoder(t).decode(ids.astype(np.int64), counts) == [sp.decode(x) for x in sp.encode(whole)]
    df = piece_transducer.decode(piece_transducer.encode(frame(spark, texts, piece_ids=["x"] * len(texts)), MODEL), MODEL)
    assert all((r.text or "") == r.decoded for r in df.collect())
    assert piece_transducer.encode(frame(spark, texts).limit(0), MODEL).count() == 0


def test_unigram_paths_against_brute_force():
    t = piece_transducer.Transducer(["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "aba"], np.array([2, 1, 1, 1, 1, 1, 1, 1]), np.array([0, 3, 2, 2.5, 2.2, 3.9, 2.8, 4.6]), False, True, False, False, 0, np.full(256, -1), True)
    t.ids, t.key = np.arange(1, 8), np.array([piece_transducer._hash(p) for p in t.pieces], np.uint64)
    t.table, t.longest = piece_transducer.HashTable(t.key[t.ids]), 3
    t.prefixes = piece_transducer.HashTable(np.unique(np.array([piece_transducer._hash(p[:k]) for p in t.pieces[1:] for k in range(1, len(p) + 1)], np.uint64)))

    def best(s):
        ways = [(0.0, [])] + [(math.inf, [])] * len(s)
        for i in range(1, len(s) + 1):
            for j in range(i):
                if s[j:i] in t.pieces[1:]:
                    w = ways[j][0] + t.weights[t.pieces.index(s[j:i])]
                    if w < ways[i][0] - 1e-12:
                        ways[i] = (w, [*ways[j][1], t.pieces.index(s[j:i])])
        return ways[-1][0]

    e = piece_transducer.Encoder(t)
    for text in ("abab", "baab aba", "a b ab", "bbb"):
        ids, counts = e.encode([text])
        assert t.weights[ids].sum() == pytest.approx(best(e.normal(text)))


def test_toxicity(spark):
    rng = random.Random(6)
    clean = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    texts, toxic = [], []
    for i in range(600):
        bad = i % 8 == 0
        w = prose(rng, 30, clean).split(" ")
        if bad:
            w[rng.randrange(30)] = rng.choice(["zorky", "zorkest!", "Vexum"])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    df = frame(spark, [*texts, None, ""], score=["x"] * 602)
    labels = spark.createDataFrame([(i, toxic[i]) for i in range(600)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.toxicity(df, labels).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == toxic[i] for i in held]) > 0.95
    assert 0 <= out[600] == out[601] < 0.5
    assert toxicity.toxicity(df, labels.limit(0)).where("score >= 0.5").count() == 0
    assert toxicity.toxicity(df.limit(0), labels).count() == 0


def page(title, paragraphs, extra="", close=True):
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    return f"<html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><div class=wrap><h1>{title}</h1>{body}{extra}</div><div id=comments><p>first!</p></div><footer>&copy; me</footer>" + ("</body></html>" if close else "")


def test_main_text(spark):
    pages = [(i, f"http://A.example/{i}", page(f"T{i}", [f"one {i} &amp;\n two", f"x<b>y</b>z {i}"], close=i % 2 == 0)) for i in range(8)]
    pages += [(100, None, None), (101, "", ""), (102, "http://b.example/", "plain text <b>only"), (103, "http://c.example/", "<article>In <i>it</i><script>no</script><p>more</article><p>out")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, host string")
    for limit in (1_000_000, 0):  # templates sent to all tasks, or met by host
        out = {r.page_id: r for r in html_template.extract_main(df, broadcast_tokens=limit).collect()}
        for i in range(8):
            assert out[i].text == f"T{i}\none {i} & two\nxyz {i}" and out[i].n_chars == len(out[i].text)
        assert [out[i].text for i in (100, 101, 102, 103)] == ["", "", "plain text only", "In it\nmore"]
    assert html_template.extract_main(df.limit(0)).count() == 0


def test_template_text_leaves_the_slot(spark):
    note = "<div class=x7>Follow us every day</div>"
    pages = [(i, f"http://a/{i}", f"<html><body><article><h1>T{i}</h1><p>one {i}</p>{note}<p>two {i}</p></article></body></html>") for i in range(6)]
    pages += [(i, f"http://m/{i}", f"<html><body><main><p>one {i}</p>{note}</main></body></html>") for i in range(10, 16)]
    pages += [(i, f"http://d/{i}", f"<html><body><div class=w><p>one {i}</p>{note}<p>two {i}</p></div></body></html>") for i in range(20, 26)]
    pages += [(i, f"http://copies/{i}", f"<html><body><article><p>all of it</p>{note}</article></body></html>") for i in range(30, 36)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_template.extract_main(df).collect()}
    assert [out[i] for i in range(6)] == [f"T{i}\none {i}\ntwo {i}" for i in range(6)]
    assert [out[i] for i in range(10, 16)] == [f"one {i}" for i in range(10, 16)]
    assert [out[i] for i in range(20, 26)] == [f"one {i}\ntwo {i}" for i in range(20, 26)]
    assert {out[i] for i in range(30, 36)} == {"all of it\nFollow us every day"}  # copies stay whole


def test_long_text_can_be_template(spark):
    legal = "All rights are reserved. " * 24
    body = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(6)]
    pages = [(i, f"http://a/{i}", f"<html><body><div class=q1><p>{body[i]}</p></div><div class=q2>{legal}</div></body></html>") for i in range(6)]
    out = html_template.extract_main(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(legal) == 600 and {r.page_id: r.text for r in out} == dict(enumerate(body))


def test_template_tokens_nest(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", page("Same", [f"p{i}"])) for i in range(6)], "page_id long, url string, html string")
    found = {r.host: set(r.template) for r in html_template.templates(pages).collect()}
    assert set(found) == {"h"} and len(found["h"]) > 8


def test_quality(spark):
    rng = random.Random(7)
    words = ["water", "stone", "light", "river", "house"]
    good = [prose(rng, 40, words) for _ in range(200)]
    bad = ["".join(rng.choice("xq#$%&@!zj") for _ in range(200)) for _ in range(20)]
    texts = [*good, *bad, None, ""]
    df = frame(spark, texts, lang=["en"] * 150 + [None] * 72, keep=["x"] * 222)
    out = {r.doc_id: r for r in quality_kn.quality(df, spark.range(100).withColumnRenamed("id", "doc_id")).collect()}
    assert np.mean([out[i].keep for i in range(200)]) > 0.97 and not any(out[i].keep for i in range(200, 222))
    assert out[220].perplexity is None
    assert quality_kn.quality(df, spark.range(0).withColumnRenamed("id", "doc_id")).where("keep").count() == 220
    assert quality_kn.quality(df.limit(0), spark.range(3).withColumnRenamed("id", "doc_id")).count() == 0


def test_pitman_yor(spark, texts):
    out = {r.doc_id: r for r in pitman_yor.score_texts(frame(spark, texts, block=["x"] * len(texts))).collect()}
    tokens = [[*WORD.findall(lower(t or "")), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = collections.Counter(w for i, t in enumerate(tokens) if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0
    assert pitman_yor.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = pitman_yor.score_texts(spark.createDataFrame([(None, None), (1, "a")], "doc_id long, text string"))
    assert {r.doc_id for r in one.collect()} == {None, 1}


def test_pitman_yor_rare_words_have_contexts(spark):
    """A pair of words far under 2e-5 of all tokens tells on the second one, as in a frequent context."""
    rng = random.Random(3)
    common_words = [f"w{i}" for i in range(50)]
    texts = [prose(rng, 1000, common_words) for _ in range(700)]
    for i in range(8):
        texts[i] += " quixo zantar"
        texts[i + 8] += " brevo lumint"
    asked = ["quixo zantar", "quixo lumint"]
    ids = [i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    trained = [i for i in range(9_000) if zlib.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    df = spark.createDataFrame([*zip(trained, texts), *zip(ids, asked)], "doc_id long, text string")
    out = {r.doc_id: r for r in pitman_yor.score_texts(df).where(F.col("doc_id") >= 10_000).collect()}
    assert out[ids[0]].train_tokens * 2e-5 > 8 and out[ids[0]].base_score == pytest.approx(out[ids[1]].base_score)
    assert out[ids[0]].score > out[ids[1]].score + 1


def test_mixing(spark):
    n = 4000
    df = spark.createDataFrame([(i, f"t{i}", "big" if i % 4 else "small") for i in range(n)], "doc_id long, text string, source string")
    out = poisson_mix.mix_sources(df, {"big": 1.0, "small": 3.0})
    by = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert by["small"] == pytest.approx(3000, rel=0.08) and by["big"] == pytest.approx(1000, rel=0.12)
    again = poisson_mix.mix_sources(df.repartition(7), {"big": 1.0, "small": 3.0})
    key = lambda x: sorted((r.doc_id, r["copy"]) for r in x.collect())
    assert key(out) == key(again)
    heavy = poisson_mix.mix_sources(df.where("doc_id < 40"), size=60.0).count()
    assert heavy == pytest.approx(2400, rel=0.1)
    assert poisson_mix.mix_sources(df, {"none": 1.0}).count() == 0 == poisson_mix.mix_sources(df.limit(0)).count()
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "x", "s")], "doc_id long, text string, source string").withColumn("copy", F.lit("c"))
    assert set(poisson_mix.mix_sources(odd, size=5.0).columns) == {"doc_id", "text", "source", "copy"}


def test_poisson_inverse(spark):
    u = [i / 500 + 0.001 for i in range(500)]
    df = spark.createDataFrame([(x, rate) for x in u for rate in (0.3, 4.0, 16.0)], "u double, rate double")
    got = df.withColumn("k", poisson_mix.poisson_inverse(F.col("rate"), F.col("u"), 84)).collect()
    for r in got:
        cdf, k, p = math.exp(-r.rate), 0, math.exp(-r.rate)
        while cdf <= r.u:
            k += 1
            p *= r.rate / k
            cdf += p
        assert r.k == k


def test_repeated_ids_take_linear_time_and_keep_links(spark, texts):
    """Two near texts under few ids, a thousand rows each."""
    rng = random.Random(8)
    a = prose(rng, 300, [f"v{i}" for i in range(200)])
    b = a.replace(a.split(" ")[5], "other", 1)
    rows = [(i % 3, t) for i in range(1000) for t in (a, b)] + [(9, "quite another text than these")]
    out = ngram_jaccard.join_classes(spark.createDataFrame(rows, "doc_id long, text string"), k=3, p=90, q=100)
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(0, 0), (1, 0), (2, 0), (9, 9)} and out.count() == 2001
