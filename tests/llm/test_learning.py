"""What the learned operators may learn from, their optimum, and their odd cases."""

import random
import zlib

import numpy as np

from meterloom.llm import language_id, pitman_yor, toxicity


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def held(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_learn_nothing_from_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, "abcde" if i % 2 else "defgh", 20), "aa" if i % 2 else "bb") for i in range(200)]
    other = [(i, prose(rng, "xyz", 9), "cc") if held(i, 4, 2) else (i, t, x) for i, t, x in rows]
    a, b = (language_id.fit(docs(spark, x)) for x in (rows, other))
    assert a.langs == b.langs == ["aa", "bb"]
    assert np.array_equal(a.table, b.table) and np.array_equal(a.allowed, b.allowed)
    changed = language_id.fit(docs(spark, [(i, t, x) if held(i, 4, 2) else (i, t, "cc") for i, t, x in rows]))
    assert changed.langs == ["cc"]


def test_languages_of_odd_tables(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, "abcde" if i % 2 else "mnopq", 20), "aa" if i % 2 else "bb") for i in range(100)]
    model = language_id.fit(docs(spark, rows))
    long = prose(rng, "abcde", 30000)
    odd = spark.createDataFrame([(1, long, "s", 1), (1, long, "s", 1), (None, "mnop qonm", "s", 2), (2, "", "s", 3), (3, "123 -", "s", 4), (4, None, None, None)], "doc_id long, text string, spans string, score int")
    out = sorted(language_id.identify(odd, spans=True, model=model).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.lang_pred) for r in out] == [(1, "aa"), (1, "aa"), (2, "und"), (3, "und"), (4, "und"), (None, "bb")]
    assert out[0] == out[1] and out[0].score == 1.0 and [s.lang for s in out[0].spans] == ["aa"]
    assert [r.score for r in out[2:5]] == [0.0] * 3 and [r.spans for r in out[2:5]] == [[]] * 3
    empty = language_id.identify(odd.limit(0), spans=True, model=model)
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "lang_pred", "score", "spans"]


def test_viterbi_over_many_languages():
    rng = np.random.default_rng(3)
    s, penalty = rng.normal(size=(40, 300)).astype(np.float32), 1.5
    s[:, 290] += 2.5
    value, back = s[0].astype(float), []
    for row in s[1:]:
        ways = value[None, :] - penalty * (1 - np.eye(300))  # to, from
        back.append(ways.argmax(axis=1))
        value = ways.max(axis=1) + row
    best = [int(value.argmax())]
    for step in reversed(back):
        best.append(int(step[best[-1]]))
    assert language_id.viterbi(s, np.array([40]), penalty).tolist() == best[::-1]
    assert max(best) > 255


def test_toxicity_learns_no_held_out_labels(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, "abcde", 12) + (" zorky" if i % 6 == 0 else ""), "aa") for i in range(300)]
    labels = [(i, int(i % 6 == 0)) for i in range(300)]
    other = [(i, 1 - y) if held(i, 5, 0) else (i, y) for i, y in labels]
    df = docs(spark, rows)
    a, b = (toxicity.fit(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, other))
    assert len(a[0]) and all(np.array_equal(x, y) for x, y in zip(a, b))


def test_non_negative_risk_against_a_grid():
    rng = np.random.default_rng(5)
    positive = np.arange(900) < 300
    toxic = positive | (rng.random(900) < 0.2)
    has = np.where(toxic, rng.random(900) < 0.8, rng.random(900) < 0.1)
    prior = 0.2

    def risk(w, b):
        z = w * has + b
        plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)
        return prior * plus[positive].mean() + max(0.0, minus[~positive].mean() - prior * minus[positive].mean())

    doc = np.flatnonzero(has).astype(np.int32)
    w, b = toxicity.nn_pu(doc, np.zeros(len(doc), np.int64), positive, 1, prior)
    best = min(risk(x, y) for x in np.linspace(-2, 8, 101) for y in np.linspace(-8, 2, 101))
    assert risk(w[0], b) <= best * 1.02


def test_pitman_yor_learns_nothing_from_held_out_texts(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, "ab", 15), "aa") for i in range(60)]
    other = [(i, "entirely other words", "aa") if held(i, 7, 2) else (i, t, x) for i, t, x in rows]
    a, b = ({r.doc_id: (r.train_tokens, r.base_score) for r in pitman_yor.score_texts(docs(spark, x), folds=7, held=2).collect()} for x in (rows, other))
    kept = [i for i in a if not held(i, 7, 2)]
    assert kept and all(a[i] == b[i] for i in kept)
