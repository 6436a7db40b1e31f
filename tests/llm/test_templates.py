"""The template deduction against a plain one, and what decides the main slot."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from meterloom.llm import html_template as op


def deduce(pages):
    """Template tokens by host from whole occurrence vectors, one page at a time."""
    vectors, n = defaultdict(lambda: defaultdict(dict)), Counter()
    for i, url, text in pages:
        host, count = op.host_of(url), Counter()
        n[host] += 1
        for event in op.parse(text or ""):
            e = event[1]
            if event[0] == "open":
                count[e.path] += 1
            elif not event[2].isspace():
                count[op._path(e.path, "=" + event[2])] += 1
        for token, times in count.items():
            vectors[host][token][i] = times
    out = {}
    for host, by_token in vectors.items():
        classes = defaultdict(list)
        for token, vector in by_token.items():
            if len(vector) >= max(2, 0.5 * n[host]):
                classes[tuple(sorted(vector.items()))].append(token)
        if n[host] >= 2:
            out[host] = {t for v, tokens in classes.items() if len(tokens) > 1 or len(v) >= 0.9 * n[host] for t in tokens}
    return out


def site(rng, host, i):
    side = "".join(f"<li><a href=/{k}>{rng.choice('abcdef')}</a></li>" for k in range(rng.randrange(4)))
    body = "".join(f"<p>{' '.join(rng.choice(['lorem', 'ipsum', 'dolor', 'sit']) for _ in range(rng.randrange(1, 30)))} {i}</p>" for _ in range(rng.randrange(1, 5)))
    more = f"<div class=u{rng.randrange(2)}><p>seen by {rng.randrange(3)}</p></div>" if rng.random() < 0.5 else ""
    return f"<html><body><div class=top><ul>{side}</ul></div><div class=mid><h1>T {i}</h1>{body}{more}<div>Call {host} now</div></div><div class=low>Made by {host}</div></body></html>"


def test_classes_against_whole_vectors(spark):
    rng, pages = random.Random(3), []
    for host, n in (("a.x", 9), ("b.x", 4), ("c.x", 2), ("d.x", 1), ("", 3)):
        for _ in range(n):
            i = len(pages)
            pages.append((i, f"http://{host}/{i}" if host else None, site(rng, host, i)))
    pages.append((90, "http://a.x/90", None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: {t & 0xFFFFFFFFFFFFFFFF for t in r.template} for r in op.templates(df).collect()}
    want = deduce([p for p in pages if p[2] is not None])
    assert got == want and set(want) == {"a.x", "b.x", "c.x", ""}
    out = {r.page_id: r.text for r in op.extract_main(df).collect()}
    assert out == {i: op.main_text(text or "", want.get(op.host_of(url))) for i, url, text in pages}
    # The template decides: neither the repeated call, nor the foot, nor the links are in any slot, and names say nothing of them.
    for i, url, _ in pages[:13]:
        assert out[i].startswith(f"T {i}\n") and "Call" not in out[i] and "Made" not in out[i]
    assert sum(op.main_text(text, set()) != out[i] for i, _, text in pages[:15]) == 15


def test_names_leave_main_text_alone():
    text = " ".join(["word"] * 50)
    assert op.main_text(f"<body><div class='search related'><p>{text}</p></div><div class=alert>Careful</div></body>", None) == text
    assert op.main_text(f"<article><header>By me</header><h1>T</h1><p>{text}</p><div class=comments><p>{text} {text} {text}</p></div></article>", None) == f"T\n{text}"


def test_paragraphs_close_at_any_depth():
    deep = "<b>" * 40 + "a" + "<p>b"
    assert op.main_text(f"<article><p>{deep}</article>", None) == "a\nb"


def test_repeated_rows_and_long_texts(spark):
    long = "long words " * 60_000
    page = f"<html><body><article><h1>T</h1><p>{long}</p></article></body></html>"
    df = spark.createDataFrame([(1, "http://h/1", page)] * 3 + [(2, "http://h/2", page.replace(">T<", ">U<"))], "page_id long, url string, html string")
    out = [(r.page_id, r.text, r.n_chars) for r in op.extract_main(df).collect()]
    assert sorted(out) == sorted([(1, f"T\n{long.strip()}", len(long) + 1)] * 3 + [(2, f"U\n{long.strip()}", len(long) + 1)])
