"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

Tokens are tags with their path of open elements, and runs of text with theirs. Over all pages
of a host a token has an occurrence vector, how often it is on each page. Vectors are compared
by sums of hashes of (page, count), which add up in any order, so they are one partial
aggregation and no host's pages come together. Tokens of a host with equal vectors form a class;
classes on enough of the host's pages are valid. Valid classes nest: an element of a page belongs
to the template if its token is in a valid class and the element around it belongs to the
template, and so does a run of text inside such an element. That is the template; what is
between its tokens are the slots.

A page's main slot is the innermost template element that holds most of the text which isn't the
template's, a link's or of an element that its name gives away; an article or main element inside
it with half of that text goes before it. Blocks of the main slot whose text is all the template's
are left out. Names (of tags, classes, ids, roles) decide what template and amounts of text can't:
what in the main slot is a menu, notice, advert, form or reader comment, although it differs from page to page. A block
that mixes template text and other text stays whole, and so does a slot with four fifths of its text
from the template: pages that are copies of each other look like that. A host whose pages share no
token has one slot, the whole page.

A host with one page has no template, as nothing can repeat; there names and amounts of text decide.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import cut

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|select)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|[^<]+|<""", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: Elements that never hold main text.
DROPPED = frozenset("head header nav footer aside form button dialog menu".split())
#: Words in class, id or role that name what isn't main text.
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent newsletter comment comments respond reply replies disqus pagination pager complementary contentinfo masthead".split())
#: Words that name it too, unless the element holds half of the page's text or more.
PERHAPS = frozenset("promo promotion banner notice alert popup modal subscribe subscription signup login share sharing social related recommended toolbar widget search".split())
#: Elements of one block, which aren't slots.
SINGLE = frozenset("p li td th dt dd h1 h2 h3 h4 h5 h6 blockquote pre".split())
MAIN_NAMES = frozenset("article content main story post entry body text".split())
#: A slot with more than this share of its text on the host's other pages is a copy's.
COPIES = 0.8
SPACES = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "names", "path", "parent", "order", "dropped", "perhaps", "known")

    def __init__(self, tag: str, names: tuple, path: int, parent: "Element | None", order: int):
        self.tag, self.names, self.path, self.parent, self.order = tag, names, path, parent, order
        whole = tag in ("html", "body", "article", "main")
        self.dropped = parent is not None and parent.dropped or tag in DROPPED or not (whole or NAMES.isdisjoint(names))
        self.perhaps = not (whole or PERHAPS.isdisjoint(names))
        self.known = False  # whether it belongs to the template


def _path(parent: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), parent & 0xFFFFFFFFFFFFFFFF)


def parse(page: str) -> Iterator[tuple]:
    """("open", element) and ("text", element, text, block) in page order.

    Elements close at their end tag, at the end tag of one around them, and paragraphs also at
    the next block. `block` counts up at every start or end of a block element."""
    root = Element("", (), 0, None, 0)
    root.known = True
    stack, block, order = [root], 0, 0
    for m in TOKEN.finditer(page):
        s = m.group()
        if s[0] != "<" or s == "<":
            yield "text", stack[-1], s, block
            continue
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if not inline:
            block += 1
        if s[1] == "/":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if not inline and tag not in VOID:
            for i in range(len(stack) - 1, 0, -1):  # a paragraph ends here, with what is open in it
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        names = []
        for _, a, b, c in NAMED.findall(m.group(3)):
            names += [x.lower() for x in PART.findall(a or b or c)]
        parent = stack[-1]
        order += 1
        e = Element(tag, tuple(names), _path(parent.path, tag + "." + ".".join(names)), parent, order)
        yield "open", e
        if tag not in VOID and not m.group(3).rstrip().endswith("/"):
            stack.append(e)


def host_of(url: str | None) -> str:
    """The host part of a URL, in lower case; empty if there is none."""
    m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)", url or "", re.I)
    return m.group(1).rsplit("@", 1)[-1].lower() if m else ""


def occurrences(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """(host, token, parent, low, high, pages) summed over the pages of a batch; low and high are the halves of
    the vector's sum. Input: page key, url, html."""
    sums: dict = {}

    def flush() -> pa.RecordBatch:
        keys = list(sums)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([_signed(k[1]) for k in keys], pa.int64()), pa.array([_signed(k[2]) for k in keys], pa.int64()), pa.array([v[0] & 0xFFFFFFFF for v in sums.values()], pa.int64()), pa.array([v[0] >> 32 for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], ["host", "token", "parent", "low", "high", "pages"])
        sums.clear()
        return out

    for batch in batches:
        for page, url, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            host, count = host_of(url), Counter()
            for event in parse(text or ""):
                e = event[1]
                if event[0] == "open":
                    count[e.path, e.parent.path if e.parent else 0] += 1
                elif not event[2].isspace():
                    count[_path(e.path, "=" + event[2]), e.path] += 1
            for (token, parent), n in count.items():
                v = sums.setdefault((host, token, parent), [0, 0])
                v[0] = (v[0] + xxhash.xxh64_intdigest(f"{page} {n}")) & 0xFFFFFFFFFFFFFFFF
                v[1] += 1
            if len(sums) >= most:
                yield flush()
    if sums:
        yield flush()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def templates(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """(host, template): the tokens of the valid classes of each host with two pages or more, at most mean tokens a page / share.

    A class is valid on `share` of the pages, two at least; with one token it is so only on nearly every page."""
    key = F.xxhash64("page_id", "url", F.length("html")).alias("page")
    tokens = pages.select(key, "url", "html").mapInArrow(occurrences, "host string, token long, parent long, low long, high long, pages long")
    tokens = tokens.groupBy("host", "token", "parent").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("pages").alias("pages"))
    half = F.lit(0xFFFFFFFF)
    carried = (F.col("high") + F.shiftright("low", 32)).bitwiseAND(half)
    tokens = cut(tokens.select("host", "token", "parent", carried.alias("high"), F.col("low").bitwiseAND(half).alias("low"), "pages"))
    # The first page elements tell how many pages a host has.
    hosts = tokens.where("parent = 0").groupBy("host").agg(F.max("pages").alias("all"))
    often = tokens.join(hosts, "host").where((F.col("pages") >= share * F.col("all")) & (F.col("pages") >= 2))
    vector = ["host", "high", "low", "pages"]
    sizes = often.groupBy(*vector).agg(F.count("*").alias("size"))
    # A class of one token tells nothing unless the token is on nearly every page.
    valid = often.join(sizes, vector).where((F.col("size") > 1) | (F.col("pages") >= 0.9 * F.col("all")))
    found = valid.groupBy("host").agg(F.collect_set("token").alias("template"))
    return hosts.where("all >= 2").select("host").join(found, "host", "left").select("host", F.coalesce("template", F.array().cast("array<long>")).alias("template"))


def main_text(page: str, template: set[int] | None) -> str:
    """The blocks of the page's main slot; a template of None is that of a host with one page."""
    runs, amounts, elements, matched = [], Counter(), [], False
    for event in parse(page):
        e = event[1]
        if event[0] == "open":
            elements.append(e)
            if template and e.parent.known and e.path in template:
                e.known = matched = True
            continue
        text = html.unescape(event[2])
        static = bool(template) and e.known and _path(e.path, "=" + event[2]) in template
        runs.append((e, text, event[3], static))
        if not static and not any(up.tag == "a" for up in _with_above(e)):
            for up in _with_above(e):
                amounts[up] += len(text.strip())
    if template is not None and not matched:  # the pages share nothing, so the page is one slot
        return _lines([(text, block) for e, text, block, _ in runs if not any(up.tag == "head" for up in _with_above(e))])
    everything = max(amounts.values(), default=0)
    for e in elements:  # in page order, so from outside in
        e.dropped |= e.parent.dropped or e.perhaps and amounts[e] < 0.5 * everything
    parts = Counter()
    for e, text, _, static in runs:
        if not e.dropped and not static and not any(up.tag == "a" for up in _with_above(e)):
            for up in _with_above(e):
                parts[up] += len(text.strip())
    kept = [x for x in runs if not x[0].dropped]
    if not kept:
        return ""
    main = _main_slot(elements, parts, template is not None)
    slot = [(text, block, static) for e, text, block, static in kept if any(up in main for up in _with_above(e))]
    own = {block for text, block, static in slot if text.strip() and not static}
    shared = sum(len(text.strip()) for text, block, _ in slot if block not in own)
    copies = shared > COPIES * sum(len(text.strip()) for text, block, _ in slot)
    return _lines([(text, block) for text, block, _ in slot if copies or block in own])


def _main_slot(elements: list[Element], parts: Counter, templated: bool) -> set[Element | None]:
    """The elements whose text is the main slot's; the root stands for the whole page."""
    total = max(parts.values(), default=0)
    slots = [e for e in elements if not e.dropped and e.tag not in INLINE and e.tag not in SINGLE and (e.known or not templated)]
    named = [e for e in elements if e.tag in ("article", "main") and not e.dropped] or [e for e in elements if "main" in e.names and e.tag in ("div", "section") and not e.dropped]
    # Articles go before a main element that holds them.
    named = [e for e in named if e.tag == "article"] or named
    chosen = set(named)
    named = {e for e in named if not any(up in chosen for up in _with_above(e.parent))}
    if named and sum(parts[e] for e in named) >= 0.5 * total:
        return named
    most = [e for e in slots if total and parts[e] >= 0.8 * total]
    if most:
        return {max(most, key=lambda e: (not MAIN_NAMES.isdisjoint(e.names), e.order))} if not templated else {max(most, key=lambda e: e.order)}
    root = elements[0].parent if elements else None
    return named or {root}


def _lines(runs: list[tuple[str, int]]) -> str:
    """One line a block, white space as one space, empty ones left out."""
    blocks, last = [], None
    for text, block in runs:
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(text)
    lines = (SPACES.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def _with_above(e: Element | None) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.parent


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            known: dict[str, set[int] | None] = {}
            texts = []
            for page, host, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if host not in known:
                    known[host] = {x & 0xFFFFFFFFFFFFFFFF for x in t.as_py()} if t.is_valid else None
                texts.append(main_text(page or "", known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main(pages: DataFrame, share: float = 0.5, broadcast_tokens: int = 1_000_000) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null and empty html give an empty text; pages without a host share the template of the empty
    host. Repeated rows come back as often. Other columns aren't read."""
    pages = pages.select("page_id", "url", "html")
    found = cut(templates(pages, share))
    tokens = found.agg(F.sum(F.size("template"))).first()[0] or 0
    # Templates go to every task only when they are measured to be small; else pages and templates meet by host.
    side = F.broadcast(found) if tokens <= broadcast_tokens else found
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), r"^.*@", ""))
    joined = pages.withColumn("host", host).join(side, "host", "left").select("page_id", "url", "html", "host", "template")
    return joined.mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")
