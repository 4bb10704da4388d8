"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

A page is parsed into its block elements. Each gets features of its subtree (text and link
density, paragraphs), its attribute tokens and those above it, its depth and its siblings,
and boosted trees give the odds that it belongs to the article. The decoding keeps the set
of nodes with the greatest sum of log-odds in which no node is kept under a dropped one,
so an ancestor and a descendant never contradict each other.

The trees learn from a bounded sample of the given pages (``SAMPLE`` at most): the parts of
a page whose elements say what they are (article, nav, footer, ...) give texts of either
kind, and each page is also set again with those texts in other layouts, so that the model
does not depend on one site's markup.

Text: character references are decoded, white space inside a block becomes one space, the
blocks are joined in page order by one space.
Defined results: a missing or empty html has the empty text; html without elements is one
block of the body; a missing ``page_id`` or ``url`` is kept; repeated rows are extracted
alike, once each; other columns are ignored; without pages to learn from the layouts alone
teach the model.
"""

from __future__ import annotations

import html as references
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craquelure.llm import boosting
from craquelure.llm.common import by_batch, with_text

SAMPLE = 200
LAYOUTS = 3

# an attribute by the rules of HTML: a stray quote is a name, an unquoted value ends at a blank or ">";
# a quote that is never closed counts as unquoted. Nothing is given back, so a page is read in linear time
_VALUE = r"""(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+))"""
_NAMED = rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+{_VALUE})?+"
_ATTRIBUTE = re.compile(_NAMED)
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?|"
    r"<(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[\s/]++|" + _NAMED + r")*+)(?P<end>>?)",
    re.S,
)
_WORD = re.compile(r"[a-z]+")
# fixed values: how HTML treats its elements
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style title noscript template textarea svg math iframe object select option datalist".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol p pre section table ul".split()
)
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("ul ol dl table article section main body html".split())
_GROUPS = (
    ("p",),
    ("h1", "h2", "h3", "h4", "h5", "h6"),
    ("li", "dd", "dt"),
    ("ul", "ol", "dl"),
    ("div", "section"),
    ("article", "main"),
    ("nav", "menu"),
    ("header",),
    ("footer",),
    ("aside",),
    ("form", "fieldset", "button"),
    ("table", "tbody", "tr", "td", "th"),
    ("blockquote", "pre"),
    ("figure", "figcaption"),
)
# words in class, id and role attributes by what they tell
_SIGNS = (
    "article content post entry story main body text prose blog",
    "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs",
    "header masthead topbar branding logo head",
    "footer foot bottom copyright legal colophon contentinfo",
    "sidebar side aside widget rail complementary",
    "ad ads advert advertisement advertising promo sponsor sponsored banner",
    "comment comments reply replies disqus discussion respond reader feedback",
    "cookie consent notice gdpr alert popup modal overlay warning message notification",
    "form newsletter subscribe signup login search contact",
    "share social related recommended recommend more tags meta author byline hidden",
)
_SIGN_OF = {w: i for i, words in enumerate(_SIGNS) for w in words.split()}
_TAG_GROUP = {t: i for i, g in enumerate(_GROUPS) for t in g}


@dataclass
class Page:
    """Block elements in page order, and the text blocks with the element they stand in."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    signs: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def _signs(tag: str, attributes: str) -> tuple[int, int]:
    """Bits of the kinds of words in the telling attributes, and the label of a set layout (-1: none)."""
    bits, label = 0, -1
    if attributes and not attributes.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c)
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
                for w in _WORD.findall(value):
                    if w in _SIGN_OF:
                        bits |= 1 << _SIGN_OF[w]
            elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
                bits |= 1 << (len(_SIGNS) - 1)
            elif name == "data-y" and value in ("0", "1"):
                label = int(value)
    return bits, label


def parse(source: str) -> Page:
    page = Page(["body"], [-1], [0], [1])
    open_tags: list[tuple[str, int]] = [("body", 0)]
    pieces: list[str] = []
    opened = Counter()
    unclosed: set[str] = set()
    links, link_chars = 0, 0
    at, end = 0, len(source)

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.owner.append(open_tags[-1][1])
                page.text.append(text)
                page.linked.append(min(len(text), link_chars))
            pieces.clear()
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        text = references.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            link_chars += len(text)

    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        name = m["name"]
        # what the page's end cuts off is no text
        if name is None or not m["end"]:
            continue
        name = name.lower()
        if m["slash"]:
            if name == "a":
                links = max(0, links - 1)
            elif name not in _INLINE and name not in _VOID:
                _close(open_tags, opened, name, flush)
            continue
        if name in _HIDDEN:
            if not m["attributes"].rstrip().endswith("/") or name not in ("svg", "math"):
                closing = None
                if name not in unclosed:
                    closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
                if closing is None:
                    unclosed.add(name)
                at = closing.end() if closing else (end if name in ("script", "style", "textarea", "title") else at)
            continue
        if name == "a":
            links += 1
        if name in _INLINE:
            if name in ("br", "wbr", "img"):
                pieces.append(" " if name == "br" else "")
            continue
        flush()
        if name in _VOID or name in ("html", "body", "head"):
            continue
        if name in _CLOSES_P and opened["p"]:
            _close(open_tags, opened, "p", flush)
        for same in _SAME.get(name, ()):
            _close(open_tags, opened, same, flush, _SCOPE)
        links = 0
        bits, label = _signs(name, m["attributes"])
        above = open_tags[-1][1]
        page.tag.append(name)
        page.parent.append(above)
        page.signs.append(bits)
        page.label.append(page.label[above] if label < 0 else label)
        open_tags.append((name, len(page.tag) - 1))
        opened[name] += 1
    flush()
    return page


def _close(open_tags: list, opened: Counter, name: str, flush, scope: frozenset = frozenset()) -> None:
    """End the innermost open element of that name, and what is still open in it."""
    for i in range(len(open_tags) - 1, 0, -1) if opened[name] else ():
        if open_tags[i][0] == name:
            flush()
            opened.subtract(t for t, _ in open_tags[i:])
            del open_tags[i:]
            return
        if open_tags[i][0] in scope:
            return
    if not scope:
        flush()


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    parent = np.array(page.parent)
    chars, linked, marks, words, blocks = (np.zeros(n) for _ in range(5))
    for owner, text, link in zip(page.owner, page.text, page.linked):
        chars[owner] += len(text)
        linked[owner] += link
        marks[owner] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
        words[owner] += text.count(" ") + 1
        blocks[owner] += 1
    own = chars.copy()
    sums = np.stack([chars, linked, marks, words, blocks, np.ones(n), np.array([t == "p" for t in page.tag], float)], 1)
    depth, above, group_above = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    children: list[list[int]] = [[] for _ in range(n)]
    start = np.zeros(n)
    signs = page.signs
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | signs[p]
        group_above[i] = group_above[p] | (1 << _TAG_GROUP[page.tag[p]] if page.tag[p] in _TAG_GROUP else 0)
        children[p].append(i)
    for i in range(n - 1, 0, -1):
        sums[page.parent[i]] += sums[i]
    first_block = np.full(n, len(page.text), np.int64)
    for b in range(len(page.text) - 1, -1, -1):
        first_block[page.owner[b]] = b
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        first_block[p] = min(first_block[p], first_block[i])
    before = np.concatenate([[0.0], np.cumsum([len(t) for t in page.text])])
    total = max(1.0, sums[0, 0])
    start = before[np.minimum(first_block, len(page.text))] / total
    size, index, same, rank = np.ones(n), np.zeros(n), np.ones(n), np.zeros(n)
    for kids in children:
        if not kids:
            continue
        tags = [page.tag[k] for k in kids]
        most = max(sums[k, 0] for k in kids)
        for j, k in enumerate(kids):
            size[k], index[k] = len(kids), j / len(kids)
            rank[k] = sums[k, 0] / max(1.0, most)
        counts = Counter(tags)
        for k, t in zip(kids, tags):
            same[k] = counts[t] / len(tags)
    c = np.maximum(1.0, sums[:, 0])
    out = [
        np.log1p(sums[:, 0]),
        sums[:, 1] / c,
        sums[:, 2] / c,
        sums[:, 0] / sums[:, 5],
        sums[:, 3] / np.maximum(1.0, sums[:, 4]),
        sums[:, 6],
        sums[:, 0] / total,
        own / c,
        depth,
        np.log1p(size),
        index,
        same,
        rank,
        start,
        sums[parent, 1] / c[parent],
        sums[parent, 0] / total,
    ]
    group = np.array([_TAG_GROUP.get(t, -1) for t in page.tag])
    signs = np.array(signs)
    out += [group == g for g in range(len(_GROUPS))]
    out += [group_above >> g & 1 for g in range(len(_GROUPS))]
    out += [signs >> s & 1 for s in range(len(_SIGNS))]
    out += [above >> s & 1 for s in range(len(_SIGNS))]
    return np.stack(out, 1).astype(np.float64)


def decode(page: Page, logit: np.ndarray) -> np.ndarray:
    """Which nodes stay: the heaviest set that holds every kept node's parent; the body always stays."""
    weight = logit.copy()
    for i in range(len(weight) - 1, 0, -1):
        if weight[i] > 0:
            weight[page.parent[i]] += weight[i]
    kept = np.ones(len(weight), bool)
    for i in range(1, len(weight)):
        kept[i] = kept[page.parent[i]] and weight[i] > 0
    return kept


# -- what the trees learn from ---------------------------------------------------------------


def _parts(page: Page) -> tuple[list[str], list[str]]:
    """Texts of blocks that stand in an article, and of those in elements that say they are something else."""
    main, other = [], []
    wrong = [g for g, names in enumerate(_GROUPS) if names[0] in ("nav", "header", "footer", "aside", "form")]
    right = next(g for g, names in enumerate(_GROUPS) if names[0] == "article")
    kind = [0] * len(page.tag)
    for i, tag in enumerate(page.tag):
        inherited = kind[page.parent[i]] if i else 0
        g = _TAG_GROUP.get(tag, -1)
        own = 1 if g == right or page.signs[i] & 1 and g == _TAG_GROUP["div"] else 0
        if g in wrong or page.signs[i] >> 1:
            own = -1
        kind[i] = own if own and inherited >= 0 else inherited
    for owner, text in zip(page.owner, page.text):
        if kind[owner] > 0:
            main.append(text)
        elif kind[owner] < 0:
            other.append(text)
    return main, other


def _labelled_as_it_is(source: str) -> Page:
    """The page with the labels that its own elements give."""
    page = parse(source)
    wrong = {"nav", "footer", "aside", "form", "header"}
    for i in range(1, len(page.tag)):
        g = page.tag[i]
        p = page.parent[i]
        if g in ("article", "main"):
            page.label[i] = page.label[p]
        elif g in wrong or page.signs[i] >> 1:
            page.label[i] = 0
        else:
            page.label[i] = page.label[p]
    return page


def layout(main: list[str], other: list[str], r: random.Random) -> str:
    """A page of other markup with these texts; ``data-y`` tells which elements are the article."""
    e = references.escape
    words = " ".join(other or main or ["a few words"]).split()

    def few(low: int, high: int) -> str:
        n = r.randrange(low, high)
        k = r.randrange(max(1, len(words) - n))
        return e(" ".join(words[k : k + n]) or "words")

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{few(1, 4)}</a></li>' for i in range(n))

    def cls(*names: str) -> str:
        return r.choice(["", f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} x{r.randrange(9)}"'])

    def sentence() -> str:
        return e(r.choice(main)[: r.randrange(40, 400)]) if main and r.random() < 0.5 else few(4, 40)

    def menu() -> str:
        t = r.choice(["nav", "div", "header"])
        return f'<{t} data-y="0"{cls("menu", "nav", "navbar", "navigation")}><ul>{links(r.randrange(3, 12))}</ul></{t}>'

    def head() -> str:
        t = r.choice(["header", "div"])
        name = cls("header", "site-header", "masthead") if t == "header" else ' class="header"'
        return f'<{t} data-y="0"{name}><h1>{few(1, 5)}</h1><p>{few(3, 9)}</p></{t}>'

    def foot() -> str:
        t = r.choice(["footer", "footer", "div"])
        name = "" if t == "footer" and r.random() < 0.5 else f' class="{r.choice(["footer", "site-footer", "copyright"])}"'
        return f'<{t} data-y="0"{name}><p>&copy; {few(3, 12)}</p>{r.choice(["", "<ul>" + links(4) + "</ul>"])}</{t}>'

    def side() -> str:
        t = r.choice(["aside", "div"])
        name = cls("sidebar", "widget", "rail") if t == "aside" else ' class="sidebar"'
        return f'<{t} data-y="0"{name}><h3>{few(1, 4)}</h3><ul>{links(r.randrange(2, 7))}</ul><p>{sentence()}</p></{t}>'

    def notice() -> str:
        name = r.choice(["cookie-notice", "notice", "cookie-banner", "consent", "alert", "popup"])
        return f'<div data-y="0" class="{name}"><p>{sentence()}</p><button>{few(1, 2)}</button></div>'

    def advert() -> str:
        name = r.choice(["ad", "ads", "advert", "advertisement", "promo", "sponsored", "ad-slot"])
        t = r.choice(["div", "aside", "section", "p"])
        return f'<{t} data-y="0" class="{name}">{sentence()}</{t}>'

    def form() -> str:
        return f'<form data-y="0"{cls("newsletter", "subscribe", "search", "login")}><p>{few(3, 15)}</p><label>{few(1, 3)}</label><input name="q"><button>{few(1, 3)}</button></form>'

    def comments() -> str:
        t = r.choice(["section", "div"])
        one = lambda: f'<{r.choice(["div", "article"])} class="{r.choice(["comment", "reply"])}"><h4>{few(1, 3)}</h4><p>{sentence()}</p></div>'
        body = "".join(one().replace("</div>", "</article>") if o else one() for o in [0] * r.randrange(1, 6))
        name = r.choice(['class="comments"', 'id="comments"', 'class="comment-list"', 'class="reader-comments"'])
        return f'<{t} data-y="0" {name}><h2>{few(1, 3)}</h2>{body}</{t}>'

    def related() -> str:
        name = r.choice(["related", "share", "social-share", "tags", "recommended"])
        return f'<div data-y="0" class="{name}"><h3>{few(1, 4)}</h3><ul>{links(r.randrange(2, 6))}</ul></div>'

    paragraphs = [m for m in main for m in ([m] if r.random() < 0.7 else re.split(r"(?<=\.) ", m))] or [few(5, 60)]
    if r.random() < 0.3:
        paragraphs = [paragraphs[0][: r.randrange(20, 200)]]
    body = []
    if r.random() < 0.8:
        body.append(f"<h{r.choice('112')}>{e(paragraphs[0][:60])}</h1>")
    for p in paragraphs:
        kind = r.random()
        if kind < 0.8:
            body.append(f"<p>{e(p)}" + r.choice(["</p>", "</p>", "", "<br></p>"]))
        elif kind < 0.86:
            body.append(f"<blockquote><p>{e(p)}</p></blockquote>")
        elif kind < 0.92:
            body.append("<ul>" + "".join(f"<li>{e(x)}</li>" for x in re.split(r"(?<=\.) ", p)) + "</ul>")
        elif kind < 0.96:
            body.append(f"<h2>{e(p[:50])}</h2><p>{e(p)}</p>")
        else:
            body.append(f"<div>{e(p)}</div>")
        if r.random() < 0.08:
            body.append(r.choice([advert, related, form, side])())
    inside = "".join(body)
    wrapper = r.choice(
        ["article", "main", "article", 'div class="content"', 'div id="main"', 'div class="post entry-content"', 'section class="story"', "div", "section"]
    )
    inside = f'<{wrapper} data-y="1">{inside}</{wrapper.split()[0]}>'
    if r.random() < 0.4:
        inside = f'<{r.choice(["div", "main", "section"])} data-y="1">{inside}{r.choice([comments, related, side])() if r.random() < 0.5 else ""}</div>'
    before = [f() for f in r.sample([menu, head, notice, advert, form, side], r.randrange(1, 5))]
    after = [f() for f in r.sample([foot, comments, related, side, notice, form, advert], r.randrange(1, 5))]
    return "<html><body>" + "".join(before) + inside + "".join(after) + "</body></html>"


def learn(sources: list[str], *, layouts: int = LAYOUTS, seed: int = 11) -> boosting.Trees:
    """Trees from the pages and from their texts in other layouts."""
    r = random.Random(seed)
    pages = [_labelled_as_it_is(s) for s in sources]
    texts = [_parts(p) for p in pages] or [([], [])]
    pages += [parse(layout(*r.choice(texts), r)) for _ in range(layouts * max(len(sources), 25))]
    x = np.concatenate([features(p)[1:] for p in pages])
    y = np.concatenate([np.array(p.label[1:], float) for p in pages])
    return boosting.fit(x, y)


def fit(pages: DataFrame, *, sample: int = SAMPLE) -> boosting.Trees:
    """Trees from at most ``sample`` pages, chosen by a hash of their ids."""
    chosen = with_text(pages, "page_id", text="html").filter("html <> ''").select("page_id", "html")
    order = [F.xxhash64("page_id"), F.col("page_id"), F.xxhash64("html")]
    # only keys are ordered; the html of the chosen ones follows
    keys = chosen.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = chosen.join(F.broadcast(keys), "page_id").orderBy(*order).limit(sample).collect()
    return learn([r.html for r in rows])


def extract(pages: DataFrame, trees: boosting.Trees) -> DataFrame:
    """``page_id, url, text`` of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        parsed = [parse(s) for s in batch.column("html").to_pylist()]
        bounds = np.cumsum([0] + [len(p.tag) for p in parsed])
        logit = trees.logit(np.concatenate([features(p) for p in parsed]))
        texts = []
        for p, a, b in zip(parsed, bounds[:-1], bounds[1:]):
            kept = decode(p, logit[a:b])
            texts.append(" ".join(t for o, t in zip(p.owner, p.text) if kept[o]))
        return {"text": pa.array(texts, pa.string())}

    return by_batch(with_text(pages, "page_id", "url", text="html"), "text string", run, keep=("page_id", "url"))
