"""Main text of web pages by a tree-structured graphical model.

The model's variables are a page's block elements, each content or not. A node
has a potential from its own features (tag, class and id words, length of text,
share of text in links, punctuation); each parent and child share a potential
over their two states, by the kind of child. On a tree, one pass of sum-product
messages upward and one downward give exact marginals. The weights are trained
by gradient ascent on the likelihood of labelled pages: features observed less
features expected under the marginals.

Text of blocks with a marginal of 0.5 or more is the page's main text. Character
references are decoded, white space inside a block becomes one space, blocks are
joined in page order by a line break.

Defined cases: a null or empty html, or one without content, gives an empty
text; unclosed elements end with their parents; `<br>` is white space inside a
block; what follows an unclosed comment, script or style is part of it, while
other dropped elements that don't close drop only their tag; elements nested
deeper than MOST_DEPTH count to the one at that depth; pages are read whole.
Parsing takes time in proportion to the page.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshline.llm.common import exact, pieces, small_batches

TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
STOP = re.compile("[>\"']")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LABEL = re.compile(r'data-main="([01])"')
WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark noscript object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas stand inside their blocks.
INLINE |= frozenset("math annotation mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements without main text, dropped with all they hold: scripts, styles, parts of forms, graphics and what only shows where media can't be played. Those of RAW hold no elements.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
DROPPED = RAW | frozenset("template svg audio video canvas button select option optgroup datalist input".split())
#: Tags that are passed over; what they hold counts.
PASSED = frozenset(("head",))
#: Elements nested deeper than this count to the element at that depth.
MOST_DEPTH = 512
#: Start tags before which an open element of the named kinds ends.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html article section main div nav aside header footer".split())

TAGS = "html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th blockquote pre figure figcaption nav header footer aside form fieldset address details".split()
TAG_AT = {t: 1 + k for k, t in enumerate(TAGS)}
APART = frozenset("nav header footer aside form fieldset".split())
OTHER_TAG = 1 + len(TAGS)
LENGTHS = OTHER_TAG + 1  # 5 bins
LINKS = LENGTHS + 5  # 4 bins
PUNCTUATION = LINKS + 4  # sentence end, copyright, many bars
NAMES = PUNCTUATION + 3
NAME_SLOTS = 1024
SIZE = NAMES + NAME_SLOTS


class Page(NamedTuple):
    """parent[i] < i; features[i] are slots; kind[i] chooses the edge potential;
    blocks are (node, text) in page order; labels only in training pages."""

    parent: list[int]
    features: list[list[int]]
    kind: list[int]
    blocks: list[tuple[int, str]]
    labels: list[int]


class Source:
    """A page's characters, with what is learnt on the way, so that no stretch
    is searched twice for an end that isn't there."""

    def __init__(self, html: str):
        self.html, self.last_end = html, html.rfind(">")
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.astray: set[int] = set()  # quotes from which no way leads to the end of a tag
        self.matches: dict[str, dict[int, int] | list[tuple[int, int]]] = {}

    def tag_end(self, at: int) -> int:
        """The `>` of a tag whose attributes start at `at`: one outside quotes,
        or if quotes don't close, the first; -1 if none."""
        html, pos, met = self.html, at, []
        while m := STOP.search(html, pos):
            i, c = m.start(), m[0]
            if c == ">":
                return i
            if i in self.astray:
                break
            met.append(i)
            if i >= self.last_quote[c]:
                break
            pos = html.index(c, i + 1) + 1
        self.astray.update(met)
        return html.find(">", at)

    def after(self, name: str, start: int, at: int) -> int:
        """Where the dropped element ends whose tag spans `start` to `at`."""
        known = self.matches.get(name)
        if known is None:
            known = self.matches[name] = self.closers(name) if name in RAW else self.pairs(name)
        if name in RAW:
            k = bisect.bisect_left(known, (at, 0))
            if k < len(known):
                return known[k][1]
            follows = self.html.find("<", at) if name == "title" else -1  # an open title ends at the next tag
            return follows if follows >= 0 else len(self.html)
        return known.get(start, at)

    def closers(self, name: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.finditer(rf"</{name}\b[^>]*+>?", self.html, re.I)]

    def pairs(self, name: str) -> dict[int, int]:
        """Start of each element of this kind -> its end; open ones are left out."""
        found, held = {}, []
        for m in re.finditer(rf"<(/?){name}\b[^>]*+>?", self.html, re.I):
            if not m[1]:
                held.append(m.start())
            elif held:
                found[held.pop()] = m.end()
        return found


def parse(html: str) -> Page:
    tags, parent, attrs, text_size, link_size = ["html"], [-1], [""], [0], [0]
    stack, names = [0], ["html"]  # open block elements
    opened = Counter(names)
    runs: list[tuple[int, str]] = []
    run: list[str] = []
    links = 0  # open <a>

    def flush() -> None:
        if run:
            joined = " ".join("".join(run).split())
            run.clear()
            if joined:
                runs.append((stack[-1], joined))
                text_size[stack[-1]] += len(joined)

    def add(text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        run.append(text)
        if links:
            link_size[stack[-1]] += len(text.strip())

    def close(down_to: int) -> None:
        opened.subtract(names[down_to:])
        del names[down_to:], stack[down_to:]

    source, at, told, n = Source(html), 0, 0, len(html)  # told: where text not yet added starts
    while True:
        i = html.find("<", at)
        if i < 0:
            break
        if html.startswith("<!--", i):
            m, end = None, html.find("-->", i + 4)
            end = n if end < 0 else end + 3
        else:
            if i > source.last_end:  # no tag ends any more; a comment may begin
                at = html.find("<!--", i)
                if at < 0:
                    break
                continue
            m = TAG.match(html, i + 1)
            end = source.tag_end(m.end()) if m else html.find(">", i) if html[i + 1] in "!?/" else -1
            if end < 0:
                at = i + 1
                continue
            end += 1
        if i > told:
            add(html[told:i])
        at = told = end
        if not m:
            continue
        closing, name, rest = m[1], m[2].lower(), html[m.end() : end - 1]
        if name in PASSED:
            continue
        if closing:
            if name == "a":
                links = max(0, links - 1)
            elif name not in INLINE and opened[name] > 0:
                flush()
                k = len(names) - 1
                while names[k] != name and k > 0:
                    k -= 1
                close(max(1, k))
                links = 0
            continue
        if name in DROPPED:
            if name not in VOID and not rest.endswith("/"):
                at = told = source.after(name, i, end)
            run.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                links = 1
            elif name in ("br", "img", "wbr"):
                run.append(" " if name == "br" else "")
            continue
        flush()
        links = 0
        if name in VOID:
            continue
        if name in ("html", "body") and opened[name] > 0:
            continue
        ends = SIBLINGS.get(name) or (("p",) if name in ENDS_P else ())
        if any(opened[x] > 0 for x in ends):
            for k in range(len(names) - 1, 0, -1):
                if names[k] in ends:
                    close(k)
                    break
                if names[k] in SCOPES:
                    break
        if rest.endswith("/") and name not in TAG_AT or len(stack) > MOST_DEPTH:
            continue
        parent.append(stack[-1])
        tags.append(name)
        attrs.append(rest)
        text_size.append(0)
        link_size.append(0)
        stack.append(len(tags) - 1)
        names.append(name)
        opened[name] += 1
    if told < n:
        add(html[told:])
    flush()

    last: dict[int, str] = dict(runs)
    features, kind, labels = [], [], []
    for i, tag in enumerate(tags):
        f = [0, TAG_AT.get(tag, OTHER_TAG)]
        t, a = text_size[i], link_size[i]
        f.append(LENGTHS + (0 if not t else 1 if t < 25 else 2 if t < 80 else 3 if t < 300 else 4))
        if t:
            share = a / t
            f.append(LINKS + (0 if not a else 1 if share < 0.3 else 2 if share < 0.7 else 3))
            if last[i][-1] in ".!?…\"'»)":
                f.append(PUNCTUATION)
            if "©" in last[i]:
                f.append(PUNCTUATION + 1)
            if last[i].count(" | ") > 2:
                f.append(PUNCTUATION + 2)
        if attrs[i]:
            words = {w for m in NAMED.finditer(attrs[i]) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower())}
            f += [NAMES + zlib.crc32(w.encode()) % NAME_SLOTS for w in sorted(words)]
            mark = LABEL.search(attrs[i])
            labels.append(int(mark[1]) if mark else -1)
        else:
            labels.append(-1)
        features.append(f)
        kind.append(1 if tag in APART else 2 if tag in ("article", "main") else 3 if f[3:] and f[-1] >= NAMES else 0)
    return Page(parent, features, kind, runs, labels)


KINDS = 4


class Model(NamedTuple):
    """unary: log odds of content for each feature; edge[kind]: log potentials
    by parent's state (rows) and child's (columns)."""

    unary: np.ndarray
    edge: np.ndarray


def marginals(page: Page, unary: list[float], edge: list, want_edges: bool = False) -> tuple[list[float], list]:
    """Probability of content of each node by sum-product messages, leaves to
    root and back; potentials are kept as ratios to state 0 where they can be."""
    n, parent, kind = len(page.parent), page.parent, page.kind
    own = [float(np.exp(min(30.0, max(-30.0, sum([unary[k] for k in f]))))) for f in page.features]
    below = [[1.0, o] for o in own]  # potential times the messages from the children
    up = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        b0, b1 = below[i]
        e = edge[kind[i]]
        m0, m1 = b0 * e[0][0] + b1 * e[0][1], b0 * e[1][0] + b1 * e[1][1]
        s = m0 + m1
        up[i] = (m0 / s, m1 / s)
        p = below[parent[i]]
        p[0] *= up[i][0]
        p[1] *= up[i][1]
        s = p[0] + p[1]
        p[0] /= s
        p[1] /= s
    belief = [(0.0, 0.0)] * n
    s = below[0][0] + below[0][1]
    belief[0] = (below[0][0] / s, below[0][1] / s)
    pairs = []
    for i in range(1, n):
        q, u, e, (b0, b1) = belief[parent[i]], up[i], edge[kind[i]], below[i]
        r0, r1 = q[0] / max(u[0], 1e-300), q[1] / max(u[1], 1e-300)  # the parent's belief without this child
        j = (r0 * e[0][0] * b0, r0 * e[0][1] * b1, r1 * e[1][0] * b0, r1 * e[1][1] * b1)
        s = sum(j) or 1.0
        belief[i] = ((j[0] + j[2]) / s, (j[1] + j[3]) / s)
        if want_edges:
            pairs.append((kind[i], [x / s for x in j]))
    return [b[1] for b in belief], pairs


def train(pages: list[Page], steps: int = 150, rate: float = 0.5, decay: float = 0.0003) -> Model:
    unary, edge = np.zeros(SIZE), np.zeros((KINDS, 2, 2))
    seen_u, seen_e = np.full(SIZE, 1e-3), np.full((KINDS, 2, 2), 1e-3)
    total = sum(len(p.parent) for p in pages)
    for _ in range(steps):
        gu, ge = -decay * unary, -decay * edge
        u, e = unary.tolist(), np.exp(edge).tolist()
        for page in pages:
            p, pairs = marginals(page, u, e, True)
            y = page.labels
            for i, f in enumerate(page.features):
                gu[f] += (y[i] - p[i]) / total * 10
            for i, (kind, joint) in enumerate(pairs, 1):
                ge[kind] -= np.reshape(joint, (2, 2)) / total * 10
                ge[kind, y[page.parent[i]], y[i]] += 10 / total
        seen_u += gu**2
        seen_e += ge**2
        unary += rate * gu / np.sqrt(seen_u)
        edge += rate * ge / np.sqrt(seen_e)
    return Model(unary, edge)


def labelled_pages(n: int = 120, seed: int = 11) -> list[str]:
    """Labelled pages, drawn by rule: layouts of many kinds whose block elements
    carry data-main="1" (main text, or holding only such) or "0"."""
    rng = random.Random(seed)
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()

    def say(a: int, b: int) -> str:
        return " ".join(rng.choices(words, k=rng.randint(a, b))).capitalize()

    def el(tag: str, label: int, inner: str, names: str = "") -> str:
        attr = f' {rng.choice(["class", "id", "class"])}="{names}"' if names and rng.random() < 0.85 else ""
        return f'<{tag}{attr} data-main="{label}">{inner}</{tag}>'

    def link() -> str:
        return f'<a href="/{rng.choice(words)}">{say(1, 3)}</a>'

    def items(k: int) -> str:
        return "".join(el("li", 0, link()) for _ in range(k))

    def off() -> str:
        """A piece that is not main text."""
        kind = rng.randrange(12)
        if kind == 0:
            return el("nav", 0, el("ul", 0, items(rng.randint(2, 7))) if rng.random() < 0.7 else link() + " " + link(), rng.choice(["menu", "nav", "navbar", ""]))
        if kind == 1:
            return el("div", 0, say(3, 40) + "." if rng.random() < 0.6 else el("p", 0, say(4, 30) + "."), rng.choice(["ad", "ads", "advert", "banner", "sponsor", "promo", "advertisement"]))
        if kind == 2:
            return el("aside", 0, el("h3", 0, say(1, 3)) + el("ul", 0, items(rng.randint(2, 5))) + (el("p", 0, say(5, 30) + ".") if rng.random() < 0.5 else ""), rng.choice(["sidebar", "widget", "related", ""]))
        if kind == 3:
            return el("div", 0, el("p", 0, say(6, 25) + "."), rng.choice(["cookie notice", "cookie-banner", "consent", "notice", "alert", "gdpr"]))
        if kind == 4:
            return el("form", 0, say(1, 4) + " <input name=q> " + (el("p", 0, say(2, 12)) if rng.random() < 0.5 else ""), rng.choice(["search", "subscribe", "newsletter", "login", ""]))
        if kind == 5:
            comments = "".join(el(rng.choice(["div", "li"]), 0, el("p", 0, say(4, 40) + "."), rng.choice(["comment", "reply", ""])) for _ in range(rng.randint(1, 4)))
            return el(rng.choice(["div", "section"]), 0, el("h3", 0, "Comments") + comments, rng.choice(["comments", "comment-list", "responses", "discussion"]))
        if kind == 6:
            return el("header", 0, el("h1", 0, say(1, 3)) + (el("p", 0, say(3, 8)) if rng.random() < 0.5 else link()), rng.choice(["site-header", "masthead", "top", ""]))
        if kind == 7:
            return el("div", 0, el("ul", 0, items(rng.randint(2, 6))), rng.choice(["menu", "breadcrumbs", "breadcrumb", "share", "social", "tags", "related", "sidebar"]))
        if kind == 8:
            return el("footer", 0, "&copy; " + say(2, 20) + (el("p", 0, say(3, 30) + ".") if rng.random() < 0.4 else ""), rng.choice(["footer", "site-footer", ""]))
        if kind == 9:
            return el("div", 0, "&copy; " + say(2, 12), rng.choice(["footer", "copyright", "legal"]))
        if kind == 10:
            return el("section", 0, el("h2", 0, say(1, 3)) + "".join(el("p", 0, link()) for _ in range(3)), rng.choice(["related", "recommended", "more", "trending"]))
        return el("div", 0, link() + " " + link(), rng.choice(["meta", "share", "pagination", "pager", "byline"]))

    def block() -> str:
        kind = rng.randrange(10) if mixed else 0
        if kind < 5:
            body = (say(1, 5) if rng.random() < short else say(5, 80)) + ends
            return el("p", 1, body if rng.random() < 0.7 else f"<b>{body}</b> {link()}<br>" if rng.random() < 0.5 else f"<b>{body}<br>")
        if kind == 5:
            return el(rng.choice(["h2", "h3", "h4"]), 1, say(1, 8))
        if kind == 6:
            return el(rng.choice(["ul", "ol"]), 1, "".join(el("li", 1, say(2, 15) + rng.choice(["", "."])) for _ in range(rng.randint(2, 5))))
        if kind == 7:
            return el("blockquote", 1, el("p", 1, say(5, 40) + "."))
        if kind == 8:
            return el("table", 1, "".join(el("tr", 1, "".join(el("td", 1, say(1, 4)) for _ in range(3))) for _ in range(2)))
        return el(rng.choice(["pre", "div", "figure"]), 1, say(3, 30))

    pages = []
    for _ in range(n):
        mixed = rng.random() < 0.6  # else paragraphs only
        ends = rng.choice([".", ".", "", "!!", " |", "***", " &copy;"])  # a page's style
        short = rng.choice([0.1, 0.3, 0.95])
        title = el("h1", 1, say(2, 12))
        inner = (title if rng.random() < 0.8 else "") + "".join(block() for _ in range(rng.choice([1, 2, 4, 8, 20, 100])))
        if rng.random() < 0.35:  # some boilerplate stands inside the article
            inner += off()
        if rng.random() < 0.25:
            inner = el("header", 1, title) + "".join(block() for _ in range(3))
        tag, names = rng.choice([("article", ""), ("article", "post"), ("article", ""), ("article", "entry"), ("main", ""), ("div", "content"), ("div", "post-content"), ("div", "article-body"), ("div", "entry-content"), ("section", "story"), ("div", "main")])
        main = el(tag, 1, inner, names)
        if rng.random() < 0.3:
            main = el("div", 0, (off() if rng.random() < 0.5 else "") + main + (off() if rng.random() < 0.5 else ""), rng.choice(["container", "wrapper", "page", "row", ""]))
        body = "".join(off() for _ in range(rng.randint(1, 3))) + main + "".join(off() for _ in range(rng.randint(1, 3)))
        pages.append(f'<html><head><title>{say(2, 6)}</title></head><body data-main="0">{body}</body></html>')
    return pages


@functools.cache
def default_model() -> Model:
    """Trained on labelled_pages(), once for each driver process."""
    return fit(labelled_pages())


def fit(pages: list[str]) -> Model:
    """Train on labelled pages; an element without a label takes its parent's."""
    parsed = []
    for html in pages:
        page = parse(html)
        for i, y in enumerate(page.labels):
            if y < 0:
                page.labels[i] = page.labels[page.parent[i]] if i else 0
        parsed.append(page)
    return train(parsed)


class Extractor:
    def __init__(self, model: Model):
        self.unary, self.edge = model.unary.tolist(), np.exp(model.edge).tolist()

    def text(self, html: str | None) -> str:
        page = parse(html or "")
        if not page.blocks:
            return ""
        p, _ = marginals(page, self.unary, self.edge)
        return "\n".join(text for node, text in page.blocks if p[node] >= 0.5)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; one narrow pass."""
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(default_model() if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(held.value)
        for whole in batches:
            for batch in pieces(whole, 2):
                texts = [extractor.text(None if h is None else h.decode("utf-8", "replace")) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(exact(pages, "page_id").cast("long").alias("page_id"), exact(pages, "url").cast("string").alias("url"), exact(pages, "html").cast("binary").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
