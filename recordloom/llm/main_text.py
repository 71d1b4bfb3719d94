"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree: block elements, and the runs of text between block
boundaries as leaves. Every node is content or not. Unary potentials come from
the node's tag, class, id and role words, those of its parent, its link share and,
for elements, the length of their text; edges have parent-child potentials, one table for
elements and one for text. Sum-product messages go from the leaves up and back
down, for all pages of a batch level by level, and give each node its content
marginal; text leaves of at least ``KEEP`` are the main text.

Training: pages of a bounded sample (``PAGES`` pages of at most ``PAGE_CHARS``
characters) that mark their article with an ``article`` or ``main`` element are
labelled by it: text inside is content, all other text is not. Each also gives
variants with other markup around and inside the article (other containers,
headers, sidebars, notices, forms, reader comments, link lists), labelled as
they are built, so that the model does not hang on one tag.

Text: contents of scripts, styles and the like are never read; character
references are decoded; white space inside a block becomes one space; blocks are
trimmed, empty ones dropped, the others joined by one line break in page order.

Edge cases: null or empty html and pages without content give an empty text;
unclosed and stray tags are closed or ignored as browsers do; an unclosed
comment or script ends the page; other elements that are not read end where
browsers end them (a head at the first tag or text that cannot stand in it, an
option at the next one, any of them with the element around it), and those whose
end tag never comes also at the next block; very long pages are read whole; repeated rows
get equal results; an empty table trains on the built-in variants alone.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import hash_bound, map_batches, texts
from recordloom.llm.crf import Adam

KEEP = 0.5
PAGES = 120
PAGE_CHARS = 50_000
ROUNDS = 120
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("script style noscript template head title textarea select option button iframe svg object audio video canvas".split())
RAW = frozenset("script style textarea title iframe noscript".split())
# What may stand in a head without ending it.
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
# Elements that keep end tags inside from reaching what is around them.
WALLS = frozenset("template object select".split())
CELLS = frozenset("caption tbody td tfoot th thead tr".split())
# Of the skipped elements, those that implied ends of p, li, dt and dd pass through.
THIN = frozenset("option svg audio video canvas".split())
# Start tags that end an unclosed svg around them.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A block that opens closes these open ones of its level.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table td th body article section div main".split())
# How a comment, a declaration or a tag begins.
_OPENING = re.compile(r"<(?:!--(?P<comment>)|(?P<odd>[!?])|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*))")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|data-keep|data-drop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|$)", re.IGNORECASE)
_NAME_WORDS = re.compile(r"[a-z]+")


class Page:
    """Nodes of one page in page order; parents come before their children."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.names: list[tuple[str, ...]] = []
        self.parents: list[int] = []
        self.texts: list[str | None] = []  # of leaves
        self.links: list[int] = []  # characters in links, of leaves
        self.marks: list[int] = []  # labels of training pages: 1 keep, -1 drop, 0 as the parent

    def add(self, tag: str, names: tuple[str, ...], parent: int, text: str | None = None, links: int = 0, mark: int = 0) -> int:
        self.tags.append(tag)
        self.names.append(names)
        self.parents.append(parent)
        self.texts.append(text)
        self.links.append(links)
        self.marks.append(mark)
        return len(self.tags) - 1


class Tags:
    """Where the tags of a source end; every character is passed a bounded number of times, whatever the source."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.ends: dict[int, int] = {}  # of places in a tag, outside of quotes, where it ends; -1 if nowhere
        self.last = {mark: source.rfind(mark) for mark in ">\"'"}

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag which goes on at ``at``, outside of quoted values, or -1."""
        passed = []
        while True:
            if at in self.ends:
                found = self.ends[at]
                break
            passed.append(at)
            special = _SPECIAL.search(self.source, at) if at <= self.last[">"] else None
            if special is None:
                found = -1
                break
            mark, place = special[0], special.start()
            if mark == ">":
                found = place
                break
            if place >= self.last[mark]:  # a value that is never closed
                found = -1
                break
            at = self.source.find(mark, place + 1) + 1
        self.ends.update(dict.fromkeys(passed, found))
        return found


class Skipped:
    """The open elements from the outermost one whose text is not read; nothing is skipped while there are none.

    Each is held if its own end tag comes.
    """

    def __init__(self, source: str) -> None:
        self.source = source
        self.open: list[tuple[str, bool]] = []
        self.ends: dict[str, set[int]] = {}  # of each name the start tags that have an end tag

    def _held(self, tag: str, at: int) -> bool:
        if tag not in self.ends:
            waiting, ended = [], set()
            for found in re.finditer(f"<(/?){tag}(?=[\\s/>])", self.source, re.IGNORECASE):
                if not found[1]:
                    if tag in ("button", "option", "select"):
                        waiting.clear()  # these end at the next of them
                    waiting.append(found.start())
                elif waiting:
                    ended.add(waiting.pop())
            self.ends[tag] = ended
        return at in self.ends[tag]

    def push(self, tag: str, at: int) -> None:
        self.open.append((tag, tag not in SKIPPED or self._held(tag, at)))

    def inside(self, *tags: str) -> bool:
        """Whether one of ``tags`` is open, with no wall after it."""
        for name, held in reversed(self.open):
            if name in tags:
                return True
            if held and name in WALLS:
                return False
        return False

    def close(self, tag: str) -> bool:
        """Apply an end tag; whether it is one of an element around the skipped ones."""
        for i in range(len(self.open) - 1, -1, -1):
            name, held = self.open[i]
            if name == tag:
                del self.open[i:]
                return False
            if held and (name in WALLS or (name == "button" and tag == "p")):
                return False
            if name == "head":
                return tag in ("body", "html")
            if tag not in BLOCKS and tag not in SKIPPED and (name in BLOCKS or name == "button"):
                return False
        return tag not in SKIPPED

    def start(self, tag: str, around: str, item: bool, cell: bool) -> None:
        """End what a start tag ends; ``around`` is the block around, which ends if it is an ``item`` or a ``cell``."""
        rows = self.open
        if tag == "body":
            rows.clear()  # a head that was never closed
        if rows and rows[-1][0] == "head" and tag not in HEAD:
            rows.pop()
        if rows and tag in ("option", "optgroup"):
            for name in ("option", "optgroup")[: 1 if tag == "option" else 2]:
                if rows and rows[-1][0] == name:
                    rows.pop()
        if tag in ("select", "input", "textarea") and any(name == "select" for name, _ in rows):
            self._through("select")
        if tag == "button" and self.inside("button"):
            self._through("button")
        if tag in BREAKOUT:
            while rows and next((name for name, _ in reversed(rows) if name in SKIPPED or name in ("foreignobject", "desc")), "") == "svg":
                self._through("svg")
        if tag in BLOCKS:
            while (last := next((i for i in range(len(rows) - 1, -1, -1) if rows[i][0] in SKIPPED), -1)) >= 0 and not rows[last][1] and rows[last][0] != "head":
                del rows[last:]
            if (around == "p" or item) and all(name in THIN or (name not in SKIPPED and name not in BLOCKS) for name, _ in rows):
                rows.clear()
            if cell and tag in CELLS and not self.inside("table", "template"):
                rows.clear()

    def _through(self, tag: str) -> None:
        while self.open.pop()[0] != tag:
            pass


def parse(source: str | None) -> Page:
    source, page = source or "", Page()
    stack = [page.add("#root", (), -1)]
    run: list[str] = []
    links = link_depth = 0
    skipped, tags = Skipped(source), Tags(source)
    opened: Counter[str] = Counter(["#root"])  # tags in the stack
    inline: Counter[tuple[int, str]] = Counter()  # open elements that are no blocks, by the block around

    def close_run() -> None:
        nonlocal links
        text = " ".join("".join(run).split())
        if text:
            page.add("#text", (), stack[-1], text, min(links, len(text)))
        run.clear()
        links = 0

    def said(raw: str) -> None:
        nonlocal links
        if skipped.open and skipped.open[-1][0] == "head" and raw.strip():
            skipped.open.pop()  # text ends a head
        if raw and not skipped.open:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if link_depth:
                links += len(text)

    def implied(tag: str) -> int:
        """Place in the stack of the open element that a start tag closes, 0 for none."""
        closes = CLOSES.get(tag, ())
        if not any(opened[name] for name in closes):
            return 0
        top = len(stack) - (page.tags[stack[-1]] == "p")
        for i in range(top - 1, 0, -1):
            if page.tags[stack[i]] in closes:
                return i
            if page.tags[stack[i]] in SCOPES:
                break
        return 0

    def cut(place: int) -> None:
        """Close all open blocks from this place of the stack on."""
        opened.subtract(page.tags[node] for node in stack[place:])
        del stack[place:]

    at, size = 0, len(source)
    while at < size:
        start = source.find("<", at)
        if start < 0:
            said(source[at:])
            break
        found = _OPENING.match(source, start)
        if found and found["comment"] is not None:
            said(source[at:start])
            end = source.find("-->", found.end())
            at = size if end < 0 else end + 3
            continue
        end = -1
        if found and found["odd"]:
            end = source.find(">", found.end()) if start < tags.last[">"] else -1
        elif found:
            end = tags.end(found.end())
        if end < 0:
            said(source[at : start + 1])
            at = start + 1
            continue
        said(source[at:start])
        at = end + 1
        if found["odd"]:
            continue
        rest = source[found.end() : end]
        tag, closing, empty = found["name"].lower(), found["end"] == "/", rest.endswith("/")
        if skipped.open:
            if closing:
                if not skipped.close(tag):
                    continue
                if tag in BLOCKS and opened[tag] > 0 or inline[stack[-1], tag] or tag in ("body", "html"):
                    skipped.open.clear()
            else:
                had = tag == "select" and skipped.inside("select")
                in_cell = tag in CELLS and any(opened[name] > 0 for name in ("td", "th", "caption"))
                skipped.start(tag, page.tags[stack[-1]], bool(implied(tag)), in_cell)
                if had:
                    continue
        if not closing and tag in RAW:
            if empty and skipped.inside("svg"):
                continue
            end = re.compile(f"</{tag}", re.IGNORECASE).search(source, at)
            at = size if not end else source.find(">", end.end()) + 1 or size
            continue
        if tag in SKIPPED:
            if not closing and not empty and (tag != "head" or not skipped.open):
                skipped.push(tag, start)
            continue
        if skipped.open:
            if not closing and not empty and tag not in VOID:
                skipped.push(tag, start)
            continue
        if tag == "a":
            link_depth = 0 if closing else 1
        elif tag == "br":
            said(" ")
        if tag not in BLOCKS:
            if closing:
                inline[stack[-1], tag] = max(0, inline[stack[-1], tag] - 1)
            elif not empty and tag not in VOID:
                inline[stack[-1], tag] += 1
            continue
        close_run()
        link_depth = 0
        if closing:
            if opened[tag] > 0:
                cut(next(i for i in range(len(stack) - 1, 0, -1) if page.tags[stack[i]] == tag))
            continue
        depth = implied(tag)
        if page.tags[stack[-1]] == "p":
            cut(len(stack) - 1)
        if depth:
            cut(depth)
        names, mark = [], 0
        for key, a, b, c in _ATTRIBUTE.findall(rest):
            if key.startswith("data-"):
                mark = 1 if key == "data-keep" else -1
            else:
                names += _NAME_WORDS.findall((a or b or c).lower())
        node = page.add(tag, tuple(dict.fromkeys(names)), stack[-1], mark=mark)
        if tag not in VOID:
            stack.append(node)
            opened[tag] += 1
    close_run()
    return page


def features(page: Page) -> list[list[str]]:
    """Names of the features of every node."""
    n = len(page.tags)
    size, linked = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        text = page.texts[i]
        if text is not None:
            size[i], linked[i] = len(text), page.links[i]
        if page.parents[i] >= 0:
            up = page.parents[i]
            size[up] += size[i]
            linked[up] += linked[i]
    out = []
    for i in range(n):
        up = page.parents[i]
        kind = "t" if page.texts[i] is not None else "e"
        own = [f"{kind}:bias", f"{kind}:link{round(4 * linked[i] / size[i]) if size[i] else 9}"]
        if kind == "e":
            own.append(f"size{min(size[i].bit_length(), 12) // 2}")
            own.append(f"tag:{page.tags[i]}")
            own += [f"name:{w}" for w in page.names[i]]
        if up >= 0:
            own.append(f"{kind}:in:{page.tags[up]}")
            own += [f"{kind}:in-name:{w}" for w in page.names[up]]
        out.append(own)
    return out


def labels(page: Page) -> np.ndarray:
    """1 for nodes inside a marked part, 0 else."""
    out = np.zeros(len(page.tags), np.int64)
    for i, mark in enumerate(page.marks):
        out[i] = 1 if mark > 0 else 0 if mark < 0 or i == 0 else out[page.parents[i]]
    return out


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


class Forest:
    """The trees of several pages, and message passing on all of them."""

    def __init__(self, pages: list[Page], index: dict[str, int]):
        sizes = [len(p.tags) for p in pages]
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        parents = np.array([x for p in pages for x in p.parents], np.int64)
        self.parents = np.where(parents < 0, -1, parents + base)
        self.leaf = np.array([t is not None for p in pages for t in p.texts], np.int64)
        depth = np.zeros(len(parents), np.int64)
        for i, up in enumerate(self.parents.tolist()):
            if up >= 0:
                depth[i] = depth[up] + 1
        self.levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth, minlength=1))[:-1])
        pairs = [(i, index[f]) for i, own in enumerate(f for p in pages for f in features(p)) for f in own if f in index]
        self.node, self.feature = np.array(pairs, np.int64).reshape(-1, 2).T

    def unary(self, weights: np.ndarray) -> np.ndarray:
        """Log potentials (nodes x 2); the label 0 has none."""
        out = np.zeros((len(self.parents), 2))
        out[:, 1] = np.bincount(self.node, weights[self.feature], len(self.parents))
        return out

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Content marginal of every node, and expected counts of (leaf or not, parent label, child label)."""
        below = self.unary(weights)
        upward = np.zeros_like(below)  # message of a node to its parent
        for own in self.levels[:0:-1]:
            table = edges[self.leaf[own]]
            upward[own] = _add(table[:, :, 0] + below[own, :1], table[:, :, 1] + below[own, 1:])
            np.add.at(below, self.parents[own], upward[own])
        total, expected = below.copy(), np.zeros((2, 2, 2))
        for own in self.levels[1:]:
            table, up = edges[self.leaf[own]], self.parents[own]
            rest = total[up] - upward[own]
            joint = rest[:, :, None] + table + below[own][:, None, :]
            downward = _add(rest[:, 0, None] + table[:, 0, :], rest[:, 1, None] + table[:, 1, :])
            total[own] = below[own] + downward
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            np.add.at(expected, self.leaf[own], joint)
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), expected


class Model:
    def __init__(self, names: list[str]):
        self.index = {name: i for i, name in enumerate(names)}
        self.weights, self.edges = np.zeros(len(names)), np.zeros((2, 2, 2))

    def extract(self, sources: list[str | None], keep: float = KEEP) -> list[str]:
        pages = [parse(s) for s in sources]
        if not pages:
            return []
        good = Forest(pages, self.index).marginals(self.weights, self.edges)[0]
        out, at = [], 0
        for page in pages:
            out.append("\n".join(t for i, t in enumerate(page.texts) if t is not None and good[at + i] >= keep))
            at += len(page.texts)
        return out


def train(sources: list[str], rounds: int = ROUNDS, decay: float = 1e-4) -> Model:
    """Fit on pages whose content is marked by data-keep and data-drop."""
    pages = [parse(s) for s in sources]
    model = Model(sorted({f for p in pages for own in features(p) for f in own}))
    forest = Forest(pages, model.index)
    gold = np.concatenate([labels(p) for p in pages])
    seen = np.zeros((2, 2, 2))
    child = np.flatnonzero(forest.parents >= 0)
    np.add.at(seen, (forest.leaf[child], gold[forest.parents[child]], gold[child]), 1)
    adam = Adam([model.weights, model.edges], 0.1)
    for _ in range(rounds):
        good, expected = forest.marginals(model.weights, model.edges)
        unary = np.bincount(forest.feature, (good - gold)[forest.node], len(model.weights)) / len(gold)
        adam.step([unary + decay * model.weights / 10, (expected - seen) / len(gold) + decay * model.edges])
    return model


# Variants of pages for training: containers of articles, and what stands around or inside them.
_CONTAINERS = ["article", "main", 'div class="content"', 'div id="main-content"', 'div class="post entry"', 'section class="article body"', 'div class="story text"', 'div role="main"']
_LINKED = ["nav", 'ul class="menu"', 'div class="navbar"', 'div class="breadcrumb"', 'div class="related links"', 'div class="share social"', 'ul class="tags"', 'div class="pagination"']
_SPOKEN = [
    "header", "footer", "aside", "form", 'div class="ad"', 'div class="ads sponsored"', 'div class="advert promo banner"', 'div class="sidebar"', 'div id="sidebar" class="widget"',
    'div class="cookie notice"', 'div class="notice consent"', 'div class="popup modal newsletter subscribe"', 'div class="header"', 'div id="footer"', 'div class="copyright legal"', 'section class="comments"',
    'div id="comments"', 'div class="comment reader"', 'ol class="comment list"', 'div class="login form search"',
]


def _variant(blocks: list[str], other: list[str], draw: random.Random) -> str:
    def words(n: int) -> str:
        return html.escape(" ".join(draw.choice(other).split()[:n])) or "more"

    def around(some: list[str], n: int) -> str:
        out = []
        for opening in draw.sample(some, n):
            tag = opening.split()[0]
            if some is _LINKED:
                items = "".join(f'<li><a href="/x">{words(draw.randint(1, 3))}</a></li>' for _ in range(draw.randint(2, 6)))
                inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
            else:
                inner = "".join(draw.choice(["<p>{}</p>", "{}", "<div>{}</div>", "<h3>{}</h3>"]).format(words(draw.choice([3, 12, 40]))) for _ in range(draw.randint(1, 3)))
            out.append(f"<{opening} data-drop>{inner}</{tag}>")
        return "".join(out)

    opening = draw.choice(_CONTAINERS)
    title, *rest = blocks or [words(6)]
    body = [f"<h1>{html.escape(title)}</h1>"]
    for block in rest:
        body.append(draw.choice(["<p>{}</p>"] * 6 + ["<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<p><a href='/y'>{}</a></p>", "<div>{}</div>"]).format(html.escape(block)))
        if draw.random() < 0.1:
            body.append(around(draw.choice([_SPOKEN, _LINKED]), 1))
    inside = "".join(body)
    article = f"<{opening} data-keep>{inside}</{opening.split()[0]}>"
    if draw.random() < 0.3:
        article = f'<div class="wrapper container">{article}</div>'
    return f"<html><body>{around(_LINKED, 1)}{around(_SPOKEN, 2)}{article}{around(_SPOKEN, 2)}{around(_LINKED, draw.randint(0, 1))}</body></html>"


def labelled(sources: list[str], seed: int = 0, variants: int = 3) -> list[str]:
    """Training pages: those that mark their article, and variants of them."""
    draw, out, articles, others = random.Random(seed), [], [], ["More to read here today.", "Home", "All rights reserved 2024."]
    for source in sources:
        marked = re.sub(r"<(article|main)\b", r"<\1 data-keep", source, flags=re.IGNORECASE)
        marked = re.sub(r"<(nav|aside|form|footer)\b", r"<\1 data-drop", marked, flags=re.IGNORECASE)
        page = parse(marked)
        if 1 not in page.marks:
            continue
        out.append(marked)
        good = labels(page)
        articles.append([t for t, g in zip(page.texts, good, strict=True) if t and g])
        others += [t for t, g in zip(page.texts, good, strict=True) if t and not g]
    articles = articles or [["A title", "First words of a text, and some more of them.", "Short.", "The end of the text is here."]] * 60
    # What people write around an article is text like any other: the words are no sign.
    others += [draw.choice(draw.choice(articles) or ["Words."]) for _ in range(len(others))]
    return out + [_variant(blocks, others, draw) for blocks in articles for _ in range(variants)]


def fit(pages: DataFrame, most: int = PAGES, page_chars: int = PAGE_CHARS) -> Model:
    """Train on a sample of ``pages`` bounded by the parameters."""
    return train(labelled(sample(pages, most, page_chars)))


def sample(pages: DataFrame, most: int = PAGES, page_chars: int = PAGE_CHARS) -> list[str]:
    """The ``most`` different pages of at most ``page_chars`` characters with the lowest hashes; copies count once."""
    short = pages.where(F.length("html").between(1, page_chars)).select("html", F.xxhash64("html").alias("_draw"))
    bound = hash_bound(most, short.agg(F.approx_count_distinct("_draw")).first()[0])
    rows = short.where(F.col("_draw") <= F.lit(bound)).groupBy("_draw").agg(F.first("html").alias("html")).orderBy("_draw").limit(most)
    return [r["html"] for r in rows.collect()]


def extract(pages: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep``, text and n_chars of every page."""

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        found: dict[str, list] = defaultdict(list)
        for at in range(0, batch.num_rows, 64):
            for text in model.extract(texts(batch.slice(at, 64), "html")):
                found["text"].append(text)
                found["n_chars"].append(len(text))
        return found if batch.num_rows else {"text": [], "n_chars": []}

    added = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_batches(pages.select(*dict.fromkeys([*keep, "html"])), step, added, keep)


def main_text(pages: DataFrame, keep: list[str]) -> DataFrame:
    return extract(pages, fit(pages), keep)
