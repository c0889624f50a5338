"""HTML main-text extraction by a tree-structured graphical model.

A page is parsed to its tree. Each element is a variable with two states, boilerplate and content: its tag, its own class and id
words, its text and its links give a unary potential, and each pair of parent and child a potential of their two states and of
whether the child's tag opens a region of its own. Sum-product messages go up the tree and down again and give each element's
marginal, with the whole page taken into account: a paragraph is content where its article is and boilerplate where its aside is.
The weights maximise the likelihood of labelled pages; its gradient is the features under the labels less the features under the
marginals, so training and extraction run the same two sweeps.

The labelled pages are made here, from a grammar of page layouts with known content; the model is trained once on the driver from
a fixed seed and sent to the workers.

Text comes out of every element that is content, with character references decoded, white space inside a block as one space and
blocks joined by one space in page order. Scripts, styles, templates, comments and the head are markup, not text.

Cases: a null, empty or text-less html gives the empty text; unclosed and stray tags are placed as browsers do for the usual
elements (p, li, td, tr, option, dt, dd close themselves; what can't be in a head ends it; a block ends an open button, select or
svg); plain text without tags is one block of content; the tree is walked without recursion and stray end tags are told by counts of
what is open, so neither depth nor length matters; names of classes that no feature knows say nothing; repeated rows give equal
texts, an empty table an empty result; columns named like a result are replaced, others pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.session import free_name

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title svg iframe object select option textarea button".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr"
    " html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes before it, up to the nearest of the tags that hold it.
CLOSES = {
    "p": ({"p"}, {"div", "article", "section", "body", "td", "li", "aside", "blockquote", "main", "footer", "header", "nav", "form"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
}
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("head html title base link meta script style noscript template".split())
#: Hidden elements that a block inside them shows to be unclosed.
BROKEN_BY_BLOCKS = frozenset("button select option svg".split())
_ENDS_P = BLOCK - {"br", "body", "html", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption"}
_SPACE = re.compile(r"[\s ]+")
_NAME_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    chars: int = 0
    linked: int = 0
    children: int = 0


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)
    #: (node, text) in page order; node -1 - k marks the edge of block element k.
    runs: list[tuple[int, str]] = field(default_factory=list)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters, and those in links, of each node with all below it."""
        chars, linked = np.array([x.chars for x in self.nodes], float), np.array([x.linked for x in self.nodes], float)
        for i in range(len(self.nodes) - 1, 0, -1):  # children come after their parents
            p = self.nodes[i].parent
            chars[p] += chars[i]
            linked[p] += linked[i]
        return chars, linked


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = Tree([Node("#page", -1)])
        self.stack = [0]
        self.open: Counter[str] = Counter()
        self.hidden = 0
        self.links = 0

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            i = self.stack.pop()
            tag = self.tree.nodes[i].tag
            self.open[tag] -= 1
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
            if tag in BLOCK:
                self.tree.runs.append((-1 - i, ""))

    def _find(self, tags: set[str] | frozenset[str], stop: set[str]) -> int:
        """Depth of the nearest open element of these tags; 0 if a stop is nearer."""
        if not any(self.open[t] > 0 for t in tags):
            return 0
        for d in range(len(self.stack) - 1, 0, -1):
            tag = self.tree.nodes[self.stack[d]].tag
            if tag in tags:
                return d
            if tag in stop:
                return 0
        return 0

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD and (d := self._find({"head"}, set())):
            self._close(d)
        if tag in BLOCK and self.hidden:
            while d := self._find(BROKEN_BY_BLOCKS, {"script", "style", "template", "noscript", "iframe", "object"}):
                self._close(d)
        if tag in _ENDS_P and (d := self._find({"p"}, CLOSES["p"][1])):
            self._close(d)
        if tag in CLOSES:
            while d := self._find(*CLOSES[tag]):
                self._close(d)
        nodes = self.tree.nodes
        words = [w for k, v in attrs if k in ("class", "id", "role") and v for w in _NAME_WORD.findall(v.lower())]
        nodes.append(Node(tag, self.stack[-1], tuple(dict.fromkeys(words))))
        nodes[self.stack[-1]].children += 1
        if tag in BLOCK:
            self.tree.runs.append((-len(nodes), ""))
        if tag not in VOID:
            self.stack.append(len(nodes) - 1)
            self.open[tag] += 1
            self.hidden += tag in HIDDEN
            self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.tree.nodes[self.stack[-1]].tag == tag:
            self._close(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if self.open[tag] <= 0:
            return
        for d in range(len(self.stack) - 1, 0, -1):
            if self.tree.nodes[self.stack[d]].tag == tag:
                self._close(d)
                return

    def handle_data(self, data):
        if self.tree.nodes[self.stack[-1]].tag == "head" and data.strip():
            self._close(len(self.stack) - 1)
        if self.hidden <= 0 and data:
            i = self.stack[-1]
            n = len(data) - data.count(" ") - data.count("\n")
            self.tree.nodes[i].chars += n
            self.tree.nodes[i].linked += n if self.links else 0
            self.tree.runs.append((i, data))


def parse(html: str) -> Tree:
    b = _Builder()
    b.feed(html)
    b.close()
    b._close(1)
    return b.tree


#: Tags and words of class, id and role that have a weight of their own; fixed vocabulary of the features.
TAGS = (
    "article main section div p h1 h2 h3 h4 ul ol li table td th tr blockquote pre code figure figcaption span b i em strong a br nav aside header"
    " footer form input label img hr body html dl dd dt small time address details summary dialog menu"
).split()
NAME_WORDS = (
    "article content main post entry story text body nav navbar menu sidebar side footer header masthead banner ad ads advert advertisement promo"
    " sponsor sponsored cookie consent notice alert popup modal newsletter subscribe signup comment comments reply respond discussion share social"
    " related recommended breadcrumb breadcrumbs widget toolbar login search form pagination pager tags meta author byline copyright legal disclaimer gdpr"
).split()
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
_WORD_AT = {w: len(TAGS) + k for k, w in enumerate(NAME_WORDS)}
_SHAPE = len(TAGS) + len(NAME_WORDS)
N_FEATURES = _SHAPE + 8
#: Tags whose children may differ from what is around them.
REGIONS = frozenset("article main section div nav aside header footer form dialog details menu body ul ol table".split())


#: Tags that say something by themselves though they follow what is around them.
TELLING = frozenset("#page html h1 label input small address time".split())


def features(t: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features (row, column, value) of the nodes that speak for themselves.

    A paragraph or a list item doesn't: it follows its parent, and hundreds of them must not outvote what their region says.
    """
    chars, linked = t.sums()
    row, col, val = [], [], []

    def put(i: int, c: int, v: float = 1.0) -> None:
        row.append(i)
        col.append(c)
        val.append(v)

    kinds = _edge_kind(t, chars).tolist()
    for i, x in enumerate(t.nodes):
        if kinds[i] in (0, 3) and x.tag not in TELLING:
            continue
        if (c := _TAG_AT.get(x.tag)) is not None:
            put(i, c)
        for w in x.names:
            if (c := _WORD_AT.get(w)) is not None:
                put(i, c)
        put(i, _SHAPE)
        density = linked[i] / chars[i] if chars[i] else 0.0
        put(i, _SHAPE + 1, density)
        if density > 0.5 and x.tag != "a":
            put(i, _SHAPE + 2)
        put(i, _SHAPE + 3, min(np.log1p(chars[i]) / 8, 1.5))
        if not chars[i]:
            put(i, _SHAPE + 4)
        if x.parent < 0:
            put(i, _SHAPE + 5)
    return np.array(row), np.array(col), np.array(val)


#: Elements that, without a telling name and with all of their parent's text, are its wrapping: they are what it is.
PLAIN = frozenset("div section".split())


def _edge_kind(t: Tree, chars: np.ndarray | None = None) -> np.ndarray:
    """0: follows its parent; 1, 2: a region, a telling name, or both; 3: a plain wrapping."""
    chars = t.sums()[0] if chars is None else chars
    named = [any(w in _WORD_AT for w in x.names) for x in t.nodes]
    wraps = [x.tag in PLAIN and not k and x.parent >= 0 and c == chars[x.parent] > 0 for x, k, c in zip(t.nodes, named, chars)]
    return np.array([3 if w else (x.tag in REGIONS) + k for x, k, w in zip(t.nodes, named, wraps)])


#: The page as a whole is content: what it holds is told against that.
ROOT = 30.0


@dataclass
class TreeModel:
    unary: np.ndarray  # one weight a feature, for the state content
    edge: np.ndarray  # edge kind x parent state x child state; the last kind's isn't learned

    def potentials(self, t: Tree) -> tuple[np.ndarray, np.ndarray]:
        row, col, val = features(t)
        on = np.bincount(row, weights=self.unary[col] * val, minlength=len(t.nodes))
        on[0] += ROOT
        return on, _edge_kind(t)

    def marginals(self, t: Tree, with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """P(content) of each node, P(parent state, child state) of each edge above a node if asked for, and the log partition sum."""
        on, kind = self.potentials(t)
        n = len(t.nodes)
        edge = self.edge.tolist()
        kinds, ons = kind.tolist(), on.tolist()
        parents = [x.parent for x in t.nodes]
        # Upward: what each node's subtree says to its parent, for the parent's two states; scores are logs.
        below = [[0.0, v] for v in ons]
        up = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            e, (b0, b1) = edge[kinds[i]], below[i]
            up[i] = (_add(e[0][0] + b0, e[0][1] + b1), _add(e[1][0] + b0, e[1][1] + b1))
            mine = below[parents[i]]
            mine[0] += up[i][0]
            mine[1] += up[i][1]
        z = _add(*below[0])
        # Downward: what the rest of the tree says to each node.
        content, pairs = np.zeros(n), np.zeros((n if with_pairs else 0, 2, 2))
        above = [(0.0, 0.0)] * n
        content[0] = np.exp(below[0][1] - z)
        for i in range(1, n):
            p, e = parents[i], edge[kinds[i]]
            rest0, rest1 = above[p][0] + below[p][0] - up[i][0], above[p][1] + below[p][1] - up[i][1]
            above[i] = (_add(rest0 + e[0][0], rest1 + e[1][0]), _add(rest0 + e[0][1], rest1 + e[1][1]))
            content[i] = _sigmoid(above[i][1] + below[i][1] - above[i][0] - below[i][0])
            if not with_pairs:
                continue
            s = ((rest0 + e[0][0] + below[i][0], rest0 + e[0][1] + below[i][1]), (rest1 + e[1][0] + below[i][0], rest1 + e[1][1] + below[i][1]))
            pairs[i] = np.exp(np.array(s) - z)
        return content, pairs, z


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    m = a if a > b else b
    return m + math.log1p(math.exp(-abs(a - b))) if abs(a - b) < 40 else m


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def text_of(t: Tree, content: np.ndarray, cut: float = 0.5) -> str:
    blocks, part = [], []
    for i, s in (*t.runs, (-1, "")):
        if i < 0:
            if part and (block := _SPACE.sub(" ", "".join(part)).strip()):
                blocks.append(block)
            part = []
        elif content[i] >= cut:
            part.append(s)
    return " ".join(blocks)


def extract(html: str | None, model: TreeModel) -> str:
    if not html:
        return ""
    t = parse(html)
    return text_of(t, model.marginals(t)[0])


#: Pages that the model is trained on, sweeps over them, and the seed they are drawn from.
TRAINING_PAGES, SWEEPS, SEED = 320, 48, 20240607


def _labelled(html: str) -> tuple[Tree, np.ndarray]:
    labels: list[int] = [1]

    class Marked(_Builder):
        def handle_starttag(self, tag, attrs):
            super().handle_starttag(tag, attrs)
            labels.append(int(dict(attrs).get("data-y", 0)))

    b = Marked()
    b.feed(html)
    b.close()
    b._close(1)
    return b.tree, np.array(labels)


def train(pages: int = TRAINING_PAGES, sweeps: int = SWEEPS, seed: int = SEED, families: Sequence[str] | None = None) -> TreeModel:
    """Penalised maximum likelihood by adaptive gradient steps; the same weights on every run."""
    from brindle.llm.html_pages import FAMILIES, PageGrammar

    grammar = PageGrammar(seed, families or FAMILIES)
    data = []
    for _ in range(pages):
        t, y = _labelled(grammar.page())
        row, col, val = features(t)
        kind, up = _edge_kind(t), np.array([max(x.parent, 0) for x in t.nodes])
        told = np.bincount(col, weights=val * y[row], minlength=N_FEATURES)
        pairs = np.zeros((4, 2, 2))
        np.add.at(pairs, (kind[1:], y[up[1:]], y[1:]), 1.0)
        data.append((t, row, col, val, kind, told, pairs))
    model = TreeModel(np.zeros(N_FEATURES), np.zeros((4, 2, 2)))
    model.edge[3] = ((ROOT / 2, -ROOT / 2), (-ROOT / 2, ROOT / 2))
    seen_u, seen_e = np.full(N_FEATURES, 1e-6), np.full((4, 2, 2), 1e-6)
    for s in range(sweeps):
        for t, row, col, val, kind, told, pairs in data[s % 4 :: 4]:
            content, both, _ = model.marginals(t, with_pairs=True)
            u = told - np.bincount(col, weights=val * content[row], minlength=N_FEATURES) - 2e-3 * model.unary
            e = pairs.copy()
            np.add.at(e, kind[1:], -both[1:])
            e -= 2e-3 * model.edge
            e[3] = 0
            e[0] = (e[0] + e[0][::-1, ::-1]) / 2  # what only follows its parent leans to neither state
            seen_u += u * u
            seen_e += e * e
            model.unary += 0.5 * u / np.sqrt(seen_u)
            model.edge += 0.5 * e / np.sqrt(seen_e)
    return model


def block_scores(model: TreeModel, pages: Iterable[str]) -> tuple[float, float]:
    """Precision and recall of the characters of content on pages whose elements carry data-y."""
    right = told = there = 0
    for html in pages:
        t, y = _labelled(html)
        got = model.marginals(t)[0] >= 0.5
        n = np.array([x.chars for x in t.nodes])
        right, told, there = right + n[got & (y == 1)].sum(), told + n[got].sum(), there + n[y == 1].sum()
    return float(right / max(told, 1)), float(right / max(there, 1))


_MODEL: list[TreeModel] = []


def default_model() -> TreeModel:
    """The trained model, made once a process."""
    if not _MODEL:
        _MODEL.append(train())
    return _MODEL[0]


def main_text(html: Column, model: TreeModel) -> Column:
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extract(h, model) for h in pages], dtype="object")

    return run(F.coalesce(html.cast("string"), F.lit("")))


def extract_pages(pages: DataFrame, model: TreeModel | None = None, html: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars (its code points)."""
    made = free_name(pages, "_main")
    out = pages.withColumn(made, main_text(F.col(html), model or default_model())).drop("text", "n_chars", html)
    return out.withColumnRenamed(made, "text").withColumn("n_chars", F.length("text").cast("long"))
