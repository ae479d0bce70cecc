"""Main text of web pages by a tree-structured graphical model.

Every block element and every run of text of a page is a node with a label, content or not. Unary
potentials weigh a node's features, pairwise potentials join it to its parent; on a tree, one pass of
messages upward and one downward give the exact marginals. The weights are trained by the likelihood of
labelled pages, whose gradient the same messages give. Pages are independent: a task passes the
messages of many pages at once, level by level.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import steps, table
from turnmill.llm.html_tree import Tree, name_words, parse
from turnmill.llm.registry import query

#: Labelled pages to train on, steps and rate of the training, and the weight of the prior.
PAGES, ROUNDS, RATE, PRIOR = 600, 150, 0.2, 0.0005
#: Kinds of edges with a table of potentials each: the child is text or an element, in a list, else.
EDGES = 4
_LISTS = frozenset(["ul", "ol", "dl", "menu", "table", "tr", "tbody", "nav"])
_WIDE = ("#page", "html", "body")


#: What names and tags sites give to the parts that are not main text.
PARTS = {
    "header": ("header header div", "header masthead site-header topbar banner logo brand branding"),
    "nav": ("nav nav ul div", "nav menu navigation navbar main-menu breadcrumb pagination pager toc-nav"),
    "notice": ("div section aside p", "notice cookie-notice cookie consent gdpr alert privacy-banner message warning popup modal overlay paywall"),
    "advert": ("div div aside section", "ad ads advert advertisement sponsor sponsored promo promotion adsbox banner-ad teaser-ad"),
    "sidebar": ("aside aside div section", "sidebar side-bar aside widget related related-posts popular trending recommended more-stories rail"),
    "form": ("form form form div", "newsletter subscribe search login signup contact form subscription"),
    "comments": ("section div ol ul", "comments comment-list discussion responses replies comment-section reader-comments user-comments disqus"),
    "share": ("div ul p", "share social share-buttons social-links follow sharing tools"),
    "footer": ("footer footer div", "footer site-footer copyright legal bottom colophon imprint"),
}
MAIN = ("article article article main div section", "article post entry story content body main text article-body post-content entry-content main-content page-content")
PLAIN = "wrap wrapper container inner outer row col box grid page layout block clear left right center flex"
#: Names that a wrapper of everything may have though they sound like a part.
SOUNDS = "has-sidebar no-sidebar with-header header-fixed page-with-nav comments-open"
#: Words of names that mean a part, beside those of PARTS, and words of both that mean none by themselves.
ALSO = "adsense adsbygoogle outbrain taboola dfp skyscraper comment reply review guestbook complementary contentinfo navigation toolbar sitemap disclaimer"
VAGUE = "site main list section post story more side user reader links button box message bottom text legal contact tool"


def _words_of(names: str) -> frozenset[str]:
    return frozenset(w for name in names.split() for w in name_words(name))


PART_TAGS = frozenset(["header", "nav", "aside", "form", "footer"])
PART_WORDS = _words_of(" ".join(names for _, names in PARTS.values()) + " " + ALSO) - _words_of(VAGUE)


def _size(n: int) -> int:
    return next((i for i, most in enumerate((0, 2, 5, 10, 20, 50, 200)) if n <= most), 7)


def _share(part: int, whole: int) -> int:
    return 0 if not part else min(3, 1 + 3 * part // max(whole, 1))


def features(tree: Tree) -> list[list[str]]:
    """Names of each node's features.

    A run of text has its length, its share of links, how it ends, its element, and the elements and
    the words of class, id and role around it. An element has its own, and length and links of all
    text below it.
    """
    n = len(tree.parent)
    words = [len(t.split()) if t else 0 for t in tree.text]
    chars = [len(t) if t else 0 for t in tree.text]
    linked = list(tree.linked)
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        words[p] += words[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
    around: list[frozenset[str]] = [frozenset()] * n
    out: list[list[str]] = []
    for i in range(n):
        p, tag, text = tree.parent[i], tree.tag[i], tree.text[i]
        outer = around[p] if p >= 0 else frozenset()
        if text is None:
            if tag in _WIDE:
                own: set[str] = set()
            else:
                own = {f"in <{tag}>", *(f"in {w}" for w in tree.names[i])}
                if tag in PART_TAGS or tree.names[i] & PART_WORDS:
                    own.add("in a part")
            around[i] = outer if own <= outer else outer | own
            out.append(
                ["element", f"<{tag}>", f"size {_size(words[i])}", f"links {_share(linked[i], chars[i])}"]
                + [f"named {w}" for w in tree.names[i]]
                + ["a part"] * (tag in PART_TAGS or bool(tree.names[i] & PART_WORDS))
            )
        else:
            last = text[-1]
            end = "stop" if last in ".!?…。！？\"'”»)" else "open" if last in ":;," else "mark" if not last.isalnum() else "word"
            out.append(
                ["text", f"of <{tree.tag[p]}>", f"long {_size(words[i])}", f"ends {end}", f"link {_share(linked[i], chars[i])}"]
                + sorted(outer)
            )
    return out


def edges(tree: Tree) -> np.ndarray:
    """The kind of each node's edge to its parent."""
    return np.array(
        [2 * (t is not None) + (p >= 0 and tree.tag[p] in _LISTS) for t, p in zip(tree.text, tree.parent, strict=True)]
    )


@dataclass
class Forest:
    """Nodes of many pages: parents (-1 for pages), levels, kinds of edges, and features as two lists
    of (node, feature number)."""

    parent: np.ndarray
    depth: np.ndarray
    edge: np.ndarray
    node: np.ndarray
    feature: np.ndarray

    def levels(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        return np.split(order, cuts)


def forest(trees: list[Tree], numbers: dict[str, int]) -> Forest:
    """All nodes of the trees; features without a number are unknown and don't count."""
    parent, depth, edge, node, feature, base = [], [], [], [], [], 0
    for tree in trees:
        p = np.array(tree.parent)
        parent.append(np.where(p >= 0, p + base, -1))
        depth.append(np.array(tree.depth))
        edge.append(edges(tree))
        for i, names in enumerate(features(tree)):
            for name in names:
                number = numbers.get(name)
                if number is not None:
                    node.append(base + i)
                    feature.append(number)
        base += len(p)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, int)
    return Forest(join(parent), join(depth), join(edge), np.array(node, int), np.array(feature, int))


def marginals(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of every node, and P(parent's label, own label) (nodes x 2 x 2, 0 for pages).

    unary: how much content weighs more than not, by node. pair: edge kinds x parent's label x label.
    """
    n = len(f.parent)
    up = np.zeros((n, 2))  # evidence of a node and all below it, by its label
    up[:, 1] = unary
    message = np.zeros((n, 2))  # of that, by the parent's label
    levels = f.levels()
    for nodes in reversed(levels[1:]):
        inner = pair[f.edge[nodes]] + up[nodes][:, None, :]
        message[nodes] = np.logaddexp(inner[:, :, 0], inner[:, :, 1])
        np.add.at(up, f.parent[nodes], message[nodes])
    down = np.zeros((n, 2))  # evidence of all the rest of the page, by a node's label
    joint = np.zeros((n, 2, 2))
    for nodes in levels[1:]:
        p = f.parent[nodes]
        rest = (up[p] + down[p] - message[nodes])[:, :, None] + pair[f.edge[nodes]]
        down[nodes] = np.logaddexp(rest[:, 0, :], rest[:, 1, :])
        both = rest + up[nodes][:, None, :]
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        joint[nodes] = both / both.sum(axis=(1, 2), keepdims=True)
    belief = up + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


@dataclass
class Model:
    numbers: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray

    def content(self, trees: list[Tree]) -> np.ndarray:
        """P(content) of all nodes of the trees, one after the other."""
        f = forest(trees, self.numbers)
        unary = np.bincount(f.node, self.weights[f.feature], minlength=len(f.parent))
        return marginals(f, unary, self.pair)[0]


def train(labelled: list[tuple[Tree, np.ndarray]], rounds: int = ROUNDS) -> Model:
    """The weights that make the labels of the pages likeliest, under a normal prior.

    labelled: trees, and 0 or 1 for each of their nodes. The gradient is what the labels show less what
    the marginals expect; Adam takes the steps.
    """
    trees = [t for t, _ in labelled]
    truth = np.concatenate([y for _, y in labelled]).astype(int)
    numbers: dict[str, int] = {}
    for tree in trees:
        for names in features(tree):
            for name in names:
                numbers.setdefault(name, len(numbers))
    f = forest(trees, numbers)
    inner = np.flatnonzero(f.parent >= 0)
    seen_pair = np.zeros((EDGES, 2, 2))
    np.add.at(seen_pair, (f.edge[inner], truth[f.parent[inner]], truth[inner]), 1)
    weights, k = np.zeros(len(numbers) + EDGES * 4), len(numbers)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        pair = weights[k:].reshape(EDGES, 2, 2)
        unary = np.bincount(f.node, weights[:k][f.feature], minlength=len(truth))
        p, joint = marginals(f, unary, pair)
        gap = np.bincount(f.feature, (truth - p)[f.node], minlength=k)
        expected = np.zeros((EDGES, 2, 2))
        np.add.at(expected, f.edge[inner], joint[inner])
        gradient = np.r_[gap, (seen_pair - expected).ravel()] / len(trees) - PRIOR * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights = weights + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(numbers, weights[:k], weights[k:].reshape(EDGES, 2, 2))


class PageWriter:
    """Labelled pages: markup of many habits around made-up words, and what of it is the main text.

    A part is written with a tag and names that sites use for it, or where a tag alone says it without
    names; plain words and names that say nothing are mixed in, so that no single sign decides.
    """

    def __init__(self, seed: int):
        self.rnd = random.Random(seed)
        self.html: list[str] = []
        self.labels: list[tuple[str, int]] = []

    def word(self) -> str:
        return "".join(self.rnd.choice(["ba", "do", "ri", "én", "stu", "la", "ke", "or", "ß", "12", "the", "no"]) for _ in range(self.rnd.randint(1, 4)))

    def words(self, low: int, high: int, end: str = "") -> str:
        said = " ".join(self.word() for _ in range(self.rnd.randint(low, high))) + end
        return said[0].upper() + said[1:]

    def sentences(self, n: int) -> str:
        return " ".join(self.words(2, 18, self.rnd.choice([".", ".", ".", "!", "?", ""])) for _ in range(n))

    def line(self, text: str, label: int, links: float = 0) -> None:
        """A run of text, of which so many words are links."""
        self.labels.append((text, label))
        out = [escape(w, quote=False) for w in text.split(" ")]
        if links >= 1:
            out = ['<a href="/x">' + " ".join(out) + "</a>"]
        else:
            out = [f'<a href="#">{w}</a>' if self.rnd.random() < links else f"<em>{w}</em>" if self.rnd.random() < 0.02 else w for w in out]
        self.html.append(" ".join(out))

    def block(self, tag: str, text: str, label: int, links: float = 0) -> None:
        self.html.append(f"<{tag}>")
        self.line(text, label, links)
        self.html.append(f"</{tag}>")

    def open(self, tag: str, names: str = "", named: float = 1.0) -> str:
        said = [self.rnd.choice(names.split())] if names and self.rnd.random() < named else []
        said += [self.rnd.choice(PLAIN.split())] * (self.rnd.random() < 0.3)
        key = self.rnd.choice(["class", "class", "id"])
        self.html.append(f'<{tag} {key}="{" ".join(said)}">' if said else f"<{tag}>")
        return f"</{tag}>"

    def links(self, n: int, label: int = 0) -> None:
        self.html.append("<ul>")
        for _ in range(n):
            self.block("li", self.words(1, 8), label, 1)
        self.html.append("</ul>")

    def part(self, kind: str) -> None:
        tags, names = PARTS[kind]
        tag = self.rnd.choice(tags.split())
        telling = tag in ("header", "nav", "aside", "form", "footer")
        close = self.open(tag, names, 0.6 if telling else 1.0)
        rnd = self.rnd
        inner = "li" if tag in ("ul", "ol") else "p"
        if tag == "p":
            self.line(self.sentences(rnd.randint(1, 3)), 0, rnd.choice([0, 0.1, 1]))
        elif kind in ("nav", "share"):
            if inner == "li" or rnd.random() < 0.3:
                for _ in range(rnd.randint(1, 7)):
                    self.block("li" if inner == "li" else "div", self.words(1, 3), 0, 1)
            elif rnd.random() < 0.8:
                self.links(rnd.randint(2, 9))
            else:
                self.block("p", self.sentences(rnd.randint(1, 2)), 0)
        elif kind == "comments":
            self.block(rnd.choice(["h2", "h3", "li"] if inner == "li" else ["h2", "h3", "p"]), self.words(1, 4), 0)
            for _ in range(rnd.randint(1, 8)):
                end = self.open(rnd.choice(["div", "article", "li"]) if inner != "li" else "li", "comment reply response comment-body", 0.6)
                self.block(rnd.choice(["h4", "p", "div"]), self.words(1, 4), 0, rnd.choice([0, 1]))
                for _ in range(rnd.randint(1, 4)):
                    self.block("p", self.sentences(rnd.randint(1, 7)), 0, rnd.choice([0, 0, 0.05]))
                self.html.append(end)
        elif kind == "sidebar":
            if rnd.random() < 0.7:
                self.block(rnd.choice(["h2", "h3", "h4"]), self.words(1, 5), 0)
            if rnd.random() < 0.6:
                self.links(rnd.randint(2, 8))
            else:
                for _ in range(rnd.randint(1, 4)):
                    self.block("p", self.sentences(rnd.randint(1, 4)), 0, rnd.choice([0, 0.1]))
        elif kind == "form":
            for _ in range(rnd.randint(1, 3)):
                self.block(rnd.choice(["p", "div"]), self.words(1, 14, rnd.choice(["", ".", ":"])), 0)
            self.html.append('<input name="q"><button>Go on</button>')
        else:
            if kind == "header" and rnd.random() < 0.5:
                self.block(rnd.choice(["h1", "div"]), self.words(1, 4), 0, rnd.choice([0, 1]))
            for _ in range(rnd.randint(1, 3)):
                if rnd.random() < 0.6:
                    self.block(inner if inner == "li" else rnd.choice(["p", "div", "p"]), self.sentences(rnd.randint(1, 4)), 0, rnd.choice([0, 0, 0.2]))
                elif inner == "li" or rnd.random() < 0.5:
                    self.block("li" if inner == "li" else "p", self.words(1, 9), 0, rnd.choice([0, 1]))
                else:
                    self.links(rnd.randint(1, 6))
        self.html.append(close)

    def body(self) -> None:
        """The main text's blocks, with other parts now and then in between."""
        rnd = self.rnd
        if rnd.random() < 0.85:
            self.block(rnd.choice(["h1", "h1", "h2"]), self.words(1, 12, rnd.choice(["", "", "."])), 1)
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 30])):
            kind = rnd.random()
            if kind < 0.6:
                self.block("p", self.sentences(rnd.choice([1, 1, 2, 4, 9])), 1, rnd.choice([0, 0, 0, 0.03, 0.2]))
            elif kind < 0.68:
                self.block("p", self.words(1, 4, rnd.choice([".", "", ":", "%%%", "###"])), 1, rnd.choice([0, 0, 0, 1]))
            elif kind < 0.75:
                self.block(rnd.choice(["h2", "h3", "h4"]), self.words(1, 9), 1)
            elif kind < 0.82:
                self.html.append(tag := rnd.choice(["<ul>", "<ol>"]))
                for _ in range(rnd.randint(1, 6)):
                    self.block("li", self.words(1, 25, rnd.choice(["", "."])), 1, rnd.choice([0, 0, 0.1]))
                self.html.append(tag.replace("<", "</"))
            elif kind < 0.86:
                self.html.append("<blockquote>")
                self.block("p", self.sentences(rnd.randint(1, 4)), 1)
                self.html.append("</blockquote>")
            elif kind < 0.89:
                self.block("pre", self.words(1, 30), 1)
            elif kind < 0.92:
                self.html.append("<figure><img src=x>")
                self.block("figcaption", self.words(2, 14, rnd.choice(["", "."])), 1)
                self.html.append("</figure>")
            elif kind < 0.95:
                self.html.append("<table>")
                for _ in range(rnd.randint(1, 4)):
                    self.html.append("<tr>")
                    for _ in range(rnd.randint(1, 4)):
                        self.block(rnd.choice(["td", "td", "th"]), self.words(1, 5), 1)
                    self.html.append("</tr>")
                self.html.append("</table>")
            else:
                self.part(rnd.choice(["advert", "advert", "sidebar", "form", "share", "notice", "nav"]))

    def page(self) -> str:
        rnd = self.rnd
        self.html.append(f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><script>var a = '<p>';</script></head><body>")
        wrappers = [self.open(rnd.choice(["div", "div", "section"]), SOUNDS, 0.15) for _ in range(rnd.choice([0, 0, 1, 2]))]
        before = [k for k in ("header", "nav", "notice", "advert", "sidebar", "form") if rnd.random() < 0.45]
        rnd.shuffle(before)
        after = [k for k in ("share", "comments", "sidebar", "advert", "form", "notice", "nav", "footer") if rnd.random() < 0.45]
        for kind in before:
            self.part(kind)
        if rnd.random() < 0.95:
            inner = [self.open(rnd.choice(MAIN[0].split()), MAIN[1], 0.7) for _ in range(rnd.choice([1, 1, 2, 3]))]
            self.body()
            if rnd.random() < 0.2:
                self.part(rnd.choice(["comments", "share", "sidebar"]))
            self.html.extend(reversed(inner))
        for kind in after:
            self.part(kind)
        self.html.extend(reversed(wrappers))
        self.html.append("</body></html>")
        return "".join(self.html)


def with_elements(tree: Tree, leaves: list[int]) -> np.ndarray:
    """Labels of all nodes from those of the runs of text: an element is content if over half of its
    text is."""
    n = len(tree.parent)
    good, chars = [0] * n, [0] * n
    told = iter(leaves)
    for i in range(n):
        if tree.text[i] is not None:
            chars[i] = len(tree.text[i])
            good[i] = chars[i] * next(told)
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        good[p] += good[i]
        chars[p] += chars[i]
    return np.array([2 * g > c for g, c in zip(good, chars, strict=True)], int)


def written_pages(n: int, seed: int = 1) -> list[tuple[Tree, np.ndarray]]:
    """n labelled pages of PageWriter, parsed."""
    out = []
    for i in range(n):
        writer = PageWriter(seed * 1_000_003 + i)
        tree = parse(writer.page())
        texts = [t for t in tree.text if t is not None]
        if texts != [t for t, _ in writer.labels]:
            raise ValueError("The parser doesn't give back a written page's texts.")
        out.append((tree, with_elements(tree, [y for _, y in writer.labels])))
    return out


@lru_cache(maxsize=4)
def trained(pages: int = PAGES, seed: int = 1) -> Model:
    """The model of so many labelled pages; about the same for every seed."""
    return train(written_pages(pages, seed))


def main_texts(pages: list[str], model: Model) -> list[str]:
    """The main text of pages: runs of text likelier content than not, one a line."""
    trees = [parse(html) for html in pages]
    content = model.content(trees)
    out, base = [], 0
    for tree in trees:
        out.append("\n".join(t for i, t in enumerate(tree.text) if t is not None and content[base + i] > 0.5))
        base += len(tree.parent)
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages.

    The whole html is read; a null or empty page, and one without main text, has the empty text.
    Character references are decoded, white space in a block is one blank, blocks are lines. Rows that
    repeat a page_id, or have none, are read one by one; other columns are not looked at. A task holds
    the trees of some megabytes of html at a time, or of one page.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "html", 1_000_000):
                texts = main_texts([h or "" for h in part.column("html").to_pylist()], model)
                chars = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), chars],
                    ["page_id", "url", "text", "n_chars"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long"
    )


@query("op12_tree_model_extraction")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
