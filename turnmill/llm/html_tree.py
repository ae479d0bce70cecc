"""HTML as a tree of blocks: elements that make blocks, and the runs of text between their marks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Elements inside a line of text: they make no block. br is white space of its block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt "
    "ruby s samp small source span strike strong sub sup time tt u var wbr".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose text nobody reads, up to their end tag; marks inside the first group are text.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
SKIPPED = frozenset("head noscript template svg math object select datalist button canvas audio video map".split())
#: An open p ends before these; each of the others ends an open one of its kind within its list or table.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")
NAMED = frozenset(["class", "id", "role", "itemprop"])


@dataclass
class Tree:
    """Nodes in page order, parents first. Node 0 is the page; a leaf is a run of text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    names: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])  # code points of a leaf inside links

    def add(self, parent: int, tag: str, names: frozenset[str], text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def name_words(value: str) -> list[str]:
    """Words of a class or id: lower case, without digits and a plural's s."""
    words = [w.lower() for w in _WORD.findall(value)]
    return [w[:-1] if len(w) > 2 and w.endswith("s") and not w.endswith("ss") else w for w in words]


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """The place after a tag's >, past quoted values; the page's end if there is none."""
    while True:
        m = _STOP.search(html, at)
        if m is None:
            return len(html)
        if m[0] == ">":
            return m.end()
        at = m.end()
        if last[m[0]] >= at:  # an open quote without its end is a character like others
            at = html.index(m[0], at) + 1


def parse(html: str) -> Tree:
    """The tree of a page's blocks. Any text gives a tree: unknown and unbalanced marks are taken as
    browsers take them, roughly, and each character is looked at a bounded number of times."""
    tree = Tree()
    stack, opened = [0], {}
    last = {q: html.rfind(q) for q in "\"'"}
    lower, endless = None, set()
    pieces: list[str] = []
    linked, link_at = 0, 0  # the stack's height where a link was opened, 0 outside links

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tree.add(stack[-1], "#text", frozenset(), text, min(linked, len(text)))
            pieces.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if link_at:
                linked += len(text.strip())

    def close():
        nonlocal link_at
        tag = tree.tag[stack.pop()]
        opened[tag] -= 1
        if link_at > len(stack):
            link_at = 0

    at, end = 0, len(html)
    while at < end:
        mark = html.find("<", at)
        if mark < 0:
            say(html[at:])
            break
        after = html[mark + 1 : mark + 2]
        if not (after.isalpha() and after.isascii() or after in ("/", "!", "?") and after):
            say(html[at : mark + 1])
            at = mark + 1
            continue
        say(html[at:mark])
        if after in "!?":
            if html.startswith("<!--", mark):
                stop = html.find("-->", mark + 2)
                at = end if stop < 0 else stop + 3
            else:
                stop = html.find(">", mark)
                at = end if stop < 0 else stop + 1
            continue
        closing = after == "/"
        m = _NAME.match(html, mark + 1 + closing)
        if m is None:  # </ without a name is a comment
            stop = html.find(">", mark)
            at = end if stop < 0 else stop + 1
            continue
        tag = m[0].lower()
        at = _tag_end(html, m.end(), last)
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                link_at = 0 if closing else len(stack)
            continue
        if closing:
            if opened.get(tag) or tag == "p":
                flush()
            if opened.get(tag):
                while tree.tag[stack[-1]] != tag:
                    close()
                close()
            continue
        if tag in RAW or tag in SKIPPED:
            if tag in RAW or html[at - 2] != "/":
                if lower is None:
                    lower = html.lower() if html.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), html)
                stop = -1 if tag in endless else lower.find(f"</{tag}", at)
                if stop >= 0:
                    at = _tag_end(html, stop + 2, last)
                elif tag in RAW:
                    at = end
                else:  # never ended: what follows is read after all
                    endless.add(tag)
            continue
        flush()
        if tag in VOID:
            continue
        if tag in ENDS_P and opened.get("p") and tree.tag[stack[-1]] == "p":
            close()
        if tag in SIBLINGS:
            same, lists = SIBLINGS[tag]
            if any(opened.get(t) for t in same):
                i = len(stack) - 1
                while i and tree.tag[stack[i]] not in same and tree.tag[stack[i]] not in lists:
                    i -= 1
                if tree.tag[stack[i]] in same:
                    while len(stack) > i:
                        close()
        names: set[str] = set()
        if tag not in ("html", "body"):
            for a in _ATTRIBUTE.finditer(html, m.end(), at - 1):
                key = a[1].lower()
                if key in NAMED:
                    names.update(name_words(a[2] or a[3] or a[4] or ""))
                elif key == "hidden" or key == "style" and "display:none" in (a[2] or a[3] or "").replace(" ", "").lower():
                    names.add("hidden")
        stack.append(tree.add(stack[-1], tag, frozenset(names)))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return tree
