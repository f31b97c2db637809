"""Raw HTML to trees of block elements and runs of text, and to features of these nodes."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Fixed values of HTML: elements that begin a block; those that only hold what is not text; those without content; what ends an open paragraph not.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("audio canvas datalist iframe math noembed noframes noscript object script select style svg template textarea title video xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("input button select textarea".split())
#: An element of the key ends open ones of the value, looked for no farther out than the stops.
ENDS = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir table td th article section".split())), "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})), "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})), "tr": (frozenset({"tr"}), frozenset({"table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})), "tbody": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})), "tfoot": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
}
#: An end tag of other elements finds none outside a cell.
CELLS = frozenset({"td", "th", "caption"})
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?>[^>"']+|"[^"]*"|'[^']*')*+>|[^>]*>)|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(?P<name>class|id|role|itemprop|aria-label|aria-hidden|hidden|style|data-truth)(?:\s*=\s*(?P<value>"[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>"']|$)""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What a label for fitting is written in.
TRUTH = "data-truth"


@lru_cache(65_536)
def tokens(rest: str) -> tuple[tuple[str, ...], str]:
    """The words of an element's telling attributes, with `hidden` for whatever is not shown; its label, if it has one."""
    found, truth = [], ""
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m["name"].lower(), (m["value"] or "").strip("\"'")
        if name == TRUTH:
            truth = value
        elif name == "style" or name == "aria-hidden":
            found += ["hidden"] if _UNSEEN.search(value) or value.lower() == "true" else []
        elif name == "hidden":
            found.append("hidden")
        else:
            found += [w.lower() for w in _WORD.findall(value) if len(w) > 1]
    return tuple(dict.fromkeys(found)), truth


@dataclass
class Tree:
    """Nodes of one page in the order of their start: elements, and runs of text (tag `#text`) that stand beside others in an element. The first node is the page."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    ends: list[int] = field(default_factory=lambda: [0])
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    truths: list[str] = field(default_factory=lambda: [""])
    inline: list[int] = field(default_factory=lambda: [0])
    controls: list[int] = field(default_factory=lambda: [0])
    run_nodes: list[int] = field(default_factory=list)
    run_texts: list[str] = field(default_factory=list)
    run_links: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, words: tuple[str, ...] = (), truth: str = "") -> int:
        k = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        self.ends.append(k + 1)
        self.words.append(words)
        self.truths.append(truth)
        self.inline.append(0)
        self.controls.append(0)
        return k


def parse(page: str) -> Tree:
    """The tree of a page, however broken. White space of a run is one space; character references are decoded; br is white space. Text of scripts, styles, controls and the like is no text."""
    tree = Tree()
    stack, open_tags = [0], Counter()
    pieces: list[str] = []
    # links: how deep the open link began; it ends with the element that it began in.
    link_chars, links = 0, 0
    tags, ends = tree.tags, tree.ends

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tree.run_nodes.append(tree.add("#text", stack[-1]))
                tree.run_texts.append(text)
                tree.run_links.append(min(link_chars, len(text)))
            pieces.clear()
        link_chars = 0

    def close() -> None:
        nonlocal links
        node = stack.pop()
        links = links if links <= len(stack) else 0
        open_tags[tags[node]] -= 1
        # A run that has its element for itself is the element.
        if len(tags) == node + 2 and tags[-1] == "#text":
            for column in (tags, tree.parents, ends, tree.words, tree.truths, tree.inline, tree.controls):
                column.pop()
            tree.run_nodes[-1] = node
        ends[node] = len(tags)

    at, size = 0, page.rfind(">") + 1
    while True:
        m = _TOKEN.search(page, at, size)
        text = page[at : m.start() if m else len(page)]
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                link_chars += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if not tag:
            # A comment that nothing ends goes on to the end of the page.
            at = len(page) if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")) else at
            continue
        tag, end = tag.lower(), m["end"]
        if tag in SKIPPED and not end:
            tree.controls[stack[-1]] += tag in CONTROLS
            if not m["rest"].endswith("/>") or tag in ("script", "style", "title", "textarea", "iframe"):
                gone = _end_of(tag).search(page, at)
                at = gone.end() if gone else len(page)
                size = max(size, at)
            continue
        if tag not in BLOCKS and "-" not in tag:
            if tag == "a":
                links = 0 if end else len(stack)
            elif tag == "br":
                pieces.append(" ")
            tree.controls[stack[-1]] += tag in CONTROLS and not end
            tree.inline[stack[-1]] += not end
            continue
        if end:
            flush()
            names = HEADINGS if tag in HEADINGS else (tag,)
            if tag != "body" and any(open_tags[t] for t in names):
                stop = () if tag in TABLE else CELLS
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in names:
                        while len(stack) > k:
                            close()
                        break
                    if tags[stack[k]] in stop:
                        break
            continue
        flush()
        words, truth = tokens(m["rest"])
        if tag == "body":
            tree.words[0] += words
            continue
        if tag == "hr":
            continue
        if len(stack) > 1 and tag != "button":
            while tags[stack[-1]] == "p" or tag in HEADINGS and tags[stack[-1]] in HEADINGS:
                close()
            if tag in ENDS:
                ended, stops = ENDS[tag]
                if any(open_tags[t] for t in ended):
                    for k in range(len(stack) - 1, 0, -1):
                        if tags[stack[k]] in ended:
                            while len(stack) > k:
                                close()
                            break
                        if tags[stack[k]] in stops:
                            break
        tree.controls[stack[-1]] += tag in CONTROLS
        stack.append(tree.add(tag, stack[-1], words, truth))
        open_tags[tag] += 1
    flush()
    while len(stack) > 1:
        close()
    ends[0] = len(tags)
    return tree


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


#: Tags that are features of their own, and those that tell about all nodes within them.
OWN_TAGS = ("#page", "#text", "p", "div", "li", "ul", "ol", "h1", "h2", "h3", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "button", "blockquote", "figure", "pre")
OUTER_TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "table", "ul", "figure", "blockquote")
_OWN, _OUTER = {t: k for k, t in enumerate(OWN_TAGS)}, {t: k for k, t in enumerate(OUTER_TAGS)}


@dataclass
class Forest:
    """The trees of some pages as arrays over all nodes, pages one after the other."""

    roots: np.ndarray
    parents: np.ndarray
    ends: np.ndarray
    depths: np.ndarray
    words: list[tuple[str, ...]]
    tags: list[str]
    truths: list[str]
    inline: np.ndarray
    controls: np.ndarray
    runs: list[str]
    run_nodes: np.ndarray
    run_links: np.ndarray
    run_begins: np.ndarray

    @staticmethod
    def of(trees: list[Tree]) -> Forest:
        sizes = [len(t.tags) for t in trees]
        roots = np.cumsum([0, *sizes])[:-1]
        joined = lambda name, kind=np.int64: np.fromiter((x for t in trees for x in getattr(t, name)), kind)
        shift = np.repeat(roots, sizes)
        parents = joined("parents")
        parents = np.where(parents < 0, -1, parents + shift)
        depths = [0] * len(parents)
        for k, p in enumerate(parents.tolist()):
            depths[k] = depths[p] + 1 if p >= 0 else 0
        runs = [len(t.run_texts) for t in trees]
        flat = lambda name: [x for t in trees for x in getattr(t, name)]
        return Forest(
            roots, parents, joined("ends") + shift, np.array(depths, np.int64), flat("words"), flat("tags"), flat("truths"), joined("inline"), joined("controls"), flat("run_texts"), joined("run_nodes") + np.repeat(roots, runs), joined("run_links"), np.cumsum([0, *runs]),
        )

    def within(self, values: np.ndarray) -> np.ndarray:
        """For each node the sum of the values of its subtree."""
        before = np.concatenate([[0], np.cumsum(values)])
        return before[self.ends] - before[: len(self.ends)]

    def inherited(self, values: np.ndarray, of: np.ufunc) -> np.ndarray:
        """For each node what `of` makes of its own and its ancestors' values."""
        out = values.copy()
        for nodes in self.levels()[1:]:
            out[nodes] = of(out[nodes], out[self.parents[nodes]])
        return out

    def levels(self) -> list[np.ndarray]:
        """The nodes of each depth, outermost first."""
        order = np.argsort(self.depths, kind="stable")
        return np.split(order, np.cumsum(np.bincount(self.depths))[:-1]) if len(order) else []

    @property
    def chars(self) -> np.ndarray:
        """Characters of the text of each subtree."""
        return self.within(np.bincount(self.run_nodes, [len(r) for r in self.runs], len(self.parents)))

    def features(self, odds: dict[str, float]) -> np.ndarray:
        """A row of numbers for each node. odds: how much each word of an attribute speaks for the article."""
        n, parents = len(self.parents), self.parents
        up = np.maximum(parents, 0)
        page = np.repeat(self.roots, np.diff([*self.roots, n]))
        per_run = lambda values: self.within(np.bincount(self.run_nodes, values, n))
        chars, runs, links = self.chars, per_run(np.ones(len(self.runs))), per_run(self.run_links)
        marks = per_run([sum(map(r.count, ".,;:!?")) for r in self.runs])
        closed = per_run([r[-1] in ".!?…:。！？\"'”»)" for r in self.runs])
        long = per_run([len(r) >= 80 for r in self.runs])
        tags = np.array([_OWN.get(t, -1) for t in self.tags])
        paragraphs = self.within((tags == _OWN["p"]).astype(float))
        items = self.within((tags == _OWN["li"]).astype(float))
        heads = self.within(np.array([t in HEADINGS for t in self.tags], float))
        elements = self.within(np.ones(n))
        inline, controls = self.within(self.inline), self.within(self.controls)
        before = np.concatenate([[0], np.cumsum(np.bincount(self.run_nodes, [len(r) for r in self.runs], n))])[:-1]
        before = before - before[page]
        total = np.maximum(chars[page], 1)
        density = links / np.maximum(chars, 1)
        # Siblings stand together when nodes are ordered by their parents.
        order = np.argsort(parents, kind="stable")
        same = parents[order][1:] == parents[order][:-1]
        before_it, after_it = np.full(n, -1), np.full(n, -1)
        before_it[order[1:][same]] = order[:-1][same]
        after_it[order[:-1][same]] = order[1:][same]
        beside = lambda at, values: np.where(at >= 0, values[at], -1)
        count = np.bincount(up, minlength=n)[up]
        first = np.searchsorted(parents[order], parents[order])
        index = np.empty(n)
        index[order] = np.arange(n) - first
        alike = np.unique(up * (len(OWN_TAGS) + 1) + tags + 1, return_inverse=True, return_counts=True)
        logs = np.log1p(chars)
        speaks = np.array([(min(v), max(v)) if (v := [odds[w] for w in ws if w in odds]) else (0.0, 0.0) for ws in map(grams, self.words)]).reshape(n, 2)
        outer = np.zeros((n, len(OUTER_TAGS)), bool)
        for k, t in enumerate(self.tags):
            if t in _OUTER:
                outer[k, _OUTER[t]] = True
        own = np.zeros((n, len(OWN_TAGS)), bool)
        own[np.flatnonzero(tags >= 0), tags[tags >= 0]] = True
        return np.column_stack([
            logs, density, chars / np.maximum(elements + inline, 1), chars / np.maximum(runs, 1), 100 * marks / np.maximum(chars, 1), closed / np.maximum(runs, 1), long, chars / total, before / total, 1 - (before + chars) / total, self.depths,
            count, index, index / np.maximum(count, 1), alike[2][alike[1]] / np.maximum(count, 1), beside(before_it, logs), beside(after_it, logs), beside(before_it, density), beside(after_it, density), density[up], chars[up] / total, chars / np.maximum(chars[up], 1), chars[up] / np.maximum(runs[up], 1),
            paragraphs, items / np.maximum(runs, 1), heads, controls / np.maximum(runs, 1), controls[up] / np.maximum(runs[up], 1), speaks, self.inherited(speaks[:, 0], np.minimum), self.inherited(speaks[:, 1], np.maximum), self.inherited(outer, np.logical_or), own,
        ]).astype(np.float32)


@lru_cache(65_536)
def grams(words: tuple[str, ...]) -> tuple[str, ...]:
    """The words, and their parts of four letters, so that joined words are told too."""
    return tuple(dict.fromkeys([*words, *(f"{w[i : i + 4]}_" for w in words for i in range(len(w) - 3))]))
