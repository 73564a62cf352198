"""The main text of HTML pages: gradient-boosted trees judge the nodes of a page's tree, and a decoding over the whole tree
chooses the likeliest labels that don't contradict each other: all of a node is main text, none of it is, or its children decide.

Trees are fitted on the driver, on a bounded number of labelled pages (PAGES) that htmllayouts.py makes, since no table says what of
a page is its article. Pages are judged by themselves, in Arrow batches; nothing moves between tasks.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import htmllayouts
from opinara.llm.common import slices

#: Labelled pages that the trees are fitted on.
PAGES = 700
MAIN, NONE, MIXED = range(3)

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
_SILENT = _RAW | set("head template svg object select datalist button canvas audio video".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img"
    " input".split()
) | (_SILENT - {"head", "title"})
_ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre"
    " section summary table ul".split()
)
#: A tag ends the open ones of the first set that stand above the last one of the second.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_SHIELDS = {"table", "td", "th", "button", "body", "html", "caption"}
_TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption blockquote td th address summary caption #text".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_POINT = re.compile(r"[.,;:!?…。、]")
_NAMES = {"class", "id", "role", "itemprop", "aria-label", "name"}
_COUNTED = ("p", "li", "h", "control", "img", "link")


def unescape(text: str) -> str:
    if "&" not in text:
        return text
    if "&#" in text:  # numbers of any length
        text = re.sub(r"&#[0-9]{8,};?", "�", re.sub(r"&#0+(?=[0-9])", "&#", text))
    return html.unescape(text)


class Pages:
    """The nodes of pages, in their order: blocks, inline elements with names of their own, and texts that stand beside blocks."""

    def __init__(self):
        self.parent, self.depth, self.tag, self.names, self.page = [], [], [], [], []
        self.own = {k: [] for k in ("chars", "words", "linked", "points", "runs", *_COUNTED)}
        self.pieces: list[list[tuple[int, int, str]]] = []

    def _node(self, parent: int, tag: str, names: tuple) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.names.append(names)
        self.page.append(len(self.pieces) - 1)
        for values in self.own.values():
            values.append(0)
        return len(self.parent) - 1

    def add(self, source: str) -> None:
        """Reads a page: each character once, whatever is left open in it."""
        self.pieces.append([])
        pieces, own = self.pieces[-1], self.own
        root = self._node(-1, "#page", ())
        stack: list[tuple[str, int]] = [("#page", root)]  # a plain inline element belongs to the node around it
        places: dict[str, list[int]] = {}  # where each tag stands in it; blocks together as "#block"
        pattern, last = _TAG, source.rfind(">")
        block = silent = in_link = at = text_from = 0
        free: dict[int, int] = {}  # a node's text node, as long as no block comes between

        def say(upto: int) -> None:
            if silent or upto <= text_from:
                return
            text = unescape(source[text_from:upto])
            bare = text.split()
            tag, node = stack[-1][0], stack[-1][1]
            if not bare:
                if text and pieces:
                    pieces.append((node, block, " "))
                return
            if self.tag[node] not in _TEXT_TAGS and self.tag[node] not in _INLINE:
                node = free[node] if node in free else free.setdefault(node, self._node(node, "#text", ()))
            pieces.append((node, block, text))
            size = sum(map(len, bare))
            own["chars"][node] += size
            own["words"][node] += len(bare)
            own["points"][node] += len(_POINT.findall(text))
            own["runs"][node] += 1
            if in_link:
                own["linked"][node] += size

        def leave(upto: int) -> None:
            nonlocal silent
            while len(stack) > upto:
                tag, _ = stack.pop()
                places[tag].pop()
                silent -= tag in _SILENT
                if tag not in _INLINE:
                    places["#block"].pop()

        def top(tags: set[str]) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        while True:
            start = source.find("<", at)
            if start < 0:
                say(len(source))
                return
            if source.startswith("<!--", start):
                say(start)
                end = source.find("-->", start + 2)
                at = text_from = end + 3 if end >= 0 else len(source)
                continue
            if source[start + 1 : start + 2] in ("!", "?") or (source.startswith("</", start) and not source[start + 2 : start + 3].isalpha()):
                say(start)
                end = source.find(">", start)
                at = text_from = end + 1 if end >= 0 else len(source)
                continue
            found = pattern.match(source, start) if start < last else None
            if found is None and pattern is _TAG and start < last and source[start + 1 : start + 2].isalpha():
                pattern = _PLAIN_TAG  # a quote that never ends: from here on quotes count for nothing
                found = pattern.match(source, start)
            if found is None:
                at = start + 1
                continue
            say(start)
            at = text_from = found.end()
            closing, tag, attributes = found[1], found[2].lower(), found[3]
            inline = tag in _INLINE
            if not inline:
                block, in_link = block + 1, 0
                if tag != "br":
                    free.pop(stack[-1][1], None)
            if closing:
                if tag == "a":
                    in_link = 0
                if places.get(tag) and (not inline or places[tag][-1] > top({"#block"})):
                    leave(places[tag][-1])
                continue
            node = stack[-1][1]
            if tag == "br":
                continue
            if tag in _VOID:
                if tag in ("img", "input"):
                    own["img" if tag == "img" else "control"][node] += 1
                continue
            if tag in _ENDS_P and top({"p"}) > top(_SHIELDS):
                leave(top({"p"}))
            if tag in _ENDS:
                ended, shields = _ENDS[tag]
                shield = top(shields)
                open_ = [places[t][bisect.bisect(places[t], shield)] for t in ended if places.get(t) and places[t][-1] > shield]
                if open_:
                    leave(min(open_))
            names = tuple(w.lower() for name, value in _ATTRIBUTE.findall(attributes) if name.lower() in _NAMES for w in _WORD.findall(value)) if "=" in attributes else ()
            if re.search(r"(?i)(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", attributes):
                names += ("hidden",)
            node = stack[-1][1]
            if tag == "a":
                own["link"][node] += 1
                in_link = 1
            if not inline or names:
                node = self._node(node, tag, names)
                if tag in ("p", "li"):
                    own[tag][node] += 1
                elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                    own["h"][node] += 1
            if tag in ("select", "textarea", "button", "label"):
                own["control"][node] += 1
            for name in (tag,) if inline else (tag, "#block"):
                places.setdefault(name, []).append(len(stack))
            stack.append((tag, node))
            silent += tag in _SILENT
            if tag in _RAW:
                end = re.compile(f"</{tag}(?![a-z0-9])", re.I).search(source, at)
                at = text_from = end.start() if end else len(source)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Parents, depths, and the nodes of each depth from the second on."""
        parent, depth = np.array(self.parent, np.int64), np.array(self.depth, np.int64)
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        return parent, depth, levels[1:]


def _sums(values: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    total = values.astype(np.float64)
    for level in reversed(levels):
        np.add.at(total, parent[level], total[level])
    return total


def features(pages: Pages, tag_scores: dict, name_scores: dict) -> np.ndarray:
    """A row for each node: densities of its subtree, words of its attributes, depth, and how it stands to its siblings."""
    parent, depth, levels = pages.arrays()
    n = len(parent)
    above, page = np.maximum(parent, 0), np.array(pages.page)
    own = {k: np.array(v, np.float64) for k, v in pages.own.items()}
    under = {k: _sums(v, parent, levels) for k, v in own.items()}
    nodes = _sums(np.ones(n), parent, levels)
    roots = np.flatnonzero(parent < 0)
    whole = under["chars"][roots][page]
    before = np.cumsum(own["chars"]) - own["chars"]
    before -= before[roots][page]
    tag = np.array([tag_scores.get(t, (0.0, 0.0, 0.0)) for t in pages.tag])
    unknown = np.zeros(3)
    named = np.array([np.sum([name_scores[w] for w in names if w in name_scores] or [unknown], axis=0) for names in pages.names]).reshape(n, 3)
    both = tag + named
    highest, deepest = both.copy(), both.copy()
    for level in levels:
        highest[level] = np.maximum(highest[level], highest[parent[level]])
    for level in reversed(levels):
        np.maximum.at(deepest, parent[level], deepest[level])
    # siblings: nodes of one parent, in order
    order = np.lexsort((np.arange(n), parent))
    first = np.r_[True, parent[order][1:] != parent[order][:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    place, count = np.empty(n), np.bincount(above, parent >= 0, n)[above]
    place[order] = np.arange(n) - start
    earlier, later = np.full(n, -1), np.full(n, -1)
    same = ~first[1:]
    earlier[order[1:][same]], later[order[:-1][same]] = order[:-1][same], order[1:][same]
    link_share = under["linked"] / np.maximum(under["chars"], 1)
    beside = [np.where(at >= 0, values[at], -1.0) for at in (earlier, later) for values in (np.log1p(under["chars"]), link_share, both[:, MAIN] - both[:, NONE])]
    tags = {t: i for i, t in enumerate(dict.fromkeys(pages.tag))}
    kind = above * len(tags) + np.array([tags[t] for t in pages.tag])
    _, at, alike = np.unique(kind, return_inverse=True, return_counts=True)
    chars, runs = under["chars"], np.maximum(under["runs"], 1)
    columns = [
        depth, place, place / np.maximum(count, 1), count, alike[at] / np.maximum(count, 1), np.log1p(chars), np.log1p(under["words"]), link_share,
        np.log1p(chars / nodes), chars / np.maximum(whole, 1), chars / np.maximum(chars[above], 1), under["points"] / np.maximum(under["words"], 1),
        np.log1p(under["words"] / runs), before / np.maximum(whole, 1), np.log1p(whole), own["chars"] / np.maximum(chars, 1), np.log1p(nodes),
        *(np.log1p(under[k]) for k in _COUNTED), *(under[k] / nodes for k in ("p", "li", "link", "control")),
        *tag.T, *named.T, *highest.T, *deepest.T, *highest[above].T, *beside,
    ]
    return np.column_stack(columns).astype(np.float32)


def decode(scores: np.ndarray, pages: Pages) -> np.ndarray:
    """The labels of the greatest sum of scores among those in which MAIN has only MAIN below it, and NONE only NONE."""
    parent, _, levels = pages.arrays()
    best = scores.astype(np.float64)
    for level in reversed(levels):
        add = best[level].copy()
        add[:, MIXED] = add.max(axis=1)
        np.add.at(best, parent[level], add)
    label = best.argmax(axis=1)
    for level in levels:
        above = label[parent[level]]
        label[level] = np.where(above == MIXED, label[level], above)
    return label


class Trees:
    """Gradient boosting of small trees on binned features, a tree for each label and round, under the loss of softmax."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 45, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 3.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        self.depth, self.rate, self.trees = depth, rate, []
        binned, (n, width) = self._bin(x), x.shape
        flat, truth, z = binned.astype(np.int64) + np.arange(width) * bins, np.eye(3)[y], np.zeros((len(y), 3))
        for _ in range(rounds):
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            self.trees.append([])
            for k in range(3):
                g, h = truth[:, k] - p[:, k], p[:, k] * (1 - p[:, k])
                size = 2**depth - 1
                by, cut, at = np.zeros(size, np.int64), np.full(size, bins, np.int64), np.zeros(n, np.int64)
                for level in range(depth):
                    base, k_nodes = 2**level - 1, 2**level
                    cell = ((at - base)[:, None] * (width * bins) + flat).ravel()
                    sums = [np.bincount(cell, np.repeat(v, width), k_nodes * width * bins).reshape(k_nodes, width, bins).cumsum(axis=2) for v in (g, h)]
                    (left, left_h), (both, both_h) = sums, (s[:, :, -1:] for s in sums)
                    gain = left**2 / (left_h + 1) + (both - left) ** 2 / (both_h - left_h + 1) - both**2 / (both_h + 1)
                    gain[(left_h < least) | (both_h - left_h < least)] = 0
                    top = gain.reshape(k_nodes, -1).argmax(axis=1)
                    split = gain.reshape(k_nodes, -1)[np.arange(k_nodes), top] > 1e-9
                    by[base : base + k_nodes], cut[base : base + k_nodes] = top // bins, np.where(split, top % bins, bins)
                    at = 2 * at + 1 + (binned[np.arange(n), by[at]] > cut[at])
                leaf = at - size
                value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
                z[:, k] += value[leaf]
                self.trees[-1].append((by, cut, value.astype(np.float32)))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)]).astype(np.uint8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The logarithms of the labels' likelihoods."""
        binned, rows, z = self._bin(x), np.arange(len(x)), np.zeros((len(x), 3), np.float32)
        for trees in self.trees:
            for k, (by, cut, value) in enumerate(trees):
                at = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    at = 2 * at + 1 + (binned[rows, by[at]] > cut[at])
                z[:, k] += value[at - len(by)]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def labelled(sources: list[str]) -> tuple[Pages, np.ndarray]:
    """Nodes of made pages and their labels: MAIN or NONE where all marked texts below are so, MIXED, or -1 without texts."""
    pages = Pages()
    for source in sources:
        pages.add(source)
    parent, _, levels = pages.arrays()
    has = np.zeros((len(parent), 2))
    for pieces in pages.pieces:
        for node, _, text in pieces:
            has[node] += [text.count(htmllayouts.MAIN), text.count(htmllayouts.NONE)]
    main, none = (_sums(h, parent, levels) > 0 for h in has.T)
    return pages, np.where(main & none, MIXED, np.where(main, MAIN, np.where(none, NONE, -1)))


def _by_word(words: Iterator[tuple[str, int]], smooth: float) -> dict:
    """How much likelier than usual each label is at a word."""
    seen: dict[str, np.ndarray] = {}
    for word, label in words:
        seen.setdefault(word, np.zeros(3))[label] += 1
    usual = np.sum(list(seen.values()), axis=0) / sum(v.sum() for v in seen.values())
    return {w: tuple(np.log((v + smooth * usual) / (v.sum() + smooth) / usual)) for w, v in seen.items()}


@lru_cache(1)
def model() -> tuple[Trees, dict, dict]:
    pages, y = labelled(htmllayouts.pages(PAGES, 1))
    known = np.flatnonzero(y >= 0)
    tag_scores = _by_word(((pages.tag[i], y[i]) for i in known), 5)
    name_scores = _by_word(((w, y[i]) for i in known for w in set(pages.names[i])), 3)
    return Trees(features(pages, tag_scores, name_scores)[known], y[known]), tag_scores, name_scores


def main_texts(sources: list[str | None], fitted) -> list[str]:
    trees, tag_scores, name_scores = fitted
    pages = Pages()
    for source in sources:
        pages.add(source or "")
    label = decode(trees.scores(features(pages, tag_scores, name_scores)), pages)
    out = []
    for pieces in pages.pieces:
        kept, last = [], None
        for node, block, text in pieces:
            if label[node] == MAIN:
                kept += [text] if block == last else [" ", text]
                last = block
        out.append(" ".join("".join(kept).split()))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): each page's main text, its blocks joined by one space, and its code points.

    pages: page_id, url, html; further columns are left aside. A null or empty page and one without main text has an empty text. Pages
    are read whole, in time that grows with their length; a page of any length is one row of a batch. What is left open ends where
    the HTML rules end it. Equal pages have equal texts; repeated rows stay; an empty table gives an empty one.
    """
    fitted = model()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = main_texts(part.column(2).to_pylist(), fitted)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    kind = dict(pages.dtypes)["page_id"]
    wanted = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return wanted.mapInArrow(task, f"page_id {kind}, url string, text string, n_chars long")
