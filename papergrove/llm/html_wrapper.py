"""Main text of web pages by wrapper induction over the pages of a host.

1. Each page's markup becomes a tree of its block elements. Runs of like siblings fold into one repeated node, which
   gives the page's skeleton. A host's reference is its most frequent skeleton.
2. Simple tree matching aligns a page's skeleton with its host's reference (each pair of skeletons once per worker), so
   a text block gets the reference node (slot) it fills. Over all pages of the host, a slot's new text (the length of
   its distinct texts) and the share of distinct ones among its texts are counted. Pages of one content, told by their
   longest block, count a text once, so that copies of an article cannot become template.
3. The wrapper: the content region is the reference node found by going down from the root while one child with
   elements of its own holds half of the new text. A slot beside it is content too if it varies like the region (its
   share of distinct texts is at least LIKE_REGION of the region's) and either holds NOTABLE of its new text or is a
   heading; else it is template, as are texts that most contents of the host show in the same slot. In the region only
   texts that nearly all contents show are template, and only after the last block that differs: between differing blocks
   they are section headings, labels and the like, and stay.
4. A page's main text is its content in page order. Names of elements and classes only break ties: among slots that
   vary alike, what is marked as menu, header, footer, aside, form, notice, advert or comment goes; marks of the region
   itself and of what it stands in are ignored. Blocks that fill no slot go by the nearest element around them that
   does. Where a host has too few distinct contents to learn from, and on pages without the region, articles (else
   main elements, else everything unmarked) are the text.

Per host there is a row of the wrapper (reference, figures by slot, template texts); counts are summed by Spark over
all pages, so a host of any size is spread. Wrappers are broadcast where their counted number and bytes allow it, else
joined by host. Parsing is linear and uses no recursion. Equal subtrees are matched by hash; the others by the exact
matching at any size. Its cost is the product of the different subtrees of two skeletons that share names, and of two
lists of children; of a list's alignment about CELLS sums are held, whatever its length.

Null and empty pages have the empty text; pages whose url has no host share the host ""; repeated rows are extracted
each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import drop, has, prepare, small_in_bytes, stage

#: Elements without an end tag, with raw text, without readable text, that make a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe".split())
SILENT = frozenset("head script style template noscript iframe object svg canvas math select option button textarea title xmp audio video map".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements and words of class, id or role that mark what is not main text.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|side|aside|rail|widget\w*|"
    r"comments?|commentlist|replies|reply|respond|disqus|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search\w*|"
    r"share\w*|sharing|social|related|recommend\w*|pagination|pager|toolbar|copyright|contentinfo|complementary|navigation|hidden)(?:$|[\s_-])",
    re.I,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What closes an open element of the kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div section main td th table ul ol dl nav header footer form html blockquote".split())

PLAIN = re.compile(r"[^>\"']*+")
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: A template text stands in its slot on so many distinct contents of a host at least, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: In the region a text is template only if it stands in its slot on this share of the host's contents.
ALWAYS = 0.9
#: Of the region's figures, what a slot beside it needs: the share of distinct texts, and of new text.
LIKE_REGION, NOTABLE = 0.9, 0.03
#: For speed and memory alone: sums of an alignment held at once, about; lists of so few pairs are weighed without arrays;
#: parts that the rows of a longer one are cut into.
CELLS, PAIRS, PARTS = 4_000_000, 64, 32
#: Bytes of skeletons whose alignments a worker remembers.
REMEMBERED = 64 << 20


class Node:
    __slots__ = ("tag", "name", "aside", "kids", "parent", "silent", "index")

    def __init__(self, tag: str, name: str, aside: bool, parent: Node | None, index: int):
        self.tag, self.name, self.aside, self.parent, self.index = tag, name, aside, parent, index
        self.kids: list[Node | str] = []
        self.silent = tag in SILENT or parent is not None and parent.silent


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, int]]:
    """(start, end, tag, whether it closes, start of its attributes) of all markup; the tag is "" for what is skipped.

    An attribute whose quotation mark is never closed ends at the next ">".
    """
    at, size, unclosed = 0, len(page), set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            yield start, at, "", False, at
            continue
        closes = page.startswith("</", start)
        name = NAME.match(page, start + 1 + closes)
        if not name:
            if page[start + 1 : start + 2] in ("!", "?") and (end := page.find(">", start)) >= 0:
                at = end + 1
                yield start, at, "", False, at
            else:
                at = start + 1
            continue
        end = name.end()
        while True:
            end = PLAIN.match(page, end).end()
            if end == size or page[end] == ">":
                break
            mark = page[end]
            close = -1 if mark in unclosed else page.find(mark, end + 1)
            if close < 0:
                unclosed.add(mark)
                end = page.find(">", end)
                break
            end = close + 1
        if end < 0 or end == size:
            at = start + 1
            if page.find(">", start) < 0:
                return
            continue
        given = yield start, end + 1, name[0].lower(), closes, name.end()
        at = end + 1 if given is None else given


def parse(page: str) -> list[Node]:
    """The elements of a page in page order, root first. Inline elements are dissolved into the text of their block."""
    root = Node("html", "html", False, None, 0)
    nodes, here, at, opened = [root], root, 0, Counter()
    found = tokens(page)
    go_on: int | None = None

    def text(piece: str) -> None:
        if piece and not here.silent:
            here.kids.append(piece)

    def leave(node: Node) -> Node:
        """Closes all open elements up to this one."""
        k = here
        while k is not node:
            opened[k.tag] -= 1
            k = k.parent
        opened[node.tag] -= 1
        return node.parent

    while True:
        try:
            start, end, tag, closes, rest_at = found.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at:
            text(page[at:start])
        at = end
        if not tag:
            continue
        if closes:
            if opened[tag] > 0:
                node = here
                while node.tag != tag and (tag in SCOPE or node.tag not in SCOPE):
                    node = node.parent
                if node.tag == tag:
                    here = leave(node)
            continue
        if tag == "br" or tag == "img":
            text(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = go_on = close.end() if close else len(page)
            continue
        if tag not in BLOCKS and tag not in SILENT or tag == "html":
            continue
        if tag in BLOCKS and opened["p"] > 0:  # an open p ends where a block begins
            node = here
            while node.tag not in SCOPE and node.tag != "p" and node.tag != "li":
                node = node.parent
            if node.tag == "p":
                here = leave(node)
        if tag in CLOSES and any(opened[t] > 0 for t in CLOSES[tag]):
            node = here
            while node.parent is not None and node.tag not in CLOSES[tag] and node.tag not in ("ul", "ol", "dl", "table", "menu"):
                node = node.parent
            if node.tag in CLOSES[tag]:
                here = leave(node)
        name, aside = tag, tag in ASIDE_TAGS
        rest = page[rest_at : end - 1]
        if "=" in rest or "hidden" in rest:
            marks = []
            for a in ATTRIBUTE.finditer(rest):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key == "style":
                    aside |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                elif key in ("hidden", "aria-hidden"):
                    aside |= value.lower() != "false"
                else:
                    marks.append(value)
            marked = " ".join(marks)
            if marked and tag not in ("body", "html"):
                aside |= bool(ASIDE_WORDS.search(marked))
                name = f"{tag}.{re.sub(r'[^a-zA-Z-]+', '-', marked)}"
        node = Node(tag, name, aside, here, len(nodes))
        nodes.append(node)
        here.kids.append(node)
        if tag != "hr" and not rest.rstrip().endswith("/"):
            opened[tag] += 1
            here = node
    text(page[at:])
    return nodes


class Page(NamedTuple):
    """A page's elements, its skeleton, and the skeleton node of each element (-1: silent)."""

    nodes: list[Node]
    skeleton: str
    slots: list[int]


def folded(nodes: list[Node]) -> Page:
    """Runs of like siblings fold into one skeleton node. A skeleton is a line for each node: depth and name."""
    shapes: dict[tuple, int] = {}
    shape, size = [0] * len(nodes), [1] * len(nodes)
    kids: list[list[Node]] = [[] for _ in nodes]  # the first of each run
    for n in reversed(nodes):
        if n.silent:
            continue
        last = None
        for k in n.kids:
            if not isinstance(k, str) and not k.silent and shape[k.index] != last:
                kids[n.index].append(k)
                last = shape[k.index]
        shape[n.index] = shapes.setdefault((n.name, tuple(shape[k.index] for k in kids[n.index])), len(shapes) + 1)
        size[n.index] = 1 + sum(size[k.index] for k in kids[n.index])
    slots, lines, stack = [-1] * len(nodes), [], [(nodes[0], 0)]
    slots[0] = 0
    for n in nodes:  # parents come before their children
        if n.silent:
            continue
        next_slot, last, at = slots[n.index] + 1, None, 0
        for k in n.kids:
            if isinstance(k, str) or k.silent:
                continue
            if shape[k.index] != last:
                at, last = next_slot, shape[k.index]
                next_slot += size[k.index]
            slots[k.index] = at
    while stack:
        n, depth = stack.pop()
        lines.append(f"{depth} {n.name}")
        stack += [(k, depth + 1) for k in reversed(kids[n.index])]
    return Page(nodes, "\n".join(lines), slots)


class Tree(NamedTuple):
    names: list[str]
    parents: list[int]
    kids: list[list[int]]
    sizes: list[int]
    shapes: list[tuple]


@lru_cache(32)
def tree(skeleton: str) -> Tree:
    names, parents, kids, path = [], [], [], []
    for k, line in enumerate(skeleton.split("\n")):
        depth, _, name = line.partition(" ")
        del path[int(depth) :]
        names.append(name)
        kids.append([])
        parents.append(path[-1] if path else -1)
        if path:
            kids[path[-1]].append(k)
        path.append(k)
    sizes, shapes = [1] * len(names), [()] * len(names)
    for k in reversed(range(len(names))):
        sizes[k] += sum(sizes[j] for j in kids[k])
        shapes[k] = xxhash.xxh3_128_digest("\n".join((names[k], *(shapes[j].hex() for j in kids[k]))))
    return Tree(names, parents, kids, sizes, shapes)


def _next(best: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """From the best sums of the rows so far, by number of columns, those with one more row."""
    out = np.zeros(len(best), np.int64)
    out[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weights))
    return out


def _aligned(row: Callable[[int], np.ndarray], n: int, m: int) -> list[tuple[int, int]]:
    """The heaviest set of pairs in order, of n rows and m columns; row(i) gives the weights of a row.

    Beyond CELLS only the sums before every part of the rows are held, and parts are made again, the last one first.
    """
    out: list[tuple[int, int]] = []

    def back(lo: int, hi: int, top: np.ndarray, j: int) -> int:
        best, step = [top[: j + 1]], 1
        if hi - lo > PARTS and (hi - lo) * (j + 1) > CELLS:
            step = -(-(hi - lo) // PARTS)
            now = best[0]
            for i in range(lo, lo + (hi - lo - 1) // step * step):
                now = _next(now, row(i)[:j])
                if (i + 1 - lo) % step == 0:
                    best.append(now)
            for k in reversed(range(len(best))):
                j = back(lo + k * step, min(hi, lo + (k + 1) * step), best[k], j) if j else 0
            return j
        for i in range(lo, hi):
            best.append(_next(best[-1], row(i)[: len(top[: j + 1]) - 1]))
        i = hi - lo
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((lo + i, j))
        return j

    back(0, n, np.zeros(m + 1, np.int64), m)
    return out[::-1]


class Matching:
    """Weights of the largest matchings of subtrees; a pair of different subtrees is weighed once, wherever it stands.

    Subtrees of one name without a common name among their children match by their roots alone and are not gone into.
    """

    def __init__(self, a: Tree, b: Tree):
        ids: dict[bytes, int] = {}
        self.a, self.b = a, b
        self.of_a, self.of_b = ([ids.setdefault(s, len(ids)) for s in t.shapes] for t in (a, b))
        self.below_a, self.below_b = ([frozenset(t.names[k] for k in kids) for kids in t.kids] for t in (a, b))
        self.found: dict[int, int] = {}

    def key(self, x: int, y: int) -> int:
        return self.of_a[x] * (len(self.of_a) + len(self.of_b)) + self.of_b[y]

    def weight(self, x: int, y: int) -> int | None:
        """Of two subtrees; None if not weighed yet."""
        if self.a.names[x] != self.b.names[y]:
            return 0
        if self.of_a[x] == self.of_b[y]:
            return self.a.sizes[x]
        return 1 if self.below_a[x].isdisjoint(self.below_b[y]) else self.found.get(self.key(x, y))

    def lists(self, x: int, y: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
        """Equal children at both ends, in pairs, and the others of both."""
        left, right = self.a.kids[x], self.b.kids[y]
        head, short = 0, min(len(left), len(right))
        while head < short and self.of_a[left[head]] == self.of_b[right[head]]:
            head += 1
        tail = 0
        while tail < short - head and self.of_a[left[-1 - tail]] == self.of_b[right[-1 - tail]]:
            tail += 1
        m, n = len(left) - tail, len(right) - tail
        return [*zip(left[:head], right[:head]), *zip(left[m:], right[n:])], left[head:m], right[head:n]

    def alike(self, right: list[int]) -> tuple[dict[int, int], Callable[[int], set[int]]]:
        """The number of each different subtree of a list, and which of them share a child's name with a node of a."""
        number: dict[int, int] = {}
        by_name: dict[tuple[str, str], set[int]] = defaultdict(set)
        for q in right:
            if self.of_b[q] not in number:
                number[self.of_b[q]] = len(number)
                for below in self.below_b[q]:
                    by_name[self.b.names[q], below].add(q)
        return number, lambda p: set().union(*(by_name.get((self.a.names[p], below), ()) for below in self.below_a[p]))

    def open(self, x: int, y: int) -> Iterator[tuple[int, int]]:
        """Pairs of children that must be weighed before their parents."""
        _, left, right = self.lists(x, y)
        if len(left) * len(right) <= PAIRS:
            yield from ((p, q) for p in left for q in right if self.weight(p, q) is None)
        elif left and right:
            _, sharing = self.alike(right)
            for p in {self.of_a[p]: p for p in left}.values():
                yield from ((p, q) for q in sharing(p) if self.weight(p, q) is None)

    def rows(self, left: list[int], right: list[int]) -> Callable[[int], np.ndarray]:
        number, sharing = self.alike(right)
        of = np.array([number[self.of_b[q]] for q in right])
        first = {self.of_b[q]: q for q in reversed(right)}
        named: dict[str, list[int]] = defaultdict(list)
        for shape, v in number.items():
            named[self.b.names[first[shape]]].append(v)
        held: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            p = left[i]
            if (out := held.get(self.of_a[p])) is None:
                out = np.zeros(len(number), np.int64)
                out[named.get(self.a.names[p], [])] = 1
                for q in sharing(p):
                    out[number[self.of_b[q]]] = self.weight(p, q)
                if len(held) * len(number) <= CELLS:
                    held[self.of_a[p]] = out
            return out[of]

        return row

    def best(self, x: int, y: int) -> int:
        """The weight of two nodes whose children are weighed."""
        same, left, right = self.lists(x, y)
        total = 1 + sum(self.a.sizes[p] for p, _ in same)
        if len(left) * len(right) <= PAIRS:
            best = [0] * (len(right) + 1)
            for p in left:
                now = [0]
                for j, q in enumerate(right):
                    now.append(max(best[j + 1], now[j], best[j] + self.weight(p, q)))
                best = now
            return total + best[-1]
        if not (left and right):
            return total
        row, best = self.rows(left, right), np.zeros(len(right) + 1, np.int64)
        for i in range(len(left)):
            best = _next(best, row(i))
        return total + int(best[-1])

    def size(self) -> int:
        """The weight of both roots; all that it needs is weighed."""
        stack = [(0, 0, self.open(0, 0))] if self.weight(0, 0) is None else []
        while stack:
            x, y, pairs = stack[-1]
            if (pair := next(pairs, None)) is not None:
                stack.append((*pair, self.open(*pair)))
            else:
                stack.pop()
                self.found[self.key(x, y)] = self.best(x, y)
        return self.weight(0, 0)

    def pairs(self) -> list[tuple[int, int]]:
        out, stack = [], [(0, 0)]
        while stack:
            x, y = stack.pop()
            if self.of_a[x] == self.of_b[y]:
                out += [(x + k, y + k) for k in range(self.a.sizes[x])]
                continue
            out.append((x, y))
            same, left, right = self.lists(x, y)
            stack += same
            if left and right and not self.below_a[x].isdisjoint(self.below_b[y]):
                stack += [(left[i], right[j]) for i, j in _aligned(self.rows(left, right), len(left), len(right))]
        return sorted(out)


def tree_match(a: Tree, b: Tree) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest matching that keeps order and ancestry, and the matched pairs.

    It is the same exact matching for trees of any size.
    """
    if a.names[0] != b.names[0]:
        return 0, []
    found = Matching(a, b)
    return found.size(), found.pairs()


class Alignments(dict):
    """Alignments of pairs of skeletons, forgotten when they and their skeletons take over REMEMBERED bytes."""

    held = 0

    def __missing__(self, pair: tuple[str, str]) -> array:
        own, reference = pair
        n = own.count("\n") + 1
        out = array("i", range(n)) if own == reference else array("i", [-1]) * n
        if own != reference:
            for x, y in tree_match(tree(own), tree(reference))[1]:
                out[x] = y
        size = len(own) + len(reference) + 4 * n
        if self.held + size > REMEMBERED:
            self.clear()
            self.held = 0
        self[pair] = out
        self.held += size
        return out


_ALIGNMENTS = Alignments()


def alignment(own: str, reference: str) -> array:
    """For each node of a skeleton (in page order) the number of its match in the reference, or -1."""
    return _ALIGNMENTS[own, reference]


class Block(NamedTuple):
    text: str
    node: Node


def clean(parts: list[str]) -> str:
    text = "".join(parts)
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def blocks(page: Page) -> list[Block]:
    """Text blocks in page order: what stands between the beginnings and ends of block elements."""
    out: list[Block] = []
    stack: list[tuple[Node, int]] = [(page.nodes[0], 0)]
    while stack:
        node, k = stack.pop()
        held: list[str] = []
        while k < len(node.kids) and isinstance(node.kids[k], str):
            held.append(node.kids[k])
            k += 1
        if held and (t := clean(held)):
            out.append(Block(t, node))
        if k < len(node.kids):
            stack.append((node, k + 1))
            if not node.kids[k].silent:
                stack.append((node.kids[k], 0))
    return out


def _article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.name.endswith(".main") or node.name == "div.article"


def marked(nodes: list[Node], region: set[int]) -> list[bool]:
    """Whether each element is in something marked as not main text, other than the region and what it stands in.

    A heading may stand in the header of an article or of the region.
    """
    out, within, header = [False] * len(nodes), [False] * len(nodes), [False] * len(nodes)
    around = set()
    for i in region:
        n = nodes[i].parent
        while n is not None and n.index not in around:
            around.add(n.index)
            n = n.parent
    for n in nodes:
        i, up = n.index, n.parent.index if n.parent else None
        if i in region or i in around:
            within[i] = i in region
            continue
        if up is not None:
            out[i], within[i], header[i] = out[up], within[up], header[up]
        if n.aside and n.tag == "header" and within[i]:
            header[i] = True
        else:
            out[i] |= n.aside
        within[i] |= _article(n)
    return [o or h and n.tag not in HEADINGS for o, h, n in zip(out, header, nodes)]


class Wrapper(NamedTuple):
    """What a host's pages say: the reference, its region, which of its nodes are content, and template texts.

    fixed tells of a (slot, text) that most contents show whether nearly all do; sizes are of the reference's subtrees.
    """

    reference: str
    region: int
    content: tuple[bool, ...]
    fixed: dict[tuple[int, int], bool]
    sizes: list[int]


def induced(reference: str, figures: list[tuple[int, int, int, int]], fixed: dict[tuple[int, int], bool]) -> Wrapper | None:
    """The wrapper from (slot, texts, distinct texts, length of the distinct ones) by slot; None where there is no text."""
    t = tree(reference)
    n = len(t.names)
    texts, distinct, new = np.zeros(n), np.zeros(n), np.zeros(n)
    for slot, a, b, c in figures:
        texts[slot], distinct[slot], new[slot] = a, b, c
    own = texts.copy(), distinct.copy(), new.copy()  # without what is below
    for k in range(n - 1, 0, -1):
        for x in (texts, distinct, new):
            x[t.parents[k]] += x[k]
    if not new[0]:
        return None
    region, around, beside = 0, [], []
    while heavy := [k for k in t.kids[region] if t.kids[k] and new[k] >= 0.5 * new[region]]:
        around.append(region)
        beside += [k for k in t.kids[region] if k != heavy[0]]
        region = heavy[0]
    content = [False] * n
    content[region : region + t.sizes[region]] = [True] * t.sizes[region]
    share = distinct[region] / max(texts[region], 1)
    for k in around:  # the text that stands in it directly
        content[k] = bool(not own[0][k] or own[1][k] / own[0][k] >= LIKE_REGION * share and own[2][k] >= NOTABLE * new[region])
    for k in beside:
        if texts[k] and distinct[k] / texts[k] >= LIKE_REGION * share:
            for j in range(k, k + t.sizes[k]):
                content[j] = bool(new[k] >= NOTABLE * new[region]) or t.names[j].partition(".")[0] in HEADINGS
    return Wrapper(reference, region, tuple(content), fixed, t.sizes)


def _below(nodes: list[Node], region: set[int]) -> list[bool]:
    """Whether each element is one of the region's or in one."""
    out = [False] * len(nodes)
    for n in nodes:
        out[n.index] = n.index in region or n.parent is not None and out[n.parent.index]
    return out


def main_text(page: Page, found: list[Block], wrapper: Wrapper | None) -> str:
    """The blocks of the main text, joined by empty lines."""
    if wrapper is not None:
        to = alignment(page.skeleton, wrapper.reference)
        fills = [to[s] if s >= 0 else -1 for s in page.slots]
        region = {n.index for n in page.nodes if fills[n.index] == wrapper.region}
        if region:
            inside, sizes = [False] * len(page.nodes), wrapper.sizes
            for n in page.nodes:
                i, up = n.index, n.parent.index if n.parent else 0
                if fills[i] >= 0:
                    inside[i] = wrapper.content[fills[i]]
                else:  # by what is around it; what just shares an element with the region counts as content
                    inside[i] = inside[up] or fills[up] >= 0 and fills[up] < wrapper.region < fills[up] + sizes[fills[up]]
            aside = marked(page.nodes, region)
            held = [b for b in found if inside[b.node.index] and not aside[b.node.index]]
            below = _below(page.nodes, region)
            fixed = [wrapper.fixed.get((fills[b.node.index], text_hash(b.text))) for b in held]  # None: no template text
            fixed = [f is not None and (f or not below[b.node.index]) for f, b in zip(fixed, held)]
            last = max((k for k, b in enumerate(held) if below[b.node.index] and not fixed[k]), default=-1)
            return "\n\n".join(b.text for k, (b, f) in enumerate(zip(held, fixed)) if not f or below[b.node.index] and k < last)
    aside = marked(page.nodes, set())
    content = [b for b in found if not aside[b.node.index]]
    for marks in (lambda n: n.tag == "article", _article):
        within = [False] * len(page.nodes)
        for n in page.nodes:
            within[n.index] = marks(n) or n.parent is not None and within[n.parent.index]
        if held := [b for b in content if within[b.node.index]]:
            content = held
            break
    return "\n\n".join(b.text for b in content)


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


SHAPES = "host string, content long, skeleton string, slots array<int>, texts array<long>, lengths array<int>"


def wrappers(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(host, reference, figures, template) of the hosts that can be learned: with LEAST_PAGES distinct contents at least.

    figures: (slot, texts, distinct, length) by slot; template: (slot, hash, always) of the texts most contents show; always: nearly all do.
    """
    prepare(spark)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = folded(parse(html or ""))
                found = blocks(page)
                texts = [text_hash(x.text) for x in found]
                longest = max(range(len(found)), key=lambda k: len(found[k].text), default=None)
                rows.append((host, 0 if longest is None else texts[longest], page.skeleton, [page.slots[x.node.index] for x in found], texts, [len(x.text) for x in found]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["host", "content", "skeleton", "slots", "texts", "lengths"])

    seen = stage(spark, pages.select(host_of().alias("host"), "html").mapInArrow(shapes, SHAPES), "shapes")
    counts = seen.groupBy("host", "skeleton").agg(F.count("*").alias("n"))
    reference = counts.groupBy("host").agg(F.max(F.struct("n", "skeleton")).alias("m")).select("host", F.col("m.skeleton").alias("reference"))
    contents = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("contents")).where(f"contents >= {LEAST_PAGES}")
    reference = stage(spark, reference.join(contents, "host"), "references")
    lone = small_in_bytes(reference, F.length("reference"))

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                to = alignment(r.skeleton, r.reference)
                rows += {(r.host, r.content, to[s], t, n) for s, t, n in zip(r.slots.tolist(), r.texts.tolist(), r.lengths.tolist()) if to[s] >= 0}
            yield pd.DataFrame(rows, columns=["host", "content", "slot", "text", "length"]).astype({"content": "int64", "slot": "int32", "text": "int64", "length": "int32"})

    aligned = seen.join(lone, "host").select("host", "content", "skeleton", "slots", "texts", "lengths", "reference").mapInPandas(align, "host string, content long, slot int, text long, length int")
    values = stage(spark, aligned.distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("shown"), F.max("length").alias("length")), "values")
    by_slot = values.groupBy("host", "slot").agg(F.sum("shown").alias("texts"), F.count("*").alias("distinct"), F.sum("length").cast("long").alias("length"))
    figures = by_slot.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "texts", "distinct", "length"))).alias("figures"))  # a row a reference node at most
    common = values.where(f"shown >= {LEAST_PAGES}").join(contents, "host").where(F.col("shown") >= LEAST_SHARE * F.col("contents"))
    fixed = common.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "text", (F.col("shown") >= ALWAYS * F.col("contents")).alias("always")))).alias("template"))  # at most a page's blocks over LEAST_SHARE
    out = stage(spark, reference.select("host", "reference").join(figures, "host").join(fixed, "host", "left"), "wrappers")
    drop(spark, seen, values, reference)
    return out


def main_texts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    pages = has(pages, "page_id", "url", "html")
    learned = wrappers(spark, pages)
    joined = pages.withColumn("host", host_of()).join(small_in_bytes(learned, F.length("reference") + 24 * F.size("figures") + 16 * F.greatest(F.size("template"), F.lit(0))), "host", "left").select("page_id", "url", "html", "host", "reference", "figures", "template")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper | None] = {}
        for b in batches:
            out = []
            if len(known) > 1000:
                known.clear()
            hosts, columns = b.column(3).to_pylist(), [b.column(k) for k in (4, 5, 6)]
            for k, (html, host) in enumerate(zip(b.column(2).to_pylist(), hosts)):
                if host not in known:
                    reference, figures, template = (c[k].as_py() for c in columns)
                    known[host] = None if reference is None else induced(reference, [tuple(f.values()) for f in figures], {(t["slot"], t["text"]): t["always"] for t in template or ()})
                page = folded(parse(html or ""))
                out.append(main_text(page, blocks(page), known[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
