"""Main text of web pages by wrapper induction over the pages of a host.

Pages of a host with the same set of root-to-node paths have one shape. Each shape of
enough pages has a reference tree, and the host has that of its most frequent shape (if
no shape is frequent, one chosen among all its pages). A reference is a page that lacks
the fewest nodes of the usual tree, in which each path is as often as on more than half
of the pages, so a stub or an odd page is none. Every page of the host is aligned with
the reference of the host, and with that of its shape, by simple tree matching (the
order-keeping matching of equal nodes with the greatest weight). Over all different
pages of the host it is then counted how often an aligned node holds which text. A text
that stands at a node on most pages is template there; what else stands at that node,
also on a page without that text, is a slot's content.

Elements that are furniture by their name or class (menus, footers, adverts, forms,
reader comments, ...) never are content, but a class makes no furniture of what holds an
article or most of a page without one. Some classes (menu, notice, social, ...) say too
little inside an article, or on a page without one: there they count if most of the text
is links, and otherwise repetition decides. The text of an article is never template but
there, and a page whose whole text would be template keeps it. The content is that of the
articles of a page, or else of its main element, if most of the text stands there, and
otherwise all.

The html is read twice, by scans. What moves between them are trees of hashes: a page's
labels and blocks without their texts, each different page of a host once. They are dealt
out by host and salt, so that a host with very many pages is spread, and follow the
references of the shapes that occur there. Counts are combined before they move.
"""

from __future__ import annotations

import html as entities
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from stockloom.llm.common import expand, written

#: A text is template if it stands at a node on this share of the pages aligned there, and on so many.
SHARE, LEAST_PAGES = 0.6, 5
#: Child lists of this length are matched with numpy; tables of more cells than this are not held.
WIDE, CELLS = 64, 1_000_000

_BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|title|textarea|noscript|template|iframe|svg|xmp|noframes"
_FURNITURE = frozenset("nav footer header aside form button select dialog menu".split())
#: Names in classes, ids and roles that make furniture, and those that need more evidence where they may name content.
_STRONG = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion cookie cookies consent
sidebar nav navbar navigation breadcrumb breadcrumbs masthead comment comments replies disqus share sharing newsletter subscribe popup modal login
footer complementary contentinfo""".split())
_WEAK = frozenset("banner notice notices menu header social search related".split())
#: Parts of names that say where or how an element stands, not what it is: site-nav-wrapper is a nav.
_PLAIN = frozenset("""wrap wrapper container box block area list section bar widget item items inner outer group row col column panel unit slot body
content link links icon icons button buttons top bottom left right main primary secondary site page global mobile desktop sticky fixed""".split())
#: What closes an open element of the same kind: start tag -> (closed elements, scope that protects them).
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
           "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
                    re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Parts of names that say what an element has or lacks, not what it is.
_MODIFIERS = frozenset("has with without no".split())
_PARTS = re.compile("[-_]+")
_DIGITS = re.compile("[0-9]+")
_HIDDEN = re.compile(r"""(?i)(?:^|\s)(?:hidden(?:[\s=/]|$)|style\s*=\s*["'][^"']*display\s*:\s*none)""")


def _hashed(text: str) -> int:
    return xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _kind(marks: str) -> int:
    """2 if some name is furniture, 1 if some name may be, else 0. The last part of a name that is not plain counts."""
    found = 0
    for name in marks.lower().split():
        parts = [p for p in _PARTS.split(name) if p and not p.isdigit()]
        if any(p in _MODIFIERS for p in parts[:-1]):
            continue
        whole = "".join(parts)
        while len(parts) > 1 and parts[-1] in _PLAIN:
            parts.pop()
        for x in (whole, parts[-1] if parts else ""):
            found = max(found, 2 * (x in _STRONG), x in _WEAK)
    return found


def _chosen(areas: list[int], sizes: list[int], dropped: set[int]) -> list[int]:
    """Numbers of the blocks that are content: those of the articles, or else of main elements, that hold most of the text, or else all.

    ``areas``: 0 outside, 1 in a main element, 2 in an article, 3 in an article of a main element.
    """
    rows = [i for i in range(len(sizes)) if i not in dropped]
    total = sum(sizes[i] for i in rows)
    for inside in ((2, 3), (1, 3)):
        part = [i for i in rows if areas[i] in inside]
        if 2 * sum(sizes[i] for i in part) > total:
            return part
    return rows


class Page:
    """A page's blocks of text that are not furniture, in order, and its tree of block elements.

    ``texts``, ``nodes``, ``areas`` (see ``_chosen``) and ``open`` (whether it may be
    template) are by block. ``labels``, ``children`` and ``paths`` are by node; node 0 is
    the root. Inside furniture no nodes are made. ``paths`` are hashes of the labels from
    the root, without ids and digits, which tell single pages apart.
    """

    def __init__(self, source: str):
        self.labels, self.children = ["#"], [[]]
        self.parents, self.paths = [0], [0]
        blocks: list[tuple[int, str, int, int]] = []  # node, text, area, characters in links
        regions: dict[int, int] = {}
        stack: list[tuple[str, int, bool, int]] = [("#", 0, False, 0)]
        classed: dict[int, int] = {}
        text: list[str] = []
        opened: Counter[str] = Counter()
        link, linked = False, 0

        def flush() -> None:
            nonlocal linked
            _, node, furniture, area = stack[-1]
            words = [] if furniture else entities.unescape("".join(text)).split()
            if words:
                blocks.append((node, " ".join(words), area, linked))
            text.clear()
            linked = 0

        def close(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
            if not any(opened[n] for n in names):
                return
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    flush()
                    opened.subtract(x[0] for x in stack[i:])
                    del stack[i:]
                    return
                if stack[i][0] in scope:
                    return

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                text.append(source[at:m.start()])
                linked += (m.start() - at) * link
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in _BLOCK:
                if tag == "br":
                    text.append(" ")
                elif tag == "a":
                    link = not m["end"]
                continue
            if m["end"]:
                close((tag,), ())
                continue
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            close(("p",), ("td", "th", "table"))
            flush()
            if tag in _VOID:
                continue
            _, parent, furniture, area = stack[-1]
            rest = m["rest"]
            found = _ATTRIBUTE.findall(rest) if rest else ()
            marks = " ".join(x for _, *v in found for x in v if x)
            if not furniture:
                node = len(self.labels)
                self.labels.append(f"{tag}.{marks}" if marks else tag)
                self.children.append([])
                self.children[parent].append(node)
                self.parents.append(parent)
                shown = " ".join(x for name, *v in found if name.lower() != "id" for x in v if x)
                self.paths.append(_hashed(f"{self.paths[parent]} {tag} {_DIGITS.sub('', shown)}"))
                if tag == "article" or tag == "main" or "main" in marks.split():
                    if tag == "article" and area < 2:
                        area += 2
                        regions[node] = area
                    elif tag != "article" and not area:
                        area = regions[node] = 1
                elif tag in _FURNITURE and not (tag == "header" and area > 1) or rest and _HIDDEN.search(rest):
                    furniture = True
                elif tag not in ("body", "html") and marks and (kind := _kind(marks)):
                    classed[node] = kind
            else:
                node = parent
            stack.append((tag, node, furniture, area))
            opened[tag] += 1
        if at < len(source):
            text.append(source[at:])
            linked += (len(source) - at) * link
        flush()
        doubtful = self.without(classed, regions, blocks) if classed else set()
        gone = {node for node in range(len(self.parents)) if self.children[node] is None}
        blocks = [b for b in blocks if b[0] not in gone]
        self.children = [kids or [] for kids in self.children]
        self.nodes, self.texts, self.areas = ([b[i] for b in blocks] for i in range(3))
        self.open = [area < 2 or node in doubtful for node, _, area, _ in blocks]

    def without(self, classed: dict[int, int], regions: dict[int, int], blocks: list[tuple[int, str, int, int]]) -> set[int]:
        """Takes out furniture by class (its nodes get no children, None) and returns the nodes whose class leaves a doubt.

        What holds an article or main element, or most of the text of a page that has none, is no furniture.
        """
        parents, n = self.parents, len(self.parents)
        sizes, links, holds, inside = [0] * n, [0] * n, [False] * n, [False] * n
        for node, text, area, linked in blocks:
            sizes[node] += len(text)
            links[node] += min(linked, len(text))
            inside[node] = area > 1
        for node in range(n - 1, 0, -1):  # children have greater numbers than their parents
            sizes[parents[node]] += sizes[node]
            links[parents[node]] += links[node]
            holds[parents[node]] |= holds[node] or node in regions
        article = [False] * n
        gone, doubt = [False] * n, [False] * n
        for node in range(1, n):
            article[node] = article[parents[node]] or regions.get(node, 0) > 1
            gone[node], doubt[node] = gone[parents[node]], doubt[parents[node]]
            kind = classed.get(node, 0)
            if not kind or gone[node] or holds[node] or not regions and 2 * sizes[node] > sizes[0]:
                continue
            if kind == 2 or 2 * links[node] >= sizes[node] or regions and not article[node]:
                gone[node] = True
            else:
                doubt[node] = True
        self.paths = [p for p, parent in zip(self.paths, parents, strict=True) if not gone[parent]]
        for node in range(1, n):
            if gone[node]:
                self.children[node] = None
        return {node for node in range(n) if doubt[node]}

    def shape(self) -> int:
        """The set of paths, as a hash."""
        return _hashed(" ".join(map(str, sorted(set(self.paths)))))

    def content(self, dropped: set[int]) -> str:
        """The text without the dropped blocks."""
        return "\n".join(self.texts[i] for i in _chosen(self.areas, list(map(len, self.texts)), dropped))

    def packed(self) -> bytes:
        """Tree and blocks with hashes for labels and texts."""
        columns = (np.array(self.parents, "<i4"), np.array([_hashed(x) for x in self.labels], "<i8"), np.array(self.nodes, "<i4"),
                   np.array([_hashed(t) for t in self.texts], "<i8"), np.array([len(t) for t in self.texts], "<i4"),
                   np.array(self.areas, "u1"), np.array(self.open, "u1"))
        return struct.pack("<ii", len(self.labels), len(self.nodes)) + b"".join(c.tobytes() for c in columns)


class Tree:
    """What ``Page.packed`` kept."""

    def __init__(self, data: bytes):
        n, blocks = struct.unpack_from("<ii", data)
        at, columns = 8, []
        for kind, size in (("<i4", n), ("<i8", n), ("<i4", blocks), ("<i8", blocks), ("<i4", blocks), ("u1", blocks), ("u1", blocks)):
            columns.append(np.frombuffer(data, kind, size, at).tolist())
            at += np.dtype(kind).itemsize * size
        parents, self.labels, self.nodes, self.hashes, self.sizes, self.areas, self.open = columns
        self.children: list[list[int]] = [[] for _ in parents]
        for node in range(1, n):
            self.children[parents[node]].append(node)


class _Matching:
    """Simple tree matching of two pages, without recursion.

    Equal subtrees of both pages have one number and match whole. Weights are kept for
    pairs of different subtrees, not of nodes, and the tables of child lists are not kept.
    """

    def __init__(self, page: Page | Tree, other: Page | Tree):
        self.numbers: dict[tuple, int] = {}
        self.labels: list = []
        self.below: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}
        self.own, self.others = self.numbered(page), self.numbered(other)

    def numbered(self, page: Page | Tree) -> list[int]:
        out = [0] * len(page.labels)
        for node in range(len(out) - 1, -1, -1):  # children have greater numbers than their parents
            kids = tuple(out[c] for c in page.children[node])
            key = (page.labels[node], kids)
            number = self.numbers.get(key)
            if number is None:
                number = self.numbers[key] = len(self.sizes)
                self.labels.append(key[0])
                self.below.append(kids)
                self.sizes.append(1 + sum(self.sizes[k] for k in kids))
            out[node] = number
        return out

    def trimmed(self, left: list | tuple, right: list | tuple) -> tuple[int, int, int]:
        """How many first children, and ends before the last ones, are equal: some best matching has them matched."""
        n, m, i = len(left), len(right), 0
        while i < n and i < m and left[i] == right[i]:
            i += 1
        while n > i and m > i and left[n - 1] == right[m - 1]:
            n, m = n - 1, m - 1
        return i, n, m

    def middle(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        i, n, m = self.trimmed(left, right)
        return left[i:n], right[i:m]

    def weight(self, x: int, y: int) -> int:
        """Of a pair that ``prepare`` has met, or that needs no table."""
        if x == y:
            return self.sizes[x]
        if self.labels[x] != self.labels[y]:
            return 0
        return self.known[x, y] if self.below[x] and self.below[y] else 1

    def open(self, x: int, y: int) -> bool:
        return x != y and bool(self.below[x] and self.below[y]) and self.labels[x] == self.labels[y] and (x, y) not in self.known

    def prepare(self, x: int, y: int) -> None:
        """The weight of a pair and of all it depends on, from below."""
        todo = [(x, y, False)] if self.open(x, y) else []
        while todo:
            x, y, ready = todo.pop()
            if (x, y) in self.known:
                continue
            left, right = self.middle(self.below[x], self.below[y])
            if ready:
                same = sum(self.sizes[k] for k in self.below[x]) - sum(self.sizes[k] for k in left)
                self.known[x, y] = 1 + same + self.last_row(left, right)[-1]
                continue
            todo.append((x, y, True))
            todo += [(u, v, False) for u in dict.fromkeys(left) if self.below[u] for v in dict.fromkeys(right) if self.open(u, v)]

    def rows(self, left: tuple[int, ...], right: tuple[int, ...]) -> Iterator[list[int] | np.ndarray]:
        """The table of best weights of the first children of both lists, row by row."""
        if len(right) < WIDE:
            row = [0] * (len(right) + 1)
            yield row
            for x in left:
                last, row, best = row, [0], 0
                for j, y in enumerate(right):
                    best = max(last[j + 1], best, last[j] + self.weight(x, y))
                    row.append(best)
                yield row
            return
        kinds, at = np.unique(np.array(right), return_inverse=True)
        kinds = kinds.tolist()
        weights: dict[int, np.ndarray] = {}
        row = np.zeros(len(right) + 1, np.int64)
        yield row
        for x in left:
            if x not in weights:
                if len(weights) * len(kinds) > CELLS:
                    weights.clear()
                weights[x] = np.array([self.weight(x, y) for y in kinds], np.int64)
            last, row = row, row.copy()
            np.maximum(last[1:], last[:-1] + weights[x][at], out=row[1:])
            np.maximum.accumulate(row, out=row)
            yield row

    def last_row(self, left: tuple[int, ...], right: tuple[int, ...]) -> list[int]:
        row: list[int] | np.ndarray = []
        for row in self.rows(left, right):  # noqa: B007
            pass
        return row if isinstance(row, list) else row.tolist()

    def pairs(self, left: tuple[int, ...], right: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the matched children in a best matching. Tables of many cells are halved (Hirschberg)."""
        out = []
        todo = [(0, len(left), 0, len(right))]
        while todo:
            i, n, j, m = todo.pop()
            if n == i or m == j:
                continue
            if n - i > 1 and (n - i) * (m - j) > CELLS:
                half = (i + n) // 2
                first, second = self.last_row(left[i:half], right[j:m]), self.last_row(left[half:n][::-1], right[j:m][::-1])[::-1]
                cut = j + max(range(m - j + 1), key=lambda k: first[k] + second[k])  # noqa: B023
                todo += [(i, half, j, cut), (half, n, cut, m)]
                continue
            rows = list(self.rows(left[i:n], right[j:m]))
            a, b = n - i, m - j
            while a and b:
                if rows[a][b] == rows[a - 1][b]:
                    a -= 1
                elif rows[a][b] == rows[a][b - 1]:
                    b -= 1
                else:
                    a, b = a - 1, b - 1
                    out.append((i + a, j + b))
        return out


def align(page: Page | Tree, other: Page | Tree) -> dict[int, int]:
    """Simple tree matching: node of ``page`` -> node of ``other``."""
    m = _Matching(page, other)
    m.prepare(m.own[0], m.others[0])
    out: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        out[a] = b
        left, right = page.children[a], other.children[b]
        if m.own[a] == m.others[b]:
            todo += zip(left, right, strict=True)
            continue
        x, y = [m.own[c] for c in left], [m.others[c] for c in right]
        i, n, k = m.trimmed(x, y)
        todo += zip(left[:i], right[:i], strict=True)
        todo += zip(left[n:], right[k:], strict=True)
        todo += [(left[i + u], right[i + v]) for u, v in m.pairs(tuple(x[i:n]), tuple(y[i:k]))]
    return out


def _host() -> F.Column:
    rest = F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.lower(rest)


def _trees():
    """Each different page of a host, once a task: its shape, its paths with their counts, and its tree."""
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen = set()
        for b in batches:
            for host, salt, html, tie, cut in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (host, tie) in seen:
                    continue
                seen.add((host, tie))
                page = Page(html)
                counts = sorted(Counter(page.paths).items())
                yield host, salt, tie, page.shape(), [p for p, _ in counts], [n for _, n in counts], cut, len(html), page.packed()
    return function


def _references(trees: DataFrame, least: int) -> DataFrame:
    """host, salt, shape, main, tree: the references for the pages of each host and salt.

    They are those of the frequent shapes that occur there, and (``main``) the host's.
    Where a host has no frequent shape, the shape is null.
    """
    # Pages with equal counts are one row from here on.
    kinds = trees.groupBy("host", "shape", "paths", "counts").agg(F.count("*").alias("n"), F.min(F.struct("cut", "size", "tie")).alias("first"))
    shapes = kinds.groupBy("host", "shape").agg(F.sum("n").alias("pages"))
    hosts = shapes.groupBy("host").agg(F.sum("pages").alias("all"), F.max(F.struct("pages", "shape")).alias("top"))
    frequent = shapes.filter(F.col("pages") >= least).withColumn("own", F.col("shape"))
    rare = hosts.filter(F.col("top.pages") < least).select("host", F.col("all").alias("pages"))
    grouped = (kinds.join(frequent, ["host", "shape"]).select("host", "own", "pages", "paths", "counts", "n", "first")
               .unionByName(kinds.join(rare, "host").select("host", F.lit(None).cast("long").alias("own"), "pages", "paths", "counts", "n", "first")))
    group = ["host", F.coalesce("own", F.lit(0)).alias("group"), F.col("own").isNull().alias("whole")]
    each = grouped.select(*group, "pages", "n", "first", F.explode(F.arrays_zip("paths", "counts")).alias("p")).select("*", "p.paths", "p.counts").drop("p")
    key = ["host", "group", "whole"]
    upward = Window.partitionBy(*key, "paths").orderBy(F.desc("counts"))
    usual = (each.groupBy(*key, "paths", "counts").agg(F.sum("n").alias("n"), F.max("pages").alias("pages")).withColumn("at_least", F.sum("n").over(upward))
             .filter(F.col("at_least") * 2 > F.col("pages")).groupBy(*key, "paths").agg(F.max("counts").alias("usual")))
    # Of all pages the one that has most of the usual nodes, then the fewest others, then the shortest whole one.
    had = (each.join(usual, [*key, "paths"], "left").groupBy(*key, "first")
           .agg(F.sum(F.least("counts", F.coalesce("usual", F.lit(0)))).alias("has"), F.sum("counts").alias("nodes")))
    best = had.groupBy(*key).agg(F.min(F.struct((-F.col("has")).alias("lacks"), "nodes", "first")).alias("best"))
    chosen = best.select("host", F.when(~F.col("whole"), F.col("group")).alias("shape"), F.col("best.first.tie").alias("tie"))
    # Written, so that Spark knows its size and need not shuffle the trees where it is small.
    chosen = written(chosen.join(hosts.select("host", F.when(F.col("top.pages") >= least, F.col("top.shape")).alias("top")), "host")
                     .select("host", "shape", "tie", F.col("shape").eqNullSafe(F.col("top")).alias("main")), "chosen")
    found = written(trees.select("host", "tie", "tree").join(chosen, ["host", "tie"]).groupBy("host", "shape", "main").agg(F.min("tree").alias("tree")), "references")
    places = trees.select("host", "salt", "shape").distinct()
    return (found.filter("main").join(places.select("host", "salt").distinct(), "host")
            .unionByName(found.filter("NOT main").join(places, ["host", "shape"]))).select("host", "salt", "shape", "main", "tree")


def _aligned():
    """Pages with the references they were aligned with, and the nodes of these at which their blocks stand (-1: nowhere).

    Rows (host, salt, main, shape, tie, tree): of each host and salt, the references come first, then the pages by tie.
    """
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, references, last = None, [], None
        for b in batches:
            for host, salt, main, shape, tie, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (host, salt):
                    key, references, last = (host, salt), [], None
                if main is not None:
                    references.append((main, shape, Tree(data)))
                elif tie != last:
                    last, page = tie, Tree(data)
                    found = [(s, align(page, tree)) for main, s, tree in references if main or s == shape]
                    at = np.array([[to.get(node, -1) for node in page.nodes] for _, to in found], "<i4")
                    blocks = struct.pack("<i", len(page.nodes)) + b"".join(np.array(c, k).tobytes() for c, k in (
                        (page.hashes, "<i8"), (page.sizes, "<i4"), (page.areas, "u1"), (page.open, "u1")))
                    yield host, salt, tie, [s for s, _ in found], blocks + at.tobytes()
    return function


def _blocks(data: bytes, references: int) -> tuple[list, list, list, list, list[list[int]]]:
    """Hashes, sizes, areas, open, and by reference the nodes, of the blocks of an aligned page."""
    n, = struct.unpack_from("<i", data)
    at, columns = 4, []
    for kind in ("<i8", "<i4", "u1", "u1"):
        columns.append(np.frombuffer(data, kind, n, at).tolist())
        at += np.dtype(kind).itemsize * n
    return *columns, np.frombuffer(data, "<i4", n * references, at).reshape(references, n).tolist()


def _counted():
    """host, shape, node, text for all texts that could be template, and with a null text for each page that has some there."""
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for host, shapes, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hashes, _, _, free, places = _blocks(data, len(shapes))
                for shape, nodes in zip(shapes, places, strict=True):
                    texts = {(node, text) for node, text, f in zip(nodes, hashes, free, strict=True) if f and node >= 0}
                    for node, text in texts:
                        yield host, shape, node, text
                    for node in {node for node, _ in texts}:
                        yield host, shape, node, None
    return function


def _decided():
    """host, tie, kept: numbers of the content's blocks of each page that loses some to the template.

    Rows (host, salt, shape, nodes, texts, tie, shapes, data): of each host and salt, the templates come first.
    """
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, templates = None, {}
        for b in batches:
            for host, salt, shape, nodes, texts, tie, shapes, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (host, salt):
                    key, templates = (host, salt), {}
                if nodes is not None:
                    templates[shape] = set(zip(nodes, texts, strict=True))
                    continue
                hashes, sizes, areas, free, places = _blocks(data, len(shapes))
                dropped = set()
                for s, at in zip(shapes, places, strict=True):
                    fixed = templates.get(s, ())
                    dropped |= {i for i, (node, text) in enumerate(zip(at, hashes, strict=True)) if free[i] and (node, text) in fixed}
                if dropped and len(dropped) < len(hashes):
                    yield host, tie, _chosen(areas, sizes, dropped)
    return function


def _extracted():
    """page_id, url, host, tie, the texts of all blocks, and the numbers of the content's if no template is known."""
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for page_id, url, host, tie, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                page = Page(html)
                yield page_id, url, host, tie, page.texts, _chosen(page.areas, list(map(len, page.texts)), set())
    return function


def main_text(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null and empty html give an empty text. Pages without a host share the host "".
    Repeated rows, and pages of a host with the same html, give a row each but count as
    one page. A host with fewer than ``least`` different pages has no template; its pages
    are read by element names and classes alone.
    """
    spark = pages.sparkSession
    # A host's pages are dealt out by as many salts as there are shuffle partitions, and its references to the
    # salts that occur: no task gets a large host whole, and small hosts are not copied.
    salt = F.pmod("tie", F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    own = (pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
           .withColumn("tie", F.xxhash64("html")).withColumn("salt", salt))
    ddl = "host string, salt int, tie long, shape long, paths array<long>, counts array<int>, cut boolean, size int, tree binary"
    trees = written(expand(own.select("host", "salt", "html", "tie", (~F.col("html").rlike(r"(?i)</html>\s*$")).alias("cut")), ddl, _trees), "trees")

    dealt = (_references(trees, least).select("host", "salt", "main", "shape", F.lit(None).cast("long").alias("tie"), "tree")
             .unionByName(trees.select("host", "salt", F.lit(None).cast("boolean").alias("main"), "shape", "tie", "tree"))
             .repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("main").isNull(), "tie"))
    aligned = written(expand(dealt, "host string, salt int, tie long, shapes array<long>, data binary", _aligned), "aligned")

    seen = (expand(aligned.select("host", "shapes", "data"), "host string, shape long, node int, text long", _counted, rows=50_000)
            .groupBy("host", "shape", "node", "text").agg(F.count("*").alias("n")))
    at = Window.partitionBy("host", "shape", "node")
    fixed = (seen.withColumn("pages", F.max(F.when(F.col("text").isNull(), F.col("n"))).over(at))
             .filter(F.col("text").isNotNull() & (F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))))
    template = fixed.groupBy("host", "shape").agg(F.collect_list("node").alias("nodes"), F.collect_list("text").alias("texts"))
    places = aligned.select("host", "salt", F.explode("shapes").alias("shape")).distinct()
    here = places.alias("p").join(template.alias("t"), (F.col("p.host") == F.col("t.host")) & F.col("p.shape").eqNullSafe(F.col("t.shape")))
    rows = (here.select("p.host", "p.salt", "p.shape", "nodes", "texts").unionByName(aligned, allowMissingColumns=True)
            .repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("nodes").isNull())
            .select("host", "salt", "shape", "nodes", "texts", "tie", "shapes", "data"))
    # Written, so that Spark knows its size: the texts move only if it is large.
    decided = written(expand(rows, "host string, tie long, kept array<int>", _decided), "decided")

    texts = expand(own.select("page_id", "url", "host", "tie", "html"), "page_id long, url string, host string, tie long, texts array<string>, own array<int>", _extracted)
    both = texts.join(decided, ["host", "tie"], "left").withColumn("kept", F.coalesce("kept", "own"))
    text = F.array_join(F.transform("kept", lambda i: F.get("texts", i)), "\n")
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
