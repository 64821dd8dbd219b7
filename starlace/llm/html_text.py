"""HTML extraction by composite text density.

A page becomes a tree of tags. Every node has the characters and tags below it, and those of
them that belong to links; its density is characters per tag, weighed down where links make up
much of it. A node's density sum is that of its children. The threshold is the least density on
the path from the body to the node with the largest density sum. From the body down, a node
that reaches the threshold marks, of itself and all below it, the node with the largest density
sum as content (the first of equals); a node without children has no sum and marks nothing, and
where nothing is marked the body is the content. The text is that of all marked nodes in order,
one line for each block.

Defined results: null or empty HTML gives an empty text; so does a page without any text.
Broken markup is read as browsers would roughly do: unknown or unclosed tags end with their
parent, stray end tags are passed over, a page without a body is its own body. Scripts, styles,
templates, comments and the head aren't text. Pages are read whole; repeated pages give equal
texts; other columns are carried along.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import kept_names, own, quoted

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript textarea title iframe svg math object".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_SILENT = _RAW | {"head", "select", "button"}
_BLOCK = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "li", "dd", "dt"}
_SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
_HEAD = frozenset("title meta link base style script head html".split())


class _Ahead:
    """Where a pattern next occurs, for places that only grow: no stretch is searched twice."""

    def __init__(self, pattern: str, source: str):
        self.search, self.source, self.seen, self.next = re.compile(pattern).search, source, -1, -1

    def __call__(self, at: int) -> int:
        if self.next < at or at < self.seen:
            m = self.search(self.source, at)
            self.seen, self.next = at, m.start() if m else len(self.source)
        return self.next


class Marks:
    """Comments, declarations and tags of a page, in order: (start, stop, "/" of an end tag, name,
    the rest of the tag). A tag ends at the first > outside quotes; where there is none it is text."""

    _END = re.compile("[>\"']")

    def __init__(self, source: str):
        self.source, self.dead = source, set()
        self.name_end, self.special = _Ahead(r"[\s/>]", source), _Ahead("[>\"']", source)

    def _stop(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; -1 if nowhere."""
        source, walk, p = self.source, [], self.special(at)
        while p < len(source) and p not in self.dead:
            if source[p] == ">":
                return p
            walk.append(p)
            q = source.find(source[p], p + 1)
            m = self._END.search(source, q + 1) if q >= 0 else None
            if not m:
                break
            p = m.start()
        self.dead.update(walk)  # no way from these quotes leads to an end
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str]]:
        source, n = self.source, len(self.source)
        at = source.find("<")
        while 0 <= at < n - 1:
            c = source[at + 1]
            stop = -1
            if c in "!?":
                if source.startswith("<!--", at):
                    stop = source.find("-->", at + 4)
                    stop = n if stop < 0 else stop + 3
                else:
                    stop = source.find(">", at)
                    stop = n if stop < 0 else stop + 1
                got = at, stop, "", "", ""
            else:
                first = at + 1 + (c == "/")
                if source[first : first + 1].isalpha() and source[first].isascii():
                    end = self.name_end(first)
                    stop = self._stop(end) + 1 or -1
                    if stop > 0:
                        got = at, stop, "/" * (c == "/"), source[first:end], source[end : stop - 1]
            if stop < 0:
                at = source.find("<", at + 1)
                continue
            at = (yield got) or stop  # or where the reader has got to
            at = source.find("<", at)


class Tree:
    """Nodes in document order; a node's parent comes before it. Text pieces belong to a node."""

    def __init__(self, source: str):
        self.tag, self.parent, self.last = ["#root"], [-1], [0]
        self.pieces: list[tuple[int, str]] = []  # (node, text)
        self.stack, self.open, self.blocks = [0], {}, []  # open nodes; their depths by name; depths of blocks
        self.silent = at = 0
        marks = iter(Marks(source))
        mark = next(marks, None)
        while mark:
            start, stop, end, name, rest = mark
            self._text(source[at:start])
            at = stop
            if name:
                at = self._tag(source, stop, end, name.lower(), rest)
            try:
                mark = marks.send(at)
            except StopIteration:
                mark = None
        self._text(source[at:])
        del self.stack, self.open, self.blocks
        for k in range(len(self.tag) - 1, 0, -1):
            p = self.parent[k]
            if self.last[k] > self.last[p]:
                self.last[p] = self.last[k]


    def _text(self, text: str) -> None:
        if not text or self.silent:
            return
        if not text.isspace():
            self.pieces.append((self.stack[-1], text))
        elif self.pieces:
            self.pieces.append((self.stack[-1], " "))

    def _depth(self, names) -> int:
        """The innermost open tag of these names; 0 if none is open."""
        return max((self.open[t][-1] for t in names if self.open.get(t)), default=0)

    def _close(self, depth: int) -> None:
        for k in reversed(self.stack[depth:]):
            self.silent -= self.tag[k] in _SILENT
            self.open[self.tag[k]].pop()
        del self.stack[depth:]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def _tag(self, source: str, at: int, end: str, name: str, rest: str) -> int:
        """Reads a tag; where to go on."""
        if end:
            if depth := self._depth((name,)):
                self._close(depth)
            return at
        if name in ("html", "body") and self.open.get(name):
            return at
        if name not in _HEAD and self.tag[self.stack[-1]] == "head":  # an unclosed head ends here
            self._close(len(self.stack) - 1)
        if name in _CLOSES_P and self.blocks and self.tag[self.stack[self.blocks[-1]]] == "p":
            self._close(self.blocks[-1])
        if name in _SIBLINGS and (depth := self._depth(_SIBLINGS[name])) > self._depth(_SCOPE[name]):
            self._close(depth)
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.last.append(node)
        if name == "br" or name == "hr":
            self.pieces.append((node, "\n"))
        if name in _VOID or rest.endswith("/") and name not in _BLOCK and name != "a":
            return at
        if name in _RAW:
            m = _RAW_END[name].search(source, at)
            return m.end() if m else len(source)
        self.silent += name in _SILENT
        self.open.setdefault(name, []).append(len(self.stack))
        if name in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)
        return at


def _size(text: str) -> int:
    """Characters of a piece as they are read: entities are one, white space none."""
    if "&" in text:
        text = entities.unescape(text)
    return len(text) - sum(map(text.count, " \n\t\r\f\v"))


def densities(tree: Tree) -> tuple[list[float], list[float], int]:
    """Density and density sum of every node, and the body."""
    n = len(tree.tag)
    chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
    for k, text in tree.pieces:
        chars[k] += _size(text)
    inside = [False] * n
    for k in range(1, n):
        inside[k] = tree.tag[k] == "a" or inside[tree.parent[k]]
    for k in range(n):
        if inside[k]:
            linked[k] = chars[k]
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        tags[p] += tags[k] + 1
        links[p] += links[k] + inside[k]
    body = tree.tag.index("body") if "body" in tree.tag else 0
    whole, ratio = max(1, chars[body]), linked[body] / max(1, chars[body])
    density, total = [0.0] * n, [0.0] * n
    for k in range(n):
        c = chars[k]
        if not c:
            continue
        t, lc, lt = max(1, tags[k]), max(1, linked[k]), max(1, links[k])
        base = log(c / max(1, c - linked[k]) * linked[k] + ratio * c + e)
        x = c / lc * t / lt
        density[k] = max(0.0, c / t * log(max(x, 1e-9)) / log(base)) if base > 1 and log(base) > 0 else 0.0
    for k in range(1, n):
        total[tree.parent[k]] += density[k]
    return density, total, body


def content(tree: Tree) -> list[int]:
    """The marked nodes, none inside another, in order."""
    density, total, body = densities(tree)
    n = len(tree.tag)
    top = max(range(body, tree.last[body] + 1), key=lambda k: (total[k], -k))
    threshold, k = density[top], top
    while k != body:
        k = tree.parent[k]
        threshold = min(threshold, density[k])
    # the largest sum at or below each node
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        if total[best[k]] > total[best[p]] or total[best[k]] == total[best[p]] and best[k] < best[p]:
            best[p] = best[k]
    marked, stack = set(), [body]
    children: dict[int, list[int]] = {}
    for k in range(1, n):
        children.setdefault(tree.parent[k], []).append(k)
    while stack:
        k = stack.pop()
        if density[k] >= threshold and density[k] > 0:
            if total[best[k]] > 0:
                marked.add(best[k])
            stack += children.get(k, ())
    if not marked:
        marked.add(body)
    out: list[int] = []
    for k in sorted(marked):
        if not out or k > tree.last[out[-1]]:
            out.append(k)
    return out


_RUNS = re.compile(r"[ \t\r\f\v\n ]+")


def extract(source: str | None) -> str:
    if not source:
        return ""
    tree = Tree(source)
    if not tree.pieces:
        return ""
    lines: list[str] = []
    marked = content(tree)
    block = [0] * len(tree.tag)
    for k in range(1, len(tree.tag)):
        block[k] = k if tree.tag[k] in _BLOCK else block[tree.parent[k]]
    at, now, parts = 0, -1, []

    def close() -> None:
        line = _RUNS.sub(" ", entities.unescape("".join(parts))).strip()
        if line:
            lines.append(line)
        parts.clear()

    for k, text in tree.pieces:
        while at < len(marked) and k > tree.last[marked[at]]:
            at += 1
        if at == len(marked):
            break
        if k < marked[at]:
            continue
        if block[k] != now:
            close()
            now = block[k]
        if tree.tag[k] not in ("br", "hr"):
            parts.append(text)
    close()
    return "\n".join(lines)


def text_of(html: Column) -> Column:
    def make(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for page in pages:
            yield pa.array([extract(p.as_py()) for p in page], pa.string())

    return F.arrow_udf(make, T.StringType()).asNondeterministic()(html)


@kept_names
def extract_pages(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with one more column, the text of their content."""
    return pages.select(*own(pages, into), text_of(F.col(quoted(html))).alias(into))


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text")
