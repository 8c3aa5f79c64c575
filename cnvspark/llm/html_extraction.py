"""Main text of web pages by wrapper induction.

Pages of one host share a template. Spark brings them together, in groups where a host has many; a task makes a small tree of
each and aligns it with the one before it in its group by simple tree matching. An aligned node whose text is the same in both is a vote for template,
a different text a vote for a slot. Spark sums up the votes by host and path over all tasks. The container to which the
varying text of a host leads is its content slot; inside it, nodes with constant text are template. Names of tags and
classes do not choose the slot; they only tell what else inside it is no article text.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cnvspark.llm.common import cut, free, kept

# HTML's elements by how they hold text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video".split())
HIDDEN = RAW | frozenset("head title nav header footer aside menu button select option textarea input label dialog".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CONTAINER = frozenset("article main section div td body html center blockquote".split())
_NO_TEXT = RAW | {"head", "title", "textarea", "select", "option", "input"}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Containers that get a name by what they hold.
_UNNAMED = frozenset(("div", "section", "td", "center"))
ENDS_P = BLOCK - {"body", "html", "caption", "tr", "tbody", "thead", "tfoot", "legend"}
#: Class, id and role words of what is no article text.
BOILERPLATE = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navigation navbar menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social comment comments reply replies disqus respond pagination pager toolbar search skip copyright".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDES = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Alignments of up to so many pairs of kids are made in plain loops, larger ones by rows of numpy.
SMALL = 400
#: Hosts of many pages: so many are broadcast at most, more are joined.
MANY_HOSTS = 100_000
_LABEL = re.compile(r"[^.:!]*")
_WORD = re.compile(r"[a-z]+")


class Node:
    """An element: its label, whether it is no article text by its tag, or (``named``, ``!`` in its label) by its names alone, its
    children and strings in order. Of a container only whole names count, of others their parts too.
    """

    __slots__ = ("tag", "label", "hidden", "named", "items")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.items = tag, []
        names = [(k.lower(), a or b or c) for k, a, b, c in _NAMES.findall(attributes)] if "=" in attributes else []
        words = {w for _, value in names for w in (value.lower().split() if tag in CONTAINER else _WORD.findall(value.lower()))}
        self.hidden = tag in HIDDEN or bool(attributes) and bool(_HIDES.search(attributes))
        self.named = not self.hidden and (tag == "form" or bool(words & BOILERPLATE))
        first = next((value.split()[0].lower() for k, value in names if k in ("class", "id") and value.split()), "")
        self.label = tag + ("." + re.sub(r"[\d!/]+", "#", first) if first else "") + ("!" if self.named else "")

    def describe(self, kids: list[tuple[bool, int, int]]) -> tuple[bool, int, int]:
        """Whether the element holds a heading, its characters and those of links, from the same of its child elements. A
        container without a name of its own is named by these: ``:h`` with a heading, ``:a`` if it is links alone, else ``:t``.
        """
        own = sum(len(x) for x in self.items if isinstance(x, str) and not x.isspace())
        heading = self.tag in _HEADINGS or any(k[0] for k in kids)
        chars = own + sum(k[1] for k in kids)
        links = chars if self.tag == "a" else sum(k[2] for k in kids)
        if self.label in _UNNAMED:
            self.label += ":h" if heading else ":a" if chars and links == chars else ":t"
        return heading, chars, links


def _closes(new: str, open_tag: str) -> bool:
    """Whether a start tag ends an open element whose end tag may be left out."""
    if open_tag == "p":
        return new in ENDS_P
    return (new in ("li",) and open_tag == "li") or (new in ("dt", "dd") and open_tag in ("dt", "dd")) or (new in ("td", "th") and open_tag in ("td", "th")) or (new == "tr" and open_tag in ("td", "th", "tr")) or (new == "option" and open_tag == "option")


def parse(text: str) -> Node:
    """The tree of a page; it never fails, whatever the markup."""
    root = Node("#", "")
    stack, made, at, n = [root], [root], 0, len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        at = m.end()
        close, tag, attributes = m.group(1), m.group(2), m.group(3)
        if tag is None:
            s = m.group()
            if not (s.startswith("<!") or s.startswith("<?")):
                stack[-1].items.append(s)
            continue
        tag = tag.lower()
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body", "table", "td") and tag in ("p", "b", "i", "a", "span", "em", "strong", "li"):
                    break  # an end tag without its start does not end what is around it
            continue
        while len(stack) > 1:
            k = next((k for k in range(len(stack) - 1, 0, -1) if _closes(tag, stack[k].tag)), 0)
            inner = {x.tag for x in stack[k + 1 :]}
            if not k or inner & (BLOCK - {"p"}):
                break
            del stack[k:]
        node = Node(tag, attributes)
        stack[-1].items.append(node)
        made.append(node)
        if tag in VOID or attributes.endswith("/") and tag in RAW:
            continue
        if tag in RAW or tag in ("title", "textarea"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = end.end() if end else n
            continue
        if len(stack) < 400:
            stack.append(node)
    said: dict[int, tuple[bool, int, int]] = {}
    for node in reversed(made):  # what is inside an element was made after it
        said[id(node)] = node.describe([said.pop(id(x)) for x in node.items if not isinstance(x, str)])
    return root


def host(url: Column) -> Column:
    """The host of an address in lower case; without one, empty."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))


class Tree:
    """A tree for alignment: like neighbours are one node; ``text`` is what the node itself holds."""

    __slots__ = ("label", "path", "text", "chars", "kids", "hidden", "shape")

    def __init__(self, node: Node, path: str, hidden: bool):
        self.label, self.path = node.label, f"{path}/{node.label}" if path else node.label
        self.hidden = hidden or node.hidden
        self.kids: list[Tree] = []
        strings: list[str] = []
        self._take(node, strings)
        self.text = hash(" ".join(strings)) if strings else 0
        self.chars = sum(map(len, strings))

    def _take(self, node: Node, strings: list[str]) -> None:
        for x in node.items:
            if isinstance(x, str):
                if not x.isspace():
                    strings.append(x.strip())
            elif x.tag in BLOCK or x.tag in RAW or x.hidden or x.named or x.tag == "td":
                kid = Tree(x, self.path, self.hidden)
                if self.kids and self.kids[-1].label == kid.label:
                    self.kids[-1]._join(kid)
                else:
                    self.kids.append(kid)
            else:
                self._take(x, strings)

    def _join(self, other: Tree) -> None:
        self.text = hash((self.text, other.text))
        self.chars += other.chars
        for kid in other.kids:
            same = next((k for k in self.kids if k.label == kid.label), None)
            if same is None:
                self.kids.append(kid)
            else:
                same._join(kid)


class _Matching:
    """Simple tree matching of two trees: weights by shape, so that like subtrees are compared once."""

    def __init__(self, *trees: Tree):
        self.shapes: dict[tuple, int] = {}
        self.known: dict[tuple[int, int], int] = {}
        for tree in trees:
            order, todo = [], [tree]
            while todo:
                order.append(t := todo.pop())
                todo += t.kids
            for t in reversed(order):
                t.shape = self.shapes.setdefault((t.label, *(k.shape for k in t.kids)), len(self.shapes))

    def weight(self, a: Tree, b: Tree) -> int:
        """The greatest number of node pairs that keeps labels, order and descent."""
        if a.label != b.label:
            return 0
        if not a.kids or not b.kids:
            return 1
        key = (a.shape, b.shape)
        if key not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            n, m = len(a.kids), len(b.kids)
            if n * m <= SMALL:
                best = int(self._table(a, b)[n][m]) + 1
            else:
                for row in self._rows(a, b):
                    pass
                best = int(row[-1]) + 1
            self.known[key] = best
        return self.known[key]

    def pairs(self, a: Tree, b: Tree) -> list[tuple[Tree, Tree]]:
        """The pairs of a greatest matching."""
        out, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            if x.label == y.label:
                out.append((x, y))
                if x.kids and y.kids:
                    todo += [(x.kids[i], y.kids[j]) for i, j in self._chosen(x, y)]
        return out

    def _table(self, a: Tree, b: Tree) -> list[list[int]]:
        m, rows = len(b.kids), [[0] * (len(b.kids) + 1)]
        for x in a.kids:
            last, row = rows[-1], [0] * (m + 1)
            for j, y in enumerate(b.kids):
                row[j + 1] = max(last[j + 1], row[j], last[j] + (self.weight(x, y) if x.label == y.label else 0))
            rows.append(row)
        return rows

    def _rows(self, a: Tree, b: Tree, first: int = 0, row: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """The rows of the alignment's table after ``first``, each one array operation over the kids of ``b``."""
        one_each = list({y.shape: y for y in b.kids}.values())
        place = {y.shape: k for k, y in enumerate(one_each)}
        of = np.array([place[y.shape] for y in b.kids])
        by_label: dict[str, list[int]] = {}
        for k, y in enumerate(one_each):
            by_label.setdefault(y.label, []).append(k)
        row = np.zeros(len(b.kids) + 1, np.int32) if row is None else row
        weights: dict[int, np.ndarray] = {}
        for x in a.kids[first:]:
            if x.shape not in weights:
                if len(weights) * len(one_each) > 4_000_000:
                    weights.clear()
                weights[x.shape] = np.zeros(len(one_each), np.int32)
                for k in by_label.get(x.label, ()):
                    weights[x.shape][k] = self.weight(x, one_each[k])
            new = np.zeros_like(row)
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[x.shape][of]), out=new[1:])
            row = new
            yield row

    def _chosen(self, a: Tree, b: Tree) -> list[tuple[int, int]]:
        """Positions of the kids that a greatest matching pairs. Of a large table only every so many rows are held, and the ones
        between are worked out again on the way back, so memory grows with the kids times the root of their number.
        """
        i, j, out = len(a.kids), len(b.kids), []
        step, held = i, {}
        if i * j > SMALL:
            step = math.isqrt(i - 1) + 1
            held = {k: row for k, row in enumerate(self._rows(a, b), 1) if k % step == 0}
        held[0] = np.zeros(j + 1, np.int32)
        while i and j:
            low = (i - 1) // step * step  # rows low to i are needed next
            if step == len(a.kids) and not low:
                table = self._table(a, b)
            else:
                table = [held[low], *itertools.islice(self._rows(a, b, low, held[low]), i - low)]
            while i > low and j:
                row, above = table[i - low], table[i - 1 - low]
                if row[j] == above[j]:
                    i -= 1
                elif row[j] == row[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
        return out


def match_trees(a: Tree, b: Tree) -> tuple[int, list[tuple[Tree, Tree]]]:
    """Simple tree matching: the greatest number of node pairs that keeps labels, order and descent, and the pairs. Exact at any size:
    time grows with the product of the kids of paired nodes, memory with their number times its root.
    """
    matching = _Matching(a, b)
    return matching.weight(a, b), matching.pairs(a, b)


_VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("hidden", pa.bool_()), ("same", pa.int64()), ("differ", pa.int64()), ("chars", pa.int64())])


def template_votes(pages: DataFrame, group: int = 128) -> DataFrame:
    """(host, path, hidden, same, differ, chars) over all rows of (host, html).

    Pages go to groups of one host, about ``group`` in each, and are aligned with the one before them in the order of their
    hashes, so votes do not depend on where rows lie. A task holds one tree, and the votes of few groups at a time; pages
    that say nothing but what the one before said are no evidence.
    """
    name, text = (pages[c] for c in pages.columns)
    rows = pages.select(name.alias("host"), F.coalesce(text, F.lit("")).alias("html"))
    large = kept(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group), "hosts")
    rows = rows.join(F.broadcast(large) if large.count() <= MANY_HOSTS else large, "host", "left").withColumn("hash", F.xxhash64("html"))
    rows = rows.withColumn("part", F.pmod(F.col("hash"), F.coalesce(F.ceil(F.col("n") / group), F.lit(1)).cast("long")))
    rows = rows.select("host", "html", "part", "hash").repartition("host", "part").sortWithinPartitions("host", "part", "hash")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, old = None, None
        votes: dict[tuple[str, str], list] = {}

        def table() -> pa.RecordBatch:
            keys, values = list(votes), list(votes.values())
            return pa.record_batch([[k[0] for k in keys], [k[1] for k in keys], *([v[i] for v in values] for i in range(4))], schema=_VOTES)

        for batch in batches:
            for name, text, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tree = Tree(parse(text or ""), "", False)
                todo = [tree]
                while todo:
                    t = todo.pop()
                    todo += t.kids
                    if t.chars:
                        votes.setdefault((name, t.path), [t.hidden, 0, 0, 0])[3] += t.chars
                if last == (name, part):
                    _, pairs = match_trees(old, tree)
                    voters = [(x, y) for x, y in pairs if x.chars or y.chars]
                    if any(x.text != y.text for x, y in voters):
                        for x, y in voters:
                            votes.setdefault((name, y.path), [y.hidden, 0, 0, 0])[1 if x.text == y.text else 2] += 1
                last, old = (name, part), tree
                if len(votes) > 100_000:
                    yield table()
                    votes.clear()
        if votes:
            yield table()

    found = rows.select("host", "html", "part").mapInArrow(vote, "host string, path string, hidden boolean, same long, differ long, chars long")
    return found.groupBy("host", "path").agg(F.max("hidden").alias("hidden"), F.sum("same").alias("same"), F.sum("differ").alias("differ"), F.sum("chars").alias("chars"))


def choose(votes: list[tuple[str, bool, int, int, int]], share: float = 0.6, least_votes: int = 5, constant: float = 0.9) -> tuple[str, frozenset[str], frozenset[str]]:
    """The content slot of a host, the template paths inside it, and the paths whose names hide nothing, from its
    (path, hidden, same, differ, chars).

    A path whose text is constant in most aligned pairs is template; all other text varies. The slot is found from the
    root downwards: the step is to the container that holds at least ``share`` of the varying text and all varying
    headings, as long as there is one. What names say does not count here, so an article in an element named like a menu
    is found, and menus, adverts and footers whose texts vary are left beside it. A host without votes, as of one page,
    is judged by its text alone.
    """
    template = constant_paths(votes, least_votes, constant)
    under: dict[str, int] = {}
    headings: dict[str, int] = {}
    for path, _, _, _, chars in votes:
        if path in template or not chars or _never_text(path):
            continue
        heading = _tag(path) in _HEADINGS
        for p in _above(path):
            under[p] = under.get(p, 0) + chars
            headings[p] = headings.get(p, 0) + heading
    kids: dict[str, list[str]] = {}
    for p in under:
        kids.setdefault(p.rpartition("/")[0], []).append(p)
    slot = at = max(kids.get("", [""]), key=lambda p: under.get(p, 0))
    while at in kids:
        at = max(kids[at], key=lambda p: (under[p], p))
        if under[at] < share * under[slot] or headings[at] < headings[slot]:
            break
        if _tag(at) in CONTAINER:
            slot = at
    dropped = frozenset(p for p in template if p.startswith(f"{slot}/"))
    inside = {p: chars for p, hidden, _, _, chars in votes if f"{p}/".startswith(f"{slot}/") and not hidden}
    same_inside = dropped & inside.keys()
    if sum(inside[p] for p in same_inside) > 0.5 * sum(inside.values()):
        dropped -= same_inside  # a host of near-copies: what is constant in most of its text is content
    return slot, dropped, unhidden(votes, template) | frozenset(_above(slot))


def _tag(path: str) -> str:
    """The tag of a path's last element."""
    return _LABEL.match(path.rsplit("/", 1)[-1]).group()


def _never_text(path: str) -> bool:
    """Whether a path lies in the head or in an element whose content is no text."""
    return any(_tag(x) in _NO_TEXT for x in path.split("/"))


def constant_paths(votes: list[tuple[str, bool, int, int, int]], least_votes: int = 5, constant: float = 0.9) -> frozenset[str]:
    """The paths whose text is the same in most aligned pairs."""
    return frozenset(p for p, _, same, differ, _ in votes if same + differ >= least_votes and same >= constant * (same + differ))


def unhidden(votes: list[tuple[str, bool, int, int, int]], template: frozenset[str], most: float = 0.5) -> frozenset[str]:
    """The paths named as no article text that hold at least ``most`` of the text that varies, so their names do not count."""
    under: dict[str, int] = {}
    total = 0
    for path, hidden, _, _, chars in votes:
        if not hidden and path not in template:
            total += chars
            for p in _above(path):
                if p.endswith("!"):
                    under[p] = under.get(p, 0) + chars
    return frozenset(p for p, chars in under.items() if chars >= most * total)


def _above(path: str) -> list[str]:
    """A path and all paths above it."""
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(1, len(parts) + 1)]


def main_text(text: str, slot: str, template: frozenset[str], shown: frozenset[str] = frozenset()) -> str:
    """The blocks of a page's content slot, one a line. A page without the slot is read from its ``article``, ``main`` or body.
    Names and tags hide nothing at the paths ``shown``.
    """
    root = parse(text)
    found: list[tuple[Node, str]] = []
    named: dict[str, list[tuple[Node, str]]] = {"article": [], "main": [], "body": [], "#": [(root, "#")]}
    todo = [(root, "#", False)]
    while todo:
        node, path, hidden = todo.pop()
        if path == slot and not hidden:
            found.append((node, path))
            continue
        if node.tag in named and node is not root and not hidden:
            named[node.tag].append((node, path))
        for x in reversed(node.items):
            if not isinstance(x, str):
                below = f"{path}/{x.label}"
                todo.append((x, below, hidden or (x.hidden or x.named) and below not in shown))
    if not found:
        found = next(x for x in (named["article"], named["main"], named["body"], named["#"]) if x)
        template = frozenset()
    lines: list[str] = []
    part: list[str] = []

    def end() -> None:
        line = " ".join(html.unescape("".join(part)).split())
        part.clear()
        if line:
            lines.append(line)

    work: list[tuple[Node | str | None, str]] = [x for x in reversed(found)]
    while work:
        node, path = work.pop()
        if node is None:
            end()
        elif isinstance(node, str):
            part.append(node)
        elif node.tag in ("br", "td", "th", "wbr"):
            part.append("" if node.tag == "wbr" else " ")
            work += [(x, path if isinstance(x, str) else f"{path}/{x.label}") for x in reversed(node.items)]
        elif path in template or (node.hidden or node.named) and path not in shown:
            end()
        else:
            block = node.tag in BLOCK
            if block:
                end()
                work.append((None, ""))
            work += [(x, path if isinstance(x, str) else f"{path}/{x.label}") for x in reversed(node.items)]
    end()
    return "\n".join(lines)


_WRAPPER = pa.struct([("slot", pa.string()), ("template", pa.list_(pa.string())), ("shown", pa.list_(pa.string()))])


def induce(votes: DataFrame) -> DataFrame:
    """(host, wrapper) of each host from its votes: the slot, the template inside it and what names do not hide."""

    def of_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                slot, template, shown = choose([tuple(v.values()) for v in found.as_py()])
                yield pa.record_batch([pa.array([name]), pa.array([{"slot": slot, "template": sorted(template), "shown": sorted(shown)}], _WRAPPER)], ["host", "wrapper"])

    gathered = votes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "hidden", "same", "differ", "chars"))).alias("votes"))
    return gathered.mapInArrow(of_host, "host string, wrapper struct<slot:string,template:array<string>,shown:array<string>>")


@lru_cache(maxsize=2_000)
def _sets(slot: str, template: tuple[str, ...], shown: tuple[str, ...]) -> tuple[str, frozenset[str], frozenset[str]]:
    return slot, frozenset(template), frozenset(shown)


def extract_pages(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", text_col: str = "main_text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """All rows of ``pages`` with the main text of each page in ``text_col``.

    A null page is empty and its text is empty; a null or odd address belongs to the host without a name; equal pages of a
    host have equal texts; an empty table gives no rows; a column named ``text_col`` is replaced, all others stay.

    Pages are shuffled once by host, and large hosts in groups, for the votes. They are read again where they lie while
    the wrappers of all hosts take at most ``broadcast_bytes``, which are then sent to all tasks; beyond that, pages are
    joined with the wrappers by host, and Spark splits large hosts.
    """
    columns = [c for c in pages.columns if c != text_col]
    name, wrapper_col = free(pages, "_host", "_wrapper")
    rows = pages.select(*columns).withColumn(name, host(pages[url_col]))
    wrappers = cut(induce(template_votes(rows.select(name, F.col(html_col)))))
    paths = F.concat("wrapper.template", "wrapper.shown")
    size = wrappers.agg(F.sum(64 + F.octet_length("host") + 2 * F.octet_length("wrapper.slot") + F.octet_length(F.array_join(paths, "....."))).alias("bytes")).first()["bytes"]
    wrappers = wrappers.select(F.col("host").alias(name), F.col("wrapper").alias(wrapper_col))
    joined = rows.join(F.broadcast(wrappers) if (size or 0) <= broadcast_bytes else wrappers, name, "left").select(*columns, wrapper_col)
    at = columns.index(html_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = batch.column(len(columns)), []
            for k, page in enumerate(batch.column(at).to_pylist()):
                w = found[k].as_py() or {"slot": "", "template": (), "shown": ()}
                texts.append(main_text(page or "", *_sets(w["slot"], tuple(w["template"]), tuple(w["shown"]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*columns, text_col])

    schema = StructType([*(f for f in rows.schema.fields if f.name in columns), StructField(text_col, StringType())])
    return joined.mapInArrow(extract, schema)
