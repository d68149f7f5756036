"""Main-text extraction with wrappers: union-free regular expressions inferred per host.

A page's token stream is read as nested groups. Two groups of one kind (tag and names) are aligned child by child: equal
kinds match in order, what only one side has becomes optional, neighbours of one kind fold into a repeated group, and
texts that differ become slots, texts that agree stay constants. Folding page after page of a host gives its wrapper,
the union-free expression of its template. The fold is partial per batch and host first, so that a hot host's pages
don't gather in one task, and pairs wrappers of about as many pages, so that it costs pages times their logarithm at most.
Every page is folded in, whatever its size: a host's wrapper grows with the different structures of its pages and is held by
one task; only its constants leave that task. For hosts whose partial wrappers are LARGE together, groups whose kinds from the
root on are those of no other page (a heading's own id) give way to empty groups, neighbours to one: nothing could align with
them and no text in them be a constant, so the constants stay the same.

Main text: within the page's articles, else its main element, else what its names call content, without what tags, roles
and names mark as menus, headers, footers, sidebars, notices, adverts, forms and comments. A name marks by its whole or
its head ('site-footer', 'share-buttons'; not 'comments-open', 'content-with-sidebar'), and never html, body, main or
article; where every article (or main element) of a page is within elements that only names mark, these hold the layout,
and the outermost of them aren't marked. On a page without such regions, everything but the marked parts. In either case
without the wrapper's constants: texts that CONSTANT or more pages of the host all have, in the same place and to their
ends, inline markup included, and in every repeat of a repeated group; copies of a page count as one.

Blocks are what block elements and line breaks separate; white space inside is one blank; they're joined by line feeds.

Defined results: null or empty html gives an empty text; unclosed elements end with their parent, stray end tags are
skipped, an unclosed comment or script lasts to the end; a url without a host (or null) counts as host ''; repeated rows are
extracted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import sys
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

CONSTANT = 3
#: Characters of constants that are sent to every executor at most; beyond, pages are sorted behind their host's, in parts of about PART pages.
BROADCAST, PART = 32 << 20, 10_000
#: Characters of a host's partial wrappers from which groups of one page are looked for.
LARGE = 8 << 20
#: Groups nest as deep as pages do; Python functions that call each other take no C stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 24))

#: Attributes up to '/>'; the slash of an unquoted value belongs to the value. Of the elements that are skipped, HTML lets only svg end so.
_CLOSED = r"(?:[^>\"'=/]|/(?!>)|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?|\"[^\"]*\"|'[^']*')*+/>"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|title|xmp|object|canvas)\b(?:(?<=<svg)" + _CLOSED + r"|(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUT = frozenset("nav footer aside form button select option menu dialog head input".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer notice notices alert cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments replies reply discussion disqus respond widget widgets toolbar skip copyright disclaimer".split()
)
CONTENT = frozenset("content maincontent main article articlebody post postcontent postbody entry entrycontent story storybody".split())
#: Words of a name that say which part of a thing an element is, not what it is: 'share-buttons' is share, 'comments-open' isn't comments.
PARTS = frozenset(
    "area bar bl block body bottom box btn button buttons card cards col column container content form foot grid group head header holder icon icons image inner item items label left link links list main "
    "next outer panel post posts article articles previous primary prev right row secondary section slot space stories story text title toggle top unit wrap wrapper zone".split()
)
COMMENTS = frozenset("comment comments reply replies respond".split())
_WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


def named(name: str) -> str:
    """What a class or id names as no main text: the whole name, its head (the last word), or the first word before mere PARTS; else ''."""
    words = [w.lower() for w in _WORD.findall(name) if not w.isdigit()]
    for k, w in enumerate(words):
        if w in ("has", "with", "without", "no", "is", "js"):  # what follows is what the element has or hasn't
            words = words[:k]
            break
    if not words:
        return ""
    if "".join(words) in OUT_WORDS:
        return "".join(words)
    if words[0] in OUT_WORDS and all(w in PARTS or w in OUT_WORDS for w in words[1:]):
        return words[0]
    return words[-1] if words[-1] in OUT_WORDS or words[-1] == "header" else ""


def marks(tag: str, attributes: str) -> tuple[str, bool, bool, int, frozenset]:
    """(kind, marked as no main text, marked so outside of articles only, content: 3 article, 2 main, 1 by name, 0; what names say)."""
    names, out, level, said = "", tag in OUT, 3 if tag == "article" else 2 if tag == "main" else 0, set()
    soft = tag == "header"
    if attributes and attributes.strip(" /"):
        for m in _NAMES.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                out = True
            elif key == "style":
                out |= "display:none" in value.replace(" ", "").lower()
            elif key == "role":
                out |= value.lower() in OUT_ROLES
                level = max(level, {"article": 3, "main": 2}.get(value.lower(), 0))
            elif key in ("class", "id"):
                names += f".{value}"
                for name in value.split():
                    said.add(named(name))
                    if "".join(_WORD.findall(name)).lower() in CONTENT:
                        level = max(level, 1)
    return tag + re.sub(r"\d+", "#", names), out, soft, level, frozenset(said - {""})


def constant(text: str) -> str:
    """What stands for a text in wrappers: itself with single blanks, if long a part of it and 128 bits of hash of the whole."""
    text = " ".join(text.split())
    return text if len(text) <= 200 else f"{text[:160]} {hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


class Node:
    """A group of a wrapper: kind, children, and whether it may be missing, may repeat or was aligned; of a text ('#'), the constant or
    None, and hashes of up to CONSTANT distinct pages that have it. Kind '' inside is what stands for groups of one page."""

    __slots__ = ("kind", "children", "optional", "repeated", "aligned", "text", "pages")

    def __init__(self, kind: str, text: str | None = None):
        self.kind, self.children, self.optional, self.repeated, self.aligned, self.text, self.pages = kind, [], False, False, False, text, []

    def pack(self) -> list:
        """Flat, since JSON bounds nesting: first the lists of pages, then five entries a group, before its children's: the fourth
        is its pages' place in the first list, the fifth the number of its children."""
        places: dict[tuple, int] = {}
        out, left = [[]], [self]
        while left:
            node = left.pop()
            out += (node.kind, node.optional + 2 * node.repeated + 4 * node.aligned, node.text, places.setdefault(tuple(node.pages), len(places)), len(node.children))
            left += reversed(node.children)
        out[0] = [list(pages) for pages in places]
        return out

    @classmethod
    def unpack(cls, x: list) -> Node:
        root, unfilled = None, []  # groups with the number of children still to come
        for kind, how, text, pages, n in zip(*(x[k::5] for k in range(1, 6))):
            node = cls(sys.intern(kind), text)
            node.optional, node.repeated, node.aligned, node.pages = bool(how & 1), bool(how & 2), bool(how & 4), x[0][pages]
            if root is None:
                root = node
            else:
                while not unfilled[-1][1]:
                    unfilled.pop()
                unfilled[-1][0].children.append(node)
                unfilled[-1][1] -= 1
            if n:
                unfilled.append([node, n])
        return root

    def expression(self) -> str:
        inside = ("#TEXT" if self.text is None else re.escape(self.text)) if self.kind == "#" else f"<{self.kind}>" + "".join(c.expression() for c in self.children) + "</>"
        return f"({inside})" + ("*" if self.repeated and self.optional else "+" if self.repeated else "?") if self.repeated or self.optional else inside


def fold(children: list[Node]) -> list[Node]:
    """Neighbours of one kind become one repeated group."""
    out: list[Node] = []
    for c in children:
        if out and out[-1].kind == c.kind and c.kind != "#":
            out[-1] = align(out[-1], c)
            out[-1].repeated = True
        else:
            out.append(c)
    return out


def common(x: list, y: list) -> Iterator[tuple[int, int]]:
    """Steps (i, j) through both lists along a longest common subsequence: x[i] beside its equal y[j], (i, -1) what only x has, (-1, j) what only y has.

    Bit n - 1 - i of the row of j is 0 where x[i:] has one more in common with y[j:] than x[i + 1:] has. Rows come from additions of long
    integers; those at the ends of blocks are kept, those within made again when the walk gets there."""
    n, m, i, j = len(x), len(y), 0, 0
    while i < n and i < m and x[i] == y[i]:
        yield i, i
        i += 1
    j = i
    bits: dict[str | int, list[int]] = {k: [] for k in y[j:]}
    for at in range(i, n):
        if x[at] in bits:
            bits[x[at]].append(n - 1 - at)
    size, often = (n + 7) // 8, {}

    def mask(kind: str | int) -> int:
        places = bits[kind]
        if len(places) <= 16:
            return sum(1 << p for p in places)
        if kind not in often:
            row = bytearray(size)
            for p in places:
                row[p >> 3] |= 1 << (p & 7)
            often[kind] = int.from_bytes(row, "little")
        return often[kind]

    def above(row: int, at: int) -> int:
        if not bits[y[at]]:
            return row
        same = row & mask(y[at])
        return (row + same | row - same) & full

    full, block = (1 << n) - 1, isqrt(m - j) + 1
    row, kept = full, {}
    for at in range(m - 1, j - 1, -1):
        if (m - 1 - at) % block == 0:
            kept[at] = row  # the row of at + 1
        row = above(row, at)
    rows: dict[int, bytes] = {}
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            yield i, j
            i, j = i + 1, j + 1
            continue
        if i < n and j < m and j not in rows:
            last = m - 1 - (m - 1 - j) // block * block
            rows, row = {}, kept[last]
            for at in range(last, j - 1, -1):
                if bits[y[at]] or not rows:
                    row = above(row, at)
                    coded = row.to_bytes(size, "little")
                rows[at] = coded
        if j == m or (i < n and rows[j][n - 1 - i >> 3] >> (n - 1 - i & 7) & 1):
            yield i, -1
            i += 1
        else:
            yield -1, j
            j += 1


def align(a: Node, b: Node) -> Node:
    """The least general group, of these forms, that covers both."""
    out = Node(a.kind, a.text if a.text == b.text else None)
    out.optional, out.repeated, out.aligned = a.optional or b.optional, a.repeated or b.repeated, True
    if out.text is not None:
        out.pages = a.pages if a.pages == b.pages else sorted({*a.pages, *b.pages})[:CONSTANT]
    x, y = a.children, b.children
    kinds, others = [c.kind or i for i, c in enumerate(x)], [c.kind or ~j for j, c in enumerate(y)]  # '' is like no other
    if kinds == others:
        out.children = [align(c, d) for c, d in zip(x, y)]
        return out
    children = []
    for i, j in common(kinds, others):
        if i < 0 or j < 0:
            c = x[i] if j < 0 else y[j]
            c.optional = True
            children.append(c)
        else:
            children.append(align(x[i], y[j]))
    out.children = fold(children)
    return out


def below(path: bytes, kind: str) -> bytes:
    """128 bits that stand for the kinds of a group and of those around it."""
    return hashlib.blake2b(path + kind.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Page:
    """pieces: (block, text, marked, level, path, wrapper's text): every text of the page in order. root: its groups."""

    def __init__(self, source: str):
        self.pieces: list[tuple[int, str, bool, int, bytes, Node | None]] = []
        self.root = Node("")
        # tag, node, path, marked, level, elements above that only their names mark
        self.stack: list[tuple] = [("", self.root, b"", False, 0, ())]
        self.named, self.doubted, self.held = 0, [], []
        self.block, at = 0, 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if m[3]:
                self.tag(m[3].lower(), bool(m[2]), m[4])
            elif m[1] and m[1].lower() not in INLINE:
                self.block += 1
        if at < len(source):
            self.text(source[at:])
        while len(self.stack) > 1:
            self.close()
        self.end(self.root)
        kept = self.kept()
        for i, above in self.doubted:
            if not kept.issuperset(above):
                self.pieces[i] = (*self.pieces[i][:2], True, *self.pieces[i][3:])
        # pages that say the same outside of marked parts are copies, and count as one
        self.sign(self.root, [int.from_bytes(hashlib.blake2b(" ".join(" ".join(x[1] for x in self.pieces if not x[2]).split()).encode("utf-8", "surrogatepass"), digest_size=7).digest())])

    def sign(self, node: Node, pages: list[int]) -> None:
        left = [node]
        while left:
            for c in left.pop().children:
                if c.kind != "#":
                    left.append(c)
                elif c.text is not None:
                    c.pages = pages

    def kept(self) -> set[int]:
        """Elements whose names don't count: while every article (or main element, without articles) is within marked ones, the outermost of these."""
        top, kept = max((level for level, _ in self.held), default=0), set()
        held = [above for level, above in self.held if level == top]
        while held and not any(kept.issuperset(above) for above in held):
            kept |= {next(i for i in above if i not in kept) for above in held}
        return kept

    def text(self, raw: str) -> None:
        if raw.isspace():
            self.pieces.append((self.block, " ", False, 0, b"", None))
            if (children := self.stack[-1][1].children) and children[-1].kind == "#":
                children[-1].text += " "
            return
        text = html.unescape(raw) if "&" in raw else raw
        _, node, path, marked, level, above = self.stack[-1]
        last = node.children[-1] if node.children else None
        if last is None or last.kind != "#":
            node.children.append(last := Node("#", text))
        else:  # inline groups and line breaks don't cut a text of the wrapper
            last.text += text
        if above and not marked:
            self.doubted.append((len(self.pieces), above))
        self.pieces.append((self.block, text, marked, level, path, last))

    def tag(self, tag: str, end: bool, attributes: str) -> None:
        if tag not in INLINE:
            self.block += 1
        if tag in VOID:
            return
        if end:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] == tag:
                    while len(self.stack) > k:
                        self.close()
                    return
                if tag in INLINE and self.stack[k][0] not in INLINE:
                    return  # an inline end tag doesn't reach over blocks
            return
        if tag == "p" or tag == "li" or tag in ("tr", "td", "th", "dt", "dd", "option"):
            for k in range(len(self.stack) - 1, 0, -1):  # these end their open namesake, and what is left open in it
                if self.stack[k][0] == tag:
                    while len(self.stack) > k:
                        self.close()
                    break
                if self.stack[k][0] not in INLINE and self.stack[k][0] != "p":
                    break
        kind, out, soft, level, said = marks(tag, attributes)
        _, parent, path, marked, above, doubted = self.stack[-1]
        inside = above >= 2 or level >= 2
        marked = marked or out or (soft and not inside)
        if level >= 2 and not marked and said.isdisjoint(COMMENTS):  # a comment may be an article as well
            self.held.append((level, doubted))
        said -= {"header"} if inside or tag in INLINE else set()
        if tag in ("html", "body") or level >= 2:
            said = frozenset()
        if tag in INLINE and not out and not said:  # inline groups aren't part of the structure
            self.stack.append((tag, parent, path, marked, above, doubted))
            return
        if said:
            self.named += 1
            doubted += (self.named,)
        node = Node(kind)
        self.stack.append((tag, node, below(path, kind), marked, max(level, above), doubted))

    def close(self) -> None:
        _, node, *_ = self.stack.pop()
        parent = self.stack[-1][1]
        if node is parent:
            return
        self.end(node)
        if parent.children and parent.children[-1].kind == node.kind:
            parent.children[-1] = fold([parent.children[-1], node])[0]
        else:
            parent.children.append(node)

    def end(self, node: Node) -> None:
        for c in node.children:
            if c.kind == "#":
                c.text = constant(c.text)

    def main(self, constants: frozenset = frozenset()) -> str:
        level = max((x[3] for x in self.pieces if x[3] and not x[2]), default=0)
        if not level:  # an article may be there and hold nothing but marked parts
            level = max((x[3] for x in self.pieces), default=0)
        blocks: dict[int, list[str]] = {}
        for block, text, marked, l, path, whole in self.pieces:
            if text == " " and not path:
                if block in blocks:
                    blocks[block].append(" ")
            elif not marked and l >= level and (not constants or (path, whole.text) not in constants):
                blocks.setdefault(block, []).append(text)
        return "\n".join(t for t in (" ".join("".join(parts).split()) for parts in blocks.values()) if t)


def constants(wrapper: Node) -> frozenset:
    """(path, text) of the wrapper's constants."""
    found, left = set(), [(wrapper, b"")]
    while left:
        node, path = left.pop()
        for c in node.children:
            if c.kind != "#":
                left.append((c, below(path, c.kind)))
            elif c.text and not c.optional and len(c.pages) >= CONSTANT:
                found.add((path, c.text))
    return frozenset(found)


def _merge(wrappers: dict, key, new: Node) -> None:
    wrappers[key] = align(wrappers[key], new) if key in wrappers else new


def _add(folds: dict[tuple[str, int], Node], host: str, new: Node) -> None:
    """Fold as a binary counter does: folds[host, k] is the wrapper of 2 ** k of what was added."""
    k = 0
    while (old := folds.pop((host, k), None)) is not None:
        new, k = align(old, new), k + 1
    folds[host, k] = new


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages → one wrapper per host and batch."""
    for batch in batches:
        folds: dict[tuple[str, int], Node] = {}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            _add(folds, host, Page(source).root)
        yield _rows(folds)


def _rows(folds: dict[tuple[str, int], Node], row: Callable = Node.pack) -> pa.RecordBatch:
    wrappers: dict[str, Node] = {}
    for host, k in sorted(folds):
        _merge(wrappers, host, folds.pop((host, k)))
    return pa.RecordBatch.from_arrays([pa.array(list(wrappers), pa.string()), pa.array([json.dumps(row(w)) for w in wrappers.values()], pa.string())], names=["host", "wrapper"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers → (host, path, n) of their groups, n being 1 for a path of one page, else 2 or more; '' for the root, n 2."""
    for batch in batches:
        for host, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found, left = {b"": 2}, [(Node.unpack(json.loads(packed)), b"")]
            while left:
                node, path = left.pop()
                for c in node.children:
                    if c.kind != "#":
                        left.append((c, at := below(path, c.kind)))
                        found[at] = found.get(at, 0) + 1 + c.aligned
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["host", "path", "n"])


def prune(wrapper: Node, kept: set[bytes]) -> Node:
    """wrapper, with an empty group in place of neighbouring groups whose paths aren't kept."""
    left = [(wrapper, b"")]
    while left:
        node, path = left.pop()
        children: list[Node] = []
        for c in node.children:
            if c.kind == "#":
                children.append(c)
            elif (at := below(path, c.kind)) in kept:
                children.append(c)
                left.append((c, at))
            elif not children or children[-1].kind:
                children.append(Node(""))
        node.children = children
    return wrapper


def _joined(batches: Iterator[pa.RecordBatch], row: Callable = Node.pack) -> Iterator[pa.RecordBatch]:
    """Partial wrappers sorted by host, behind the paths that a large host keeps → one per host, as row gives it; they stream by, none is gathered."""
    folds: dict[tuple[str, int], Node] = {}
    last, kept = None, set()
    for batch in batches:
        for host, path, packed in zip(*(batch.column(name).to_pylist() for name in ("host", "path", "wrapper"))):
            if host != last:
                if folds:
                    yield _rows(folds, row)
                last, kept = host, set()
            if path is not None:
                kept.add(path)
                continue
            new = Node.unpack(json.loads(packed))
            _add(folds, host, prune(new, kept) if kept else new)
    if folds:
        yield _rows(folds, row)


def _listed(wrapper: Node) -> list:
    return sorted([path.hex(), text] for path, text in constants(wrapper))


def _known(packed: str | None) -> frozenset:
    return frozenset((bytes.fromhex(path), text) for path, text in json.loads(packed)) if packed else frozenset()


def host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", row: Callable = Node.pack) -> DataFrame:
    """(host, wrapper): the host's inferred expression, as packed groups (see Node), or what row makes of it."""
    partial = materialize(pages.select(host(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInArrow(_partial, "host string, wrapper string"))
    large = partial.groupBy("host").agg(F.sum(F.length("wrapper")).alias("size")).where(F.col("size") > LARGE).select("host")
    rows = partial.withColumn("path", F.lit(None).cast("binary"))
    if not large.isEmpty():
        paths = partial.join(F.broadcast(large), "host", "left_semi").select("host", "wrapper").mapInArrow(_paths, "host string, path binary, n long")
        rows = rows.unionByName(paths.groupBy("host", "path").agg(F.sum("n").alias("n")).where("n > 1").drop("n"), allowMissingColumns=True)
    rows = rows.repartition("host").sortWithinPartitions("host", F.col("path").asc_nulls_last(), "wrapper")
    return rows.mapInArrow(lambda batches: _joined(batches, row), "host string, wrapper string")


def _sorted_in(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows, each host's behind its constants, which come once for every PART pages rather than with every page."""
    many = rows.groupBy("host").count().where(F.col("count") > PART).select("host", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    pages = rows.join(F.broadcast(many), "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), parts).cast("int")).drop("parts")
    copies = found.join(F.broadcast(many), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    both = pages.withColumn("wrapper", F.lit(None).cast("string")).unionByName(copies, allowMissingColumns=True)
    return both.repartition("host", "part").sortWithinPartitions("host", "part", F.col("wrapper").desc_nulls_last()).select("page_id", "url", "html", "host", "wrapper")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host(url_col).alias("host"))
    found = materialize(infer(pages, url_col, html_col, _listed)).where("wrapper <> '[]'")
    size = found.agg(F.coalesce(F.sum(F.length("host") + F.length("wrapper")), F.lit(0))).first()[0]
    # few enough constants go to the pages; else the pages go to them
    told = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in found.collect()}) if size <= BROADCAST else None
    both = _sorted_in(rows, found) if told is None else rows.withColumn("wrapper", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, known, sets = None, frozenset(), {}
        for batch in batches:
            ids, urls, texts = [], [], []
            for page_id, url, source, host, packed in zip(*(batch.column(name).to_pylist() for name in ("page_id", "url", "html", "host", "wrapper"))):
                if told is not None:
                    known = sets[host] if host in sets else sets.setdefault(host, _known(told.value.get(host)))
                elif packed is not None or host != of:
                    of, known = host, _known(packed)
                if packed is None:
                    ids.append(page_id)
                    urls.append(url)
                    texts.append(Page(source).main(known))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("page_id").type), pa.array(urls, pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return both.mapInArrow(run, "page_id long, url string, text string")


def op7_html(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read

    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
