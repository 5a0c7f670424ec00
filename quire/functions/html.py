"""Pages and XHTML: text nodes, content blocks with their class, and replacing text without touching markup.

Markup needs a parser, so this part runs in Arrow-batched Python: one row in (key, name, content),
rows out, nothing kept between rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.functions.text import DIALOGUE

# Tags and markers of the documents that are read.
BLOCKS = frozenset("p li blockquote pre td th dt dd figcaption h1 h2 h3 h4 h5 h6".split())
LOOSE_BLOCKS = frozenset(("div", "section", "article"))
#: Tags before which a paragraph that is left open ends.
ENDS_PARAGRAPH = BLOCKS | LOOSE_BLOCKS | frozenset("ul ol dl table hr aside main figure".split())
SILENT = frozenset(("script", "style", "noscript"))
RAW_SILENT = SILENT | {"head", "title"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
QUOTES = frozenset(("blockquote", "q", "pre", "code"))
INNER = re.compile("inner|monologue|thought|soliloquy|心理|内心|独白|心声", re.I)
LETTER = re.compile("letter|diary|journal|chat|message|mail|书信|日记|聊天|消息|邮件|引用|quote", re.I)
SKIPPED_NAMES = ("nav", "toc", "contents", "titlepage", "cover", "copyright")


@dataclass(eq=False)
class Element:
    """An element of a document with its children in order: elements and texts."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: "Element | None" = None
    children: list = field(default_factory=list)

    def elements(self) -> Iterator["Element"]:
        """All elements inside, in document order."""
        for child in self.children:
            if isinstance(child, Element):
                yield child
                yield from child.elements()

    def texts(self) -> Iterator["Text"]:
        for child in self.children:
            if isinstance(child, Element):
                yield from child.texts()
            else:
                yield child

    def text(self) -> str:
        return "".join(t.value for t in self.texts())

    def ancestors(self) -> Iterator["Element"]:
        """From the parent up, without the document itself."""
        node = self.parent
        while node is not None and node.parent is not None:
            yield node
            node = node.parent

    def first(self, *tags: str) -> "Element | None":
        return next((e for e in self.elements() if e.tag in tags), None)


@dataclass(eq=False)
class Text:
    """Text between two marks of a document: its value, and where it stands in the source."""

    value: str
    start: int
    end: int
    parent: Element


class _Builder(HTMLParser):
    """Builds the tree; every text remembers the part of the source that it was read from."""

    def __init__(self, content: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("")
        self.lines = [0, *accumulate(len(x) + 1 for x in content.split("\n"))]
        self.open_text: Text | None = None
        self.feed(content)
        self.close()
        self._mark(len(content))

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _mark(self, place: int | None = None) -> None:
        """A mark begins here, so a text before it ends."""
        if self.open_text is not None:
            self.open_text.end = self._place() if place is None else place
            self.open_text = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._mark()
        if tag in ENDS_PARAGRAPH and any(e.tag == "p" for e in (self.at, *self.at.ancestors())):
            self._leave("p")  # a new block ends a paragraph left open
        element = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(element)
        if tag not in VOID:
            self.at = element

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave(tag)

    def handle_endtag(self, tag: str) -> None:
        self._mark()
        self._leave(tag)

    def _leave(self, tag: str) -> None:
        closed = next((e for e in (self.at, *self.at.ancestors()) if e.tag == tag), None)
        if closed is not None and closed.parent is not None:
            self.at = closed.parent

    def handle_data(self, data: str) -> None:
        if self.open_text is not None:
            self.open_text.value += data
            return
        self.open_text = Text(data, self._place(), 0, self.at)
        self.at.children.append(self.open_text)

    def handle_comment(self, data: str) -> None:
        self._mark()

    handle_decl = handle_pi = unknown_decl = handle_comment


def tree(content: str | None) -> Element:
    return _Builder(content or "").root


def blocks(root: Element) -> list[Element]:
    """The blocks of a page in order: outermost paragraphs, list items, quotes, cells and headings; without any, outermost divisions; without these, the body."""
    kinds = next((k for k in (BLOCKS, LOOSE_BLOCKS) if any(e.tag in k and e.text().strip() for e in root.elements())), frozenset(("body",)))
    return [e for e in root.elements() if e.tag in kinds and not any(a.tag in kinds for a in e.ancestors()) and any(_visible(t) for t in e.texts())]


def _tags(t: Text) -> list[str]:
    return [e.tag for e in (t.parent, *t.parent.ancestors())] if t.parent.parent is not None else []


def _visible(t: Text) -> bool:
    return bool(t.value.strip()) and not SILENT.intersection(_tags(t))


def _marks(element: Element) -> str:
    """Classes, ids and roles of an element and all around it, and which of these are quotes."""
    chain = [element, *element.ancestors()] if element.parent is not None else []
    said = " ".join(v for e in reversed(chain) for k, v in e.attrs.items() if k in ("class", "id", "role", "epub:type"))
    return said + "".join(f" <{e.tag}>" for e in reversed(chain) if e.tag in QUOTES)


@dataclass(frozen=True)
class Node:
    """A visible text with the number and tag of its block (0, body: none), the block's class, and its place in the source."""

    block: int
    tag: str
    kind: str
    text: str
    start: int
    end: int
    replaceable: bool


@dataclass
class Page:
    root: Element
    nodes: list[Node]

    @property
    def nav(self) -> bool:
        return self.root.first("nav") is not None


def read(content: str | None) -> Page:
    """A page with its visible texts; a text outside of all blocks is classified by itself."""
    root = tree(content)
    found = {id(e): (n, e.tag, classify(e.tag, _marks(e), e.text())) for n, e in enumerate(blocks(root), 1)}
    nodes = []
    for t in filter(_visible, root.texts()):
        chain = (t.parent, *t.parent.ancestors()) if t.parent.parent is not None else ()
        number, tag, kind = next((found[id(e)] for e in chain if id(e) in found), None) or (0, "body", classify("body", _marks(t.parent), t.value))
        nodes.append(Node(number, tag, kind, t.value, t.start, t.end, not RAW_SILENT.intersection(_tags(t))))
    return Page(root, nodes)


def classify(tag: str, marks: str, text: str) -> str:
    """heading, code, letter, dialogue, monologue or narration."""
    if re.fullmatch("h[1-6]", tag):
        return "heading"
    if tag in ("pre", "code"):
        return "code"
    if LETTER.search(marks) or any(f"<{q}>" in marks for q in QUOTES):
        return "letter"
    core = text.strip()
    if re.search(DIALOGUE, core):
        return "dialogue"
    return "monologue" if INNER.search(marks) or re.fullmatch(r"（.*）|\(.*\)", core, re.S) else "narration"


def skipped(name: str, page: Page) -> bool:
    """Documents that hold no text of their own: with a nav element, or named as such."""
    parts = re.split(r"[/\\.]", name.lower())
    return page.nav or any(p in SKIPPED_NAMES for p in parts)


def text_nodes(pages: DataFrame, key: str, content: str) -> DataFrame:
    """(key, node, block, tag, class, text, in_body): visible text nodes in order; those of the head are not in the body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for k, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, n in enumerate(read(html).nodes):
                    for column, value in zip(rows, (k, i, n.block, n.tag, n.kind, n.text, n.replaceable), strict=True):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], [key, "node", "block", "tag", "class", "text", "in_body"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, content).mapInArrow(run, f"{key} {kind}, node int, block int, tag string, class string, text string, in_body boolean")


def replaced_at(document: str, changes: list[tuple[int, int, str]]) -> str:
    """The document with (start, end, text) in place of those parts, escaped; everything else stays byte for byte."""
    for start, end, text in sorted(changes, reverse=True):
        document = document[:start] + escape(text, quote=False) + document[end:]
    return document


def spliced(document: str, change: Callable[[str], str]) -> tuple[str, int]:
    """The document with change applied to its texts as they are read, and how many texts changed."""
    nodes = [n for n in read(document).nodes if n.replaceable]
    changes = [(n.start, n.end, new) for n in nodes if (new := change(n.text)) != n.text]
    return replaced_at(document, changes), len(changes)


def spliced_blocks(document: str, blocks: dict[int, tuple[list[str], list[str]]]) -> tuple[str, set[int], set[int]]:
    """The document with blocks (number: source texts, new texts) replaced whole, the blocks done, and those that differ from their source."""
    found: dict[int, list[Node]] = {}
    for n in read(document).nodes:
        if n.replaceable:
            found.setdefault(n.block, []).append(n)
    changes, done, differ = [], set(), set()
    for number, (source, new) in blocks.items():
        nodes = found.get(number, [])
        if [n.text for n in nodes] != source or len(new) != len(nodes):
            differ.add(number)
            continue
        changes += [(n.start, n.end, x) for n, x in zip(nodes, new, strict=True)]
        done.add(number)
    return replaced_at(document, changes), done, differ


def spliced_pages(pages: DataFrame, key: str, content: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(key, content, changed) with one-pass replacement in text nodes alone; longest source first."""
    table = {}
    for source, target in pairs:
        if source:
            table.setdefault(source, target)
    pattern = re.compile("|".join(map(re.escape, sorted(table, key=lambda s: (-len(s), s)))) or r"(?!)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [spliced(x or "", lambda t: pattern.sub(lambda m: table[m[0]], t)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], [key, "content", "changed"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, content).mapInArrow(run, f"{key} {kind}, content string, changed int")
