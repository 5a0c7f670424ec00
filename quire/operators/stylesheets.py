"""Style sheets against the pages that link them: which selectors match nothing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.html import Element, tree
from quire.operators.package import used_sheets

#: Rules that hold other rules (fixed values).
_NESTING = re.compile(r"@(?:media|supports|layer|container)\b[^{}]*\{", re.I)
_PART = re.compile(r"""\*|[A-Za-z][\w-]*|[.#][\w-]+|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*["']?([^"'\]]*)["']?\s*)?\]""")


def selectors(css: str) -> list[str]:
    """The selectors of a sheet without comments, in order; those inside media rules too, the heads of other at-rules not."""
    text = _NESTING.sub("", re.sub(r"/\*.*?\*/", "", css, flags=re.S))
    heads = (m[1].strip() for m in re.finditer(r"([^{}]+)\{", text))
    return [s for h in heads if not h.startswith("@") for s in map(str.strip, h.split(",")) if s]


def _compound(text: str) -> list[tuple] | None:
    """The tests of a selector without combinators; None if it is not understood."""
    tests, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if m is None or (tests and m[0][0] not in ".#["):
            return None
        tests.append((m[0][0], m[1], m[2], m[3]) if m[0][0] == "[" else (m[0][0], m[0][1:]) if m[0][0] in ".#" else ("t", m[0]))
        at = m.end()
    return tests or None


def compiled(selector: str) -> list[tuple[str, list[tuple]]] | None:
    """(combinator before, tests) of each compound, or None if it is not understood."""
    pieces = re.findall(r"\s*([>+~])\s*|(\s+)|((?:\[[^\]]*\]|[^\s>+~\[])+)", selector.strip())
    out, before = [], " "
    for sign, _, part in pieces:
        if sign:
            before = sign
        elif part:
            tests = _compound(part)
            if tests is None:
                return None
            out.append((before, tests))
            before = " "
    return out or None


def _meets(e: Element, test: tuple) -> bool:
    kind, value = test[0], test[1]
    if kind == "t":
        return value == "*" or e.tag == value.lower()
    if kind == ".":
        return value in e.attrs.get("class", "").split()
    if kind == "#":
        return e.attrs.get("id") == value
    have = e.attrs.get(value.lower())
    if have is None or test[2] is None:
        return have is not None
    return {"=": have == test[3], "~=": test[3] in have.split(), "^=": have.startswith(test[3]), "$=": have.endswith(test[3]), "*=": test[3] in have, "|=": have == test[3] or have.startswith(test[3] + "-")}[test[2]]


def _matches(e: Element, parts: list[tuple[str, list[tuple]]]) -> bool:
    before, tests = parts[-1]
    if not all(_meets(e, t) for t in tests):
        return False
    if len(parts) == 1:
        return True
    if before in " >":
        around = list(e.ancestors())
    else:
        beside = [c for c in e.parent.children if isinstance(c, Element)] if e.parent is not None else []
        around = beside[: next((k for k, c in enumerate(beside) if c is e), 0)][::-1]
    return any(_matches(a, parts[:-1]) for a in (around[:1] if before in ">+" else around))


def found(pages: list[Element], selector: str) -> bool | None:
    """Whether a selector matches anything in the pages; None if it is not understood."""
    parts = compiled(selector)
    return None if parts is None else any(_matches(e, parts) for p in pages for e in p.elements())


def unused(files: DataFrame, group: str) -> DataFrame:
    """(group, css, selector, problem) of files (group, name, content): selectors that match nothing in the pages that link their sheet (unused), or that cannot be judged (unknown).

    Selectors with pseudo-classes are not judged; sheets that no page links are left out.  A sheet
    with its pages is one row of one task, and pages are parsed there.
    """
    links = used_sheets(files, group)
    pages = links.join(files.select(group, "name", "content"), [group, "name"]).groupBy(group, "css").agg(F.collect_list("content").alias("pages"))
    sheets = pages.join(files.select(group, F.col("name").alias("css"), F.col("content").alias("sheet")), [group, "css"]).select(group, "css", "sheet", "pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, css, sheet, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trees = [tree(t) for t in texts]
                for s in dict.fromkeys(selectors(sheet or "")):
                    hit = found(trees, s) if ":" not in s else True
                    if not hit:
                        rows.append((g, css, s, "unknown" if hit is None else "unused"))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (batch.schema.field(0).type, pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [group, "css", "selector", "problem"])

    return sheets.mapInArrow(run, f"{group} {files.schema[group].dataType.simpleString()}, css string, selector string, problem string")
