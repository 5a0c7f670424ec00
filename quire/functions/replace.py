"""Replacement of terms by one automaton for all of them.

At every place the longest term that starts there is replaced, from left to right, and what is
put in is not looked at again.  A text is read once, however many terms there are; a list of
terms goes with the tasks, so its size is checked (`GLOSSARY_CHARS`).
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Characters of all terms and targets that may travel with a task.
GLOSSARY_CHARS = 50_000_000


class Replacer:
    """Pairs (source, target): of those with one source the first counts, empty sources replace nothing."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.table: dict[str, str] = {}
        for source, target in pairs:
            if source:
                self.table.setdefault(source, target)
        size = sum(len(s) + len(t) for s, t in self.table.items())
        if size > GLOSSARY_CHARS:
            raise ValueError(f"a glossary of {size} characters is more than the {GLOSSARY_CHARS} that go with a task")
        self._found: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return {"table": self.table, "_found": None}  # built anew in every task

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Places [low, high) of the terms to replace, in order."""
        if not self.table:
            return []
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for source in self.table:
                self._found.add_word(source, len(source))
            self._found.make_automaton()
        # ends come in order, and of one start the longer match ends later
        longest: dict[int, int] = {}
        for end, size in self._found.iter(text):
            longest[end + 1 - size] = end + 1
        out, free = [], 0
        for low in sorted(longest):
            if low >= free:
                free = longest[low]
                out.append((low, free))
        return out

    def __call__(self, text: str) -> str:
        return self.counted(text)[0]

    def counted(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with its terms replaced, and how often each source was."""
        spans = self.spans(text)
        if not spans:
            return text, {}
        parts, counts, at = [], {}, 0
        for low, high in spans:
            source = text[low:high]
            counts[source] = counts.get(source, 0) + 1
            parts += [text[at:low], self.table[source]]
            at = high
        return "".join([*parts, text[at:]]), counts


def one_pass(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """A text with its terms replaced; null for null."""
    replacer = Replacer(pairs)

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else replacer(t) for t in texts], dtype=object)

    return run(c) if replacer.table else c


def one_pass_each(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """An array of texts with their terms replaced."""
    replacer = Replacer(pairs)

    @F.pandas_udf(ArrayType(StringType()))
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else [None if t is None else replacer(t) for t in a] for a in lists], dtype=object)

    return run(c) if replacer.table else c


def replacements(texts: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(key, src, dst, replaced) of texts (key, text): how often each source is replaced in a row, nested and overlapped occurrences left out."""
    replacer = Replacer(pairs)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            of, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for item in replacer.counted(text or "")[1].items():
                    of.append(k)
                    found.append(item)
            src = [s for s, _ in found]
            columns = [pa.array(src, pa.string()), pa.array([replacer.table[s] for s in src], pa.string()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], [key, "src", "dst", "replaced"])

    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, src string, dst string, replaced long")
