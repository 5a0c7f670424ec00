"""Replies of a completion service as paragraphs: JSON in any of its shapes, broken JSON, and plain lines.

Only reading JSON of unknown shape needs Python (one Arrow-batched step); recovering broken
replies, cleaning, aligning and judging are column expressions.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quire.functions.text import Cleaning, json_strings, let, reconciled, replaced, strip, u

#: Keys that hold the paragraphs of an object, the first one present decides (fixed values).
TEXT_KEYS = ("paragraphs", "translation", "text", "content")
#: Cleaning of a reply: quotes and remains of JSON, no numbers and no punctuation, which the user may want.
REPLY_CLEANING = Cleaning(strip_numbers=False, polish_punctuation=False)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def json_value(text: str | None) -> object:
    """The JSON value in a reply: the whole, a fenced part, the outermost braces or brackets; ValueError if none parses."""
    text = (text or "").strip()
    fence = _FENCE.search(text)
    spans = [(text.find(a), text.rfind(b)) for a, b in ("{}", "[]")]
    for part in (text, fence and fence[1].strip(), *(text[low : high + 1] for low, high in spans if 0 <= low < high)):
        if part:
            try:
                return json.loads(part)
            except ValueError:
                continue
    raise ValueError("no JSON in the reply")


def texts_of(value: object) -> list[str]:
    """Non-blank paragraphs of a JSON value: of its text key, or of all values of an object, or of a list."""
    if isinstance(value, dict):
        named = next((value[k] for k in TEXT_KEYS if value.get(k) is not None), None)
        return texts_of(named) if named is not None else [t for v in value.values() for t in texts_of(v)]
    if isinstance(value, list):
        said = [t for v in value if v is not None for t in (texts_of(v) if isinstance(v, dict) else [str(v)])]
    else:
        said = [str(value)]
    return [t for t in map(str.strip, said) if t]


@F.pandas_udf(ArrayType(StringType()))
def json_paragraphs(replies: pd.Series) -> pd.Series:
    """Paragraphs of the JSON in each reply; null where there is none."""

    def one(text: str | None) -> list[str] | None:
        try:
            return texts_of(json_value(text))
        except (ValueError, RecursionError):
            return None

    return pd.Series([one(x) for x in replies], dtype=object)


def _filled(a: Column) -> Column:
    return F.filter(a, lambda x: strip(x) != "")


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), "\n"), strip), lambda x: x != "")


def reply_lines(reply: Column) -> Column:
    """Paragraphs of a raw reply for reading and editing: of its JSON, else its lines; empty for a blank reply."""
    text = F.coalesce(reply, F.lit(""))
    return let(json_paragraphs(text), lambda p: F.when(F.coalesce(F.size(p), F.lit(0)) > 0, p).otherwise(_lines(text)))


def translated(reply: Column, expected: Column) -> Column:
    """Paragraphs of a reply brought to the expected number; lines only where it has no JSON."""
    return reconciled(F.coalesce(json_paragraphs(reply), _lines(F.coalesce(reply, F.lit("")))), expected)


def is_fragmented(values: Column) -> Column:
    """Whether stored values are the lines of a JSON text."""
    plain = F.transform(values, strip)
    tail = F.slice(plain, F.lit(2), F.greatest(F.size(plain), F.lit(1)))
    head = F.coalesce(F.get(plain, F.lit(0)), F.lit("")).startswith('{"paragraphs"')
    return F.when(head, F.exists(tail, lambda x: x != "")).otherwise(F.size(F.filter(tail, lambda x: x.endswith('",'))) >= 2)


def _from_fragments(values: Column, cleaning: Cleaning) -> Column:
    """Paragraphs of the lines of a JSON text: without its structure, the quotes and commas of its strings."""
    kept = F.filter(F.transform(values, strip), lambda x: (x != "") & ~x.startswith("{") & ~x.isin("]", "]}", "}"))

    def bare(x: Column) -> Column:
        inner = replaced(replaced(x, u('^\\s*"+')), u('"\\s*,?\\s*\\z'))
        return cleaning(replaced(inner, u("\\s*\\]\\z")))

    return F.filter(F.transform(kept, bare), lambda x: x != "")


def _from_broken_array(text: Column) -> Column:
    """Strings of a JSON array whose inner quotes break it, cut at the separators between its elements."""
    body = replaced(replaced(text, u('(?s)^.*?"\\s*:\\s*\\[\\s*')), u("(?s)\\s*format\\s*:\\s*\\{.*\\}\\s*\\z"))
    body = replaced(replaced(body, u("\\s*\\]\\s*\\}\\s*\\z")), "[\\]}]+\\z")
    parts = F.filter(F.transform(F.split(body, u('",\\s*"'), -1), strip), lambda x: x != "")

    def bare(x: Column) -> Column:
        inner = replaced(replaced(replaced(x, '^"'), '"\\z'), u("[\\s}]+\\z"))
        return replaced(inner, u("(?s)\\s*\\]\\s*(?:format\\s*:\\s*\\{.*\\})?\\s*\\z"))

    return F.transform(parts, bare)


def _from_blob(text: Column, cleaning: Cleaning) -> Column:
    """Paragraphs of a whole reply kept as one text: of its JSON, of a broken array, of its quoted strings; those of the first that gives two."""
    some = F.coalesce(json_paragraphs(text), F.array().cast("array<string>"))
    pick = let(some, lambda a: F.when(F.size(a) >= 2, a).otherwise(let(_from_broken_array(text), lambda b: F.when(F.size(b) >= 2, b).otherwise(json_strings(text)))))
    return F.filter(F.transform(pick, cleaning), lambda x: x != "")


def committed(values: Column, cleaning: Cleaning = REPLY_CLEANING) -> Column:
    """Paragraphs cleaned before they are stored; a single text that holds several is taken apart, the source is never put in."""
    whole = _from_blob(F.get(values, F.lit(0)), cleaning)
    return F.when((F.size(_filled(values)) == 1) & (F.size(whole) >= 2), whole).otherwise(F.transform(values, cleaning))


def _aligned(items: Column, expected: Column, source: Column, fill: bool) -> Column:
    """Items in the expected places, blank ones from the source on demand; all non-blank ones where no number is expected."""

    def at(i: Column) -> Column:
        own, other = strip(F.coalesce(F.get(items, i), F.lit(""))), strip(F.coalesce(F.get(source, i), F.lit("")))
        return F.when(own != "", own).otherwise(other if fill else F.lit(""))

    placed = F.when(expected > 0, F.transform(F.sequence(F.lit(0), F.greatest(expected, F.lit(1)) - 1), at)).otherwise(F.array().cast("array<string>"))
    return F.when(expected.isNull(), F.filter(items, lambda x: x != "")).otherwise(placed)


def normalised(values: Column, expected: Column, source: Column, fill: bool = False, cleaning: Cleaning = REPLY_CLEANING) -> Column:
    """(paragraphs, status) of the stored values of a chunk.

    status: ok, cleaned (marks of JSON or runs of quotes are left), recovered (read from JSON),
    fallback_source (the source stands in, on demand) or unresolved.  Null values are no list.
    """
    has_source = F.coalesce(F.size(source), F.lit(0)) > 0
    out = lambda paragraphs, status: F.struct(paragraphs.alias("paragraphs"), (status if isinstance(status, Column) else F.lit(status)).alias("status"))
    nothing = F.when(F.lit(fill) & has_source, out(source, "fallback_source")).otherwise(out(F.array().cast("array<string>"), "unresolved"))
    aligned = lambda items: _aligned(items, expected, source, fill)
    lost = "fallback_source" if fill else "unresolved"
    residue = lambda p: p.rlike("“{2,}|”{2,}") | p.startswith('"') | p.rlike(u('[”"]\\s*,\\s*\\z'))

    def plain(cleaned: Column) -> Column:
        left = F.exists(cleaned, lambda p: (p != "") & residue(p))
        return let(aligned(cleaned), lambda p: F.when(F.size(_filled(p)) > 0, out(p, F.when(left, "cleaned").otherwise("ok"))).when(F.lit(fill) & has_source, out(source, "fallback_source")).otherwise(out(p, "unresolved")))

    fragments = let(_from_fragments(values, cleaning), lambda f: F.when(F.size(f) > 0, out(aligned(f), "recovered")).otherwise(out(aligned(F.transform(values, strip)), lost)))
    each = let(F.transform(values, cleaning), plain)
    whole = let(_from_blob(F.get(values, F.lit(0)), cleaning), lambda w: F.when(F.size(w) >= 2, out(aligned(w), "recovered")).otherwise(each))
    return F.when(values.isNull(), nothing).when(is_fragmented(values), fragments).when(F.size(_filled(values)) == 1, whole).otherwise(each)
