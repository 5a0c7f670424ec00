"""Files of merged packages: references rewritten to new names, missing resources, markers as HTML, results moved to new paragraphs.

A reference is a token of its file.  Tokens are exploded, resolved and joined with the table of
new names, so that neither the files nor the names have to fit in one task.
"""

from __future__ import annotations

import base64
import binascii
import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.paths import fragment, relative, resolved
from quire.functions.text import u

#: Tokens with a reference, and the reference in a token.
CSS = tuple(map(u, ("(?i)url\\(\\s*['\"]?[^'\")]+['\"]?\\s*\\)|@import\\s+(?:'[^']+'|\"[^\"]+\")", "(?i)^(?:url\\(\\s*['\"]?|@import\\s+['\"])([^'\")]+)")))
LINKS = tuple(map(u, ("(?i)(?<![\\w:-])(?:href|src)\\s*=\\s*(?:'[^']*'|\"[^\"]*\")", "['\"]([^'\"]*)['\"]$")))
RESOURCE_TAGS = "(?is)<(?:img|image|link)\\b[^>]*>"
# Markers of inline formats.
MARKER = re.compile("⟦(?P<end>/?)(?P<name>[a-z]+)(?::(?P<value>[^⟧]*))?⟧")
INLINE_TAGS = frozenset("span font a sup sub code small mark ruby rt".split())
SINGLE = {"img": '<img src="{}" alt="插图"/>', "br": "<br/>", "fn": '<a href="#{}"><sup>注</sup></a>'}
#: Old paragraphs that may be passed over on the way to an equal one.
LOOK_AHEAD = 3


def references(files: DataFrame, group: str, kind: tuple[str, str] = CSS) -> DataFrame:
    """(group, name, k, token, target) of files (group, name, content): references that stay inside the package."""
    tokens = files.select(group, "name", F.posexplode(F.regexp_extract_all("content", F.lit(kind[0]), F.lit(0))).alias("k", "token"))
    return tokens.withColumn("target", resolved(F.col("name"), F.regexp_extract("token", kind[1], 1))).where("target IS NOT NULL")


def _css_token(token: Column, path: Column) -> Column:
    quote = F.regexp_extract(token, "(['\"])", 1)
    return F.when(token.startswith("@"), F.concat(F.regexp_extract(token, "^([^'\"]*)", 1), quote, path, quote)).otherwise(F.concat(F.lit("url('"), path, F.lit("')")))


def _link_token(token: Column, path: Column) -> Column:
    return F.concat(F.regexp_extract(token, "^([^'\"]*['\"])", 1), path, fragment(F.regexp_extract(token, LINKS[1], 1)), F.substring(token, -1, 1))


def rewritten(files: DataFrame, names: DataFrame, group: str, kind: tuple[str, str] = CSS) -> DataFrame:
    """Files (group, name, content) with their references led to new names, and `changed`.

    `names` has (group, name, new_name) for files and resources; a file without a row keeps its
    own name.  References outside the package or to names that are not listed stay as they are.
    Null contents stay null.
    """
    known = names.groupBy(group, "name").agg(F.min("new_name").alias("new_name"))
    placed = files.join(known, [group, "name"], "left").withColumn("new_name", F.coalesce("new_name", "name"))
    found = references(files, group, kind).join(placed.select(group, "name", F.col("new_name").alias("own")), [group, "name"])
    found = found.join(known.select(group, F.col("name").alias("target"), "new_name"), [group, "target"])
    write = _css_token if kind is CSS else _link_token
    token = write(F.col("token"), relative(F.col("own"), F.col("new_name")))
    changes = found.groupBy(group, "name").agg(F.map_from_entries(F.collect_set(F.struct("k", token.alias("v")))).alias("_by"))
    gaps, tokens = F.split("content", kind[0], -1), F.regexp_extract_all("content", F.lit(kind[0]), F.lit(0))
    new = F.transform(tokens, lambda t, k: F.coalesce(F.try_element_at("_by", k), t))
    whole = F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), new.alias("token")), lambda x: F.array(x["gap"], F.coalesce(x["token"], F.lit(""))))), "")
    out = placed.join(changes, [group, "name"], "left").withColumn("_new", F.when(F.col("_by").isNull(), F.col("content")).otherwise(whole))
    return out.select(group, "name", "new_name", F.col("_new").alias("content"), F.coalesce(F.size("_by"), F.lit(0)).alias("changed"))


def missing_resources(files: DataFrame, group: str) -> DataFrame:
    """(group, name, target): references of style sheets and pages (content as text) to entries that the package lacks."""
    lower = F.lower("name")
    sheets = references(files.where(lower.endswith(".css")), group)
    tags = files.where(lower.rlike("\\.x?html?$")).select(group, "name", F.explode(F.regexp_extract_all("content", F.lit(RESOURCE_TAGS), F.lit(0))).alias("token"))
    own = F.regexp_extract("token", u("(?is)\\ssrc\\s*=\\s*['\"]([^'\"]*)"), 1)
    href = F.regexp_extract("token", u("(?is)\\shref\\s*=\\s*['\"]([^'\"]*)"), 1)
    image, link = F.col("token").rlike("(?i)^<img\\b"), F.col("token").rlike("(?i)^<link\\b")
    tags = tags.where(~link | F.col("token").rlike(u("(?i)\\srel\\s*=\\s*['\"][^'\"]*\\bstylesheet\\b")))
    pages = tags.withColumn("target", resolved(F.col("name"), F.when(image, own).otherwise(href))).where("target IS NOT NULL")
    wanted = sheets.select(group, "name", "target").unionByName(pages.select(group, "name", "target")).distinct()
    return wanted.join(files.select(group, F.col("name").alias("target")), [group, "target"], "left_anti").select(group, "name", "target")


def _opening(name: str, value: str) -> tuple[str, str] | None:
    """Tag and written attributes of an opening marker; None for an unknown or broken one."""
    if name in ("b", "i", "u"):
        return name, ""
    if name == "s":
        return "span", f' style="{html.escape(value)}"' if value else ""
    if name != "x":
        return None
    try:
        said = json.loads(base64.urlsafe_b64decode(value + "=" * (-len(value) % 4)))
    except (ValueError, binascii.Error):
        return None
    attrs = (said.get("attrs") or {}) if isinstance(said, dict) else None
    if not isinstance(attrs, dict) or (tag := str(said.get("tag", "")).lower()) not in INLINE_TAGS:
        return None
    shown = {str(k): " ".join(map(str, v)) if isinstance(v, list) else str(v) for k, v in attrs.items() if not re.match("__|on", str(k), re.I)}
    return tag, "".join(f' {html.escape(k)}="{html.escape(v)}"' for k, v in shown.items())


def marked_up(text: str) -> str:
    """HTML of a text with markers: closers without an opener go, what is left open is closed at the end."""
    out, still_open, at, text = [], [], 0, html.escape(text, quote=False)
    for mark in MARKER.finditer(text):
        out.append(text[at : mark.start()])
        at, name, value = mark.end(), mark["name"], mark["value"] or ""
        if name in SINGLE:
            out.append(SINGLE[name].format(html.escape(value)))
        elif mark["end"]:
            if still_open and still_open[-1][0] == name:
                out.append(f"</{still_open.pop()[1]}>")
        elif start := _opening(name, value):
            still_open.append((name, start[0]))
            out.append(f"<{start[0]}{start[1]}>")
    return "".join([*out, text[at:], *(f"</{tag}>" for _, tag in reversed(still_open))])


def markers_to_html(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(marked_up, na_action="ignore")

    return run(c)


def _is_image(paragraph: str) -> bool:
    return paragraph.startswith("⟦img:") and paragraph.endswith("⟧")


def places(old: list[str], new: list[str]) -> list[int] | None:
    """For each new paragraph the position of its old one, -1 for images; None if the texts do not follow each other.

    Differences of white space do not count.  Between two matches at most LOOK_AHEAD old
    paragraphs are passed over, and only empty ones and images.
    """
    plain, at, out = [" ".join((p or "").split()) for p in old], 0, []
    for paragraph in (p or "" for p in new):
        if _is_image(paragraph):
            out.append(-1)
            continue
        wanted = " ".join(paragraph.split())
        found = next((k for k in range(at, min(len(old), at + LOOK_AHEAD + 1)) if plain[k] == wanted), None)
        if found is None or any(p and not _is_image(p) for p in old[at:found]):
            return None
        out.append(found)
        at = found + 1
    return out


def migrated(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """(keys, paragraphs, translated, safe): results of old chapters moved to the paragraphs of new ones.

    `old` has (keys, paragraphs, translated), where translated holds null for a paragraph without
    a result; `new` has (keys, paragraphs).  Images stand for themselves.  Where the paragraphs
    cannot be aligned safely, or the chapter is new, `safe` is false and translated is null.
    """

    @F.pandas_udf("array<int>")
    def place(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else places(list(a), list(b)) for a, b in zip(before, after, strict=True)], dtype=object)

    both = new.select(*keys, "paragraphs").join(old.select(*keys, F.col("paragraphs").alias("_old"), F.col("translated").alias("_done")), list(keys), "left")
    both = both.withColumn("_at", place("_old", "paragraphs"))
    moved = F.transform("_at", lambda at, k: F.when(at < 0, F.get("paragraphs", k)).otherwise(F.get("_done", at)))
    return both.select(*keys, "paragraphs", moved.alias("translated"), F.col("_at").isNotNull().alias("safe"))


def image_markers(paragraphs: Column, names: Column) -> Column:
    """Paragraphs with the paths of image markers led to new names, given as a map; others stay."""
    pattern = "⟦img:[^⟧]*⟧"

    def led(p: Column) -> Column:
        gaps, tokens = F.split(p, pattern, -1), F.regexp_extract_all(p, F.lit(f"({pattern})"), F.lit(1))
        path = lambda t: F.substring(t, F.lit(6), F.length(t) - 6)
        new = F.transform(tokens, lambda t: F.concat(F.lit("⟦img:"), F.coalesce(F.try_element_at(names, path(t)), path(t)), F.lit("⟧")))
        return F.array_join(F.zip_with(gaps, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.transform(paragraphs, led)


def images_in(paragraphs: Column, document: Column) -> Column:
    """Paragraphs whose image markers hold package paths, with paths relative to their document instead."""
    pattern = "⟦img:[^⟧]*⟧"

    def led(p: Column) -> Column:
        gaps, tokens = F.split(p, pattern, -1), F.regexp_extract_all(p, F.lit(f"({pattern})"), F.lit(1))
        new = F.transform(tokens, lambda t: F.concat(F.lit("⟦img:"), relative(document, F.substring(t, F.lit(6), F.length(t) - 6)), F.lit("⟧")))
        return F.array_join(F.zip_with(gaps, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.transform(paragraphs, led)


def used_sheets(files: DataFrame, group: str) -> DataFrame:
    """(group, name, css): style sheets that pages link, by package path, whether they are there or not."""
    lower = F.lower("name")
    tags = files.where(lower.rlike("\\.x?html?$")).select(group, "name", F.explode(F.regexp_extract_all("content", F.lit("(?is)<link\\b[^>]*>"), F.lit(0))).alias("token"))
    tags = tags.where(F.col("token").rlike(u("(?i)\\srel\\s*=\\s*['\"][^'\"]*\\bstylesheet\\b")))
    href = F.regexp_extract("token", u("(?is)\\shref\\s*=\\s*['\"]([^'\"]*)"), 1)
    return tags.select(group, "name", resolved(F.col("name"), href).alias("css")).where("css IS NOT NULL").distinct()
