"""Column builders for titles, paragraphs, markers and names.

Everything here stays in the JVM.  Patterns are Java regular expressions; `strip` removes the
same characters as Python's str.strip, which Spark's trim does not.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip and \\s take for blank; Java's \\s knows ASCII alone.
_BLANK = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Decimal digits of all scripts.
_DIGITS = "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) == "Nd")


def u(pattern: str) -> str:
    """A Java pattern in which white space, digits and word characters are those of all scripts, as in Python."""
    return "(?U)" + pattern.replace("\\s", f"[{_BLANK}]").replace("\\d", "\\p{Nd}")


# Formats of the documents that are read and written.
SENTENCE_END = ".!?…。！？"
HANGUL = "\\u1100-\\u11ff\\u3130-\\u318f\\ua960-\\ua97f\\uac00-\\ud7af\\ud7b0-\\ud7ff"
SKIP_LINES = ("목차", "판권", "copyright")
WORD_COUNT = "本章字数\\s*[:：]\\s*\\d+"
PRODUCTION_TITLE = "制作说明"
PRODUCTION_MARKS = ("【制作说明】", "【书籍统计】", "制作工具", "Txt2Epub", "预计阅读时长")
NO_TITLE_LINES = ("收起封面", "关闭封面", "封面", "目录", "作者的话", "公告", "致谢", "后记", "番外")
NO_TITLE_PARTS = ("收起封面", "关闭封面")
LEAD_NUMBERS = (
    "^\\s*(?:[Cc]hapter|CH\\.?|Ch\\.?)\\s*(\\d+)\\s*[-–—:：.、]?\\s*",
    "^\\s*제\\s*(\\d+)\\s*[장话話화회回章節节]?\\s*[-–—:：.、]?\\s*",
    "^\\s*第\\s*(\\d+)\\s*[章回话節节話회]?\\s*[-–—:：.、]?\\s*",
    "^\\s*[（(]\\s*(\\d+)\\s*[）)]\\s*[-–—:：.、]?\\s*",
    "^\\s*(\\d+)\\s*[-–—:：.、]\\s*",
)
TRAIL_NUMBERS = ("\\s*[（(]\\s*(\\d+)\\s*[）)]\\s*$", "\\s*[-–—]?\\s*(\\d+)\\s*$")
DIALOGUE = "“[^”]*”|‘[^’]*’|「[^」]*」|『[^』]*』|\"[^\"]+\"|'[^']+'"
# Cleaning of paragraphs: remains of a JSON key, numbers before a paragraph, remains of quotes, punctuation.
JSON_KEY = '^\\s*\\{?"(?:paragraphs|translation|text|content|p\\d*)"\\s*:\\s*\\[?\\s*'
LIST_NUMBERS = ("^\\s*\\[\\d+\\]\\s*", "^\\s*\\(\\d+\\)\\s*", "^\\s*\\d+\\.\\s+")
QUOTE_EDGES = (('^"+\\s*(?=[“”‘’\\u4e00-\\u9fff])', ""), ('[”"]\\s*,\\s*$', ""), ('”["”]*$', "”"))
PUNCTUATION = (("\\.{3,}", "……"), ("[!！]{2,}", "！"), ("[?？]{2,}", "？"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, even where it appears inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def replaced(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def lstrip(c: Column) -> Column:
    return replaced(c, f"^[{_BLANK}]+")


def rstrip(c: Column) -> Column:
    return replaced(c, f"[{_BLANK}]+\\z")


def strip(c: Column) -> Column:
    return rstrip(lstrip(c))


def strip_invisible(c: Column) -> Column:
    """Without format characters (category Cf)."""
    return replaced(c, "\\p{Cf}")


def normalized_title(c: Column) -> Column:
    return strip(replaced(strip_invisible(c), f"[{_BLANK}]+", " "))


def without_markers(c: Column, image: str = "【插图】") -> Column:
    """Inline markers ⟦...⟧ removed, image markers shown as a placeholder."""
    return replaced(replaced(c, "⟦img(?::[^⟧]*)?⟧", image), "⟦/?[a-z]+(?::[^⟧]*)?⟧")


def is_skip_line(c: Column) -> Column:
    return F.lower(replaced(strip(c), u("[\\s.:：。·\\-–—]+\\z"))).isin(*SKIP_LINES)


def is_decorative(c: Column) -> Column:
    return c.rlike("[\\p{Mn}\\p{Me}]")


def is_weak_title(c: Column) -> Column:
    return F.length(c) <= 2


def is_cover_name(c: Column) -> Column:
    return F.lower(replaced(F.regexp_extract(c, "([^/]*)$", 1), "[^A-Za-z0-9]")).startswith("cover")


def has_han(c: Column) -> Column:
    return c.rlike("[\\u3400-\\u4dbf\\u4e00-\\u9fff]")


def is_html_name(c: Column) -> Column:
    return F.lower(c).rlike("\\.(x?html|htm)$")


def hangul_count(c: Column) -> Column:
    return F.length(replaced(c, f"[^{HANGUL}]"))


def is_word_count_line(c: Column) -> Column:
    return c.rlike(u(WORD_COUNT))


def has_dialogue(c: Column) -> Column:
    return c.rlike(DIALOGUE)


def looks_like_body_title(c: Column) -> Column:
    """A short line that is neither a note, a menu entry, a sentence nor a bare number."""

    def like(t: Column) -> Column:
        core = replaced(t, "[”’\"「」』】》>)\\]）]+\\z")
        part = F.lit(False)
        for p in NO_TITLE_PARTS:
            part = part | t.contains(p)
        return (
            (F.length(t) > 0) & (F.length(t) <= 60) & ~is_word_count_line(t) & ~t.isin(*NO_TITLE_LINES) & ~part
            & ~core.rlike("[。！？…!?，、；：:]\\z") & ~t.rlike(u("^[\\d\\s（）()、，,.\\-—]+\\z"))
        )

    return let(strip(F.coalesce(c, F.lit(""))), like)


def body_title(paragraphs: Column, pattern: str | None = None, scan: int = 5) -> Column:
    """(title, at) from the first lines that are no word counts: a match of the pattern anywhere among them beats a title-like line."""
    numbered = F.transform(paragraphs, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    head = F.slice(F.filter(numbered, lambda x: ~is_word_count_line(x["p"])), 1, scan)
    found = lambda x: F.struct(strip(F.regexp_extract(x["p"], u(pattern), 0)).alias("title"), x["i"].alias("at")) if pattern else None
    like = F.transform(F.filter(head, lambda x: looks_like_body_title(x["p"])), lambda x: F.struct(strip(x["p"]).alias("title"), x["i"].alias("at")))
    first = F.get(like, F.lit(0))
    return first if pattern is None else F.coalesce(F.get(F.transform(F.filter(head, lambda x: x["p"].rlike(u(pattern))), found), F.lit(0)), first)


def numbered_title(c: Column) -> Column:
    """(lead, lead_raw, core, trail_raw, trail): numbers before and after a title; the whole title is the core where nothing else is left."""

    def cut(text: Column, patterns: tuple[str, ...], use: Callable[[Column, Column, Column], Column]) -> Column:
        # the first pattern that matches decides
        raw, num = F.lit(""), F.lit("")
        for p in reversed(patterns):
            raw = F.when(text.rlike(u(p)), F.regexp_extract(text, u(p), 0)).otherwise(raw)
            num = F.when(text.rlike(u(p)), F.regexp_extract(text, u(p), 1)).otherwise(num)
        return let(F.struct(text.alias("t"), raw.alias("raw"), num.alias("num")), lambda s: use(s["t"], s["raw"], s["num"]))

    def split(text: Column) -> Column:
        return cut(text, TRAIL_NUMBERS, lambda t, trail_raw, trail: cut(
            strip(F.substring(t, F.lit(1), F.length(t) - F.length(trail_raw))), LEAD_NUMBERS,
            lambda u, lead_raw, lead: let(strip(F.substring(u, F.length(lead_raw) + 1, F.length(u))), lambda core: F.when(
                core == "", F.struct(F.lit("").alias("lead"), F.lit("").alias("lead_raw"), t.alias("core"), F.lit("").alias("trail_raw"), F.lit("").alias("trail"))
            ).otherwise(F.struct(lead.alias("lead"), lead_raw.alias("lead_raw"), core.alias("core"), trail_raw.alias("trail_raw"), trail.alias("trail")))),
        ))

    return let(strip(F.coalesce(c, F.lit(""))), split)


def number_of(c: Column) -> Column:
    """The number that a run of digits of any script means; null for anything else."""
    return F.translate(c, _DIGITS, "0123456789" * (len(_DIGITS) // 10)).try_cast("bigint")


def format_prefix(template: str, number: Column) -> Column:
    """A title prefix with the number in place of {n}, {num}, {} or a lone x, else after it."""
    text, n = template.strip(), number.cast("string")
    if not text:
        return F.concat(n, F.lit(" "))
    out = F.lit(text)
    if any(p in text for p in ("{n}", "{num}", "{}")):
        for p in ("{n}", "{num}", "{}"):
            out = F.replace(out, F.lit(p), n)
    elif m := re.search(r"(?<![A-Za-z0-9])x(?![A-Za-z0-9])", text):
        out = F.concat(F.lit(text[: m.start()]), n, F.lit(text[m.end() :]))
    else:
        out = F.concat(F.lit(text + " "), n)
    return F.concat(strip(out), F.lit(" "))


def state_name(c: Column) -> Column:
    """A file name of word characters, dots and dashes; `book` where nothing is left."""
    clean = replaced(replaced(c, "(?U)[^\\w.\\-]+", "_"), "_+", "_")
    clean = replaced(clean, "^[._]+|[._]+$")
    return F.when(clean == "", F.lit("book")).otherwise(clean)


def substituted(text: str, values: dict[str, Column]) -> Column:
    """A template with ${name} or {name} replaced; unknown names become empty."""
    if not text:
        return F.lit("")
    parts = re.split(r"\$?\{(\w+)\}", text)
    return F.concat(*(F.lit(p) if k % 2 == 0 else values.get(p, F.lit("")).cast("string") for k, p in enumerate(parts)))


def edge_whitespace_kept(source: Column, value: Column) -> Column:
    """value without its own edges, between the blank edges of source."""
    return F.concat(F.regexp_extract(source, f"^[{_BLANK}]*", 0), strip(value), F.regexp_extract(source, f"[{_BLANK}]*\\z", 0))


def collapsed_quotes(c: Column) -> Column:
    return replaced(replaced(replaced(c, "“{2,}", "“"), "”{2,}", "”"), '"{2,}', '"')


def json_edges_stripped(c: Column) -> Column:
    """Without quotes and commas left from a JSON array around a paragraph."""
    for pattern, by in QUOTE_EDGES:
        c = replaced(c, u(pattern).replace("$", "\\z"), by)
    return c


@dataclass(frozen=True)
class Rule:
    """A replacement of the user's own; an invalid pattern is left out."""

    pattern: str
    replace: str = ""
    is_regex: bool = False
    enabled: bool = True


def _unbalanced(c: Column, when: Callable[[Column], Column], cut: str) -> Column:
    return let(c, lambda t: F.when(when(t), replaced(t, cut)).otherwise(t))


@dataclass(frozen=True)
class Cleaning:
    """Which of the cleaning steps apply, in their fixed order."""

    enabled: bool = True
    strip_json_residue: bool = True
    strip_numbers: bool = True
    fix_quotes: bool = True
    collapse_quotes: bool = True
    polish_punctuation: bool = True
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def __call__(self, c: Column) -> Column:
        """Clean a paragraph; disabled cleaning and empty texts leave it as it is."""
        if not self.enabled:
            return c
        out = c
        if self.strip_json_residue:
            out = replaced(out, u(JSON_KEY))
        if self.strip_numbers:
            for pattern in LIST_NUMBERS:
                out = replaced(out, u(pattern))
        if self.strip_json_residue:
            out = _unbalanced(out, lambda t: t.startswith("{") & ~t.endswith("}"), "^[{\\n\\r\\t ]+")
            for mark, other in (("}", "{"), ("]", "["), (",", ",")):
                out = _unbalanced(out, lambda t: t.endswith(mark) & ~t.startswith(other), f"[\\{mark}\\n\\r\\t ]+\\z")  # noqa: B023  used at once
        if self.fix_quotes:
            quotes = lambda t: F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))
            inner = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)
            out = let(out, lambda t: F.when(t.startswith('"') & ~t.endswith('"') & (quotes(t) % 2 == 1), lstrip(F.substring(t, F.lit(2), F.length(t)))).otherwise(t))
            out = let(out, lambda t: F.when(t.startswith('"“') & t.endswith('”"'), inner(t)).when(t.startswith('"') & t.endswith('"') & (quotes(t) == 2) & ~inner(t).rlike("[“”]"), inner(t)).otherwise(t))
        if self.collapse_quotes:
            out = json_edges_stripped(collapsed_quotes(out))
        if self.polish_punctuation:
            for pattern, by in PUNCTUATION:
                out = replaced(out, pattern, by)
        for rule in self.rules:
            if rule.enabled and rule.pattern:
                if not rule.is_regex:
                    out = F.replace(out, F.lit(rule.pattern), F.lit(rule.replace))
                elif valid_pattern(rule.pattern):
                    out = replaced(out, u(rule.pattern), rule.replace)
        return F.when(F.length(c) == 0, c).otherwise(strip(out))

    def all(self, paragraphs: Column) -> Column:
        """Clean an array of paragraphs and leave out those that end empty."""
        return F.filter(F.transform(paragraphs, self), lambda p: p != "") if self.enabled else paragraphs


def valid_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def quoted(text: str) -> str:
    """A literal for Java's regular expressions."""
    return re.sub(r"([\\.\[\]{}()*+?^$|/#&~\-])", r"\\\1", text)


def occurrences(c: Column, source: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, source, F.lit("")))) / F.length(source)).cast("long")


def reconciled(items: Column, expected: Column) -> Column:
    """Paragraphs brought to the expected number: a single one is split by lines, too many are cut, too few padded."""
    clean = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")

    def fit(a: Column) -> Column:
        lines = clean(F.split(F.element_at(a, 1), "\\n+"))
        b = F.when((F.size(a) == 1) & (expected > 1) & (F.size(lines) > 1), lines).otherwise(a)
        return let(b, lambda x: F.slice(F.concat(x, F.array_repeat(F.lit(""), F.greatest(F.lit(0), expected - F.size(x)))), F.lit(1), expected))

    return let(clean(items), fit)


def aligned(items: Column, expected: Column, source: Column | None = None) -> Column:
    """Items in `expected` places; blank places take the source paragraph, if one is given."""

    def at(i: Column) -> Column:
        own = strip(F.coalesce(F.get(items, i), F.lit("")))
        other = strip(F.coalesce(F.get(source, i), F.lit(""))) if source is not None else F.lit("")
        return F.when(own != "", own).otherwise(other)

    return F.when(expected > 0, F.transform(F.sequence(F.lit(0), expected - 1), at)).otherwise(F.array().cast("array<string>"))


def json_strings(c: Column) -> Column:
    """Quoted strings of a broken JSON text without its structural keys."""
    found = F.transform(F.regexp_extract_all(c, F.lit('"((?:[^"\\\\]|\\\\.)*)"'), F.lit(1)), strip)
    return F.filter(found, lambda s: (F.length(s) >= 2) & ~s.isin("paragraphs", "translation", "text", "content") & ~s.rlike(u("^[pP]\\d+$")))


def json_payload(c: Column) -> Column:
    """The JSON value in a reply as a variant: the whole, a fenced part, the outermost braces or brackets; null if none parses."""
    part = lambda p: F.try_parse_json(F.regexp_extract(c, p, 1))
    return F.coalesce(F.try_parse_json(strip(c)), part(u("(?si)```(?:json)?\\s*(.*?)```")), part("(?s)(\\{.*\\})"), part("(?s)(\\[.*\\])"))


def safe_resource_name(c: Column) -> Column:
    """A name inside the package: names that climb out of it go to a folder by their kind."""
    base = F.regexp_extract(c, "([^/\\\\]*)$", 1)
    folder = F.when(F.lower(base).rlike("\\.(png|jpe?g|gif|svg|webp)$"), "Images").when(F.lower(base).endswith(".css"), "Styles").otherwise("Misc")
    return F.when(F.array_contains(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), ".."), F.concat(folder, F.lit("/"), base)).otherwise(c)


def css_urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(u("url\\(\\s*['\"]?([^'\")]+?)['\"]?\\s*\\)")), F.lit(1))


def volume_of(source_id: Column) -> Column:
    return F.regexp_extract(source_id, u("^(v\\d+):"), 1)
