"""Paths inside a package: resolving references and writing them relative to another file, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let, strip

#: References that leave the package, or stay in the same file (fixed values).
OUTSIDE = "(?i)^(?:data:|https?:|mailto:|#)"


def _steps(path: Column) -> Column:
    """The path's parts without `.` and empty ones; `..` takes one back, and stays where there is none."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        climbs = (part == "..") & path.startswith("/")
        return F.when(back, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(climbs, done).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, empty, step)


def without_query(href: Column) -> Column:
    return F.regexp_replace(strip(href), "(?s)[?#].*$", "")


def fragment(href: Column) -> Column:
    """`#...` of a reference, or an empty string."""
    return F.regexp_extract(href, "(?s)(#.*)$", 1)


def resolved(base: Column, href: Column) -> Column:
    """The package path that `href` means in the file `base`; null if it is empty or leads outside."""
    plain = without_query(href)
    named = F.replace(F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain), F.lit("\\"), F.lit("/"))
    folder = F.regexp_replace(F.replace(base, F.lit("\\"), F.lit("/")), "[^/]*$", "")
    whole = F.when(named.startswith("/"), named).otherwise(F.concat(folder, named))
    return F.when((plain != "") & ~F.rlike(strip(href), F.lit(OUTSIDE)), let(whole, lambda p: F.array_join(_steps(p), "/")))


def relative(document: Column, resource: Column) -> Column:
    """The reference to `resource` that is written in `document`; both are package paths."""
    own, other = F.split(F.regexp_replace(document, "/?[^/]*$", ""), "/"), F.split(resource, "/")
    own = F.filter(own, lambda p: p != "")
    shared = F.array_position(F.zip_with(own, other, lambda a, b: F.coalesce(a == b, F.lit(False))), False).cast("int") - 1
    return F.concat(F.repeat(F.lit("../"), F.size(own) - shared), F.array_join(F.slice(other, shared + 1, F.size(other)), "/"))
