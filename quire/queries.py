"""Queries of the book and corpus operators, with their DuckDB counterparts.

The driver's tables have no novels, so documents stand in for books (their lines for
paragraphs, their source for a series) and small literal tables for glossaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.functions.replace import one_pass, replacements
from quire.operators import archive, books, glossary, narrator, packs, sample, segment

#: Headings in the stand-in corpus: a line of one or two words with a full stop.
LATIN = "^[^ ]+\\.$|^[^ ]+ [^ ]+\\.$"
_TRIM = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Non-blank lines of every document in order, stripped."""
    split = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    return split.select("doc_id", "ord", t.strip(F.col("line")).alias("text")).where("text <> ''")


def _as_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a source as the chapters of a book."""
    return documents(spark, sf).select("source", F.col("doc_id").alias("position"), F.col("n_chars").alias("chars"))


_LINES = f"""lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, unnest(string_split(text, chr(10))) AS raw FROM documents),
paras AS (SELECT doc_id, ord, trim(raw, {_TRIM}) AS text FROM lines WHERE trim(raw, {_TRIM}) <> '')"""


@query(f"""WITH RECURSIVE {_LINES},
flagged AS (SELECT doc_id, ord, text, length(text) <= 90 AND regexp_matches(text, '{LATIN}') AS h FROM paras),
parts AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS part, bool_or(h) OVER (PARTITION BY doc_id) AS any_h FROM flagged),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n, length(text) AS len FROM parts WHERE NOT any_h),
f AS (SELECT doc_id, n, len, len + 1 AS held, 0 AS pack FROM p WHERE n = 1
  UNION ALL SELECT p.doc_id, p.n, p.len, CASE WHEN f.held + p.len + 1 > 8000 THEN p.len + 1 ELSE f.held + p.len + 1 END, CASE WHEN f.held + p.len + 1 > 8000 THEN f.pack + 1 ELSE f.pack END FROM f JOIN p ON p.doc_id = f.doc_id AND p.n = f.n + 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS BIGINT) AS chapter_index, coalesce(max(CASE WHEN h THEN text END), '正文') AS title,
  count(CASE WHEN NOT h THEN 1 END) AS n_paragraphs, CAST(coalesce(sum(CASE WHEN NOT h THEN length(text) END), 0) AS BIGINT) AS chars
FROM parts WHERE any_h GROUP BY doc_id, part
UNION ALL SELECT doc_id, CAST(pack AS BIGINT), '第 ' || (pack + 1) || ' 节', count(*), CAST(sum(len) AS BIGINT) FROM f GROUP BY doc_id, pack""")
def chapter_segmentation(spark, sf):
    """Chapters of every document: by headings, or packed by size where a text has none."""
    c = segment.chapters(documents(spark, sf), (LATIN,), "doc_id")
    body = F.transform("paragraphs", t.strip)
    return c.select("doc_id", F.col("chapter_index").cast("long").alias("chapter_index"), "title", F.size("paragraphs").cast("long").alias("n_paragraphs"), segment.chars(body).alias("chars"))


@query(f"""WITH RECURSIVE {_LINES},
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n, length(text) AS len FROM paras),
f AS (SELECT doc_id, n, len + 1 AS held, 0 AS pack FROM p WHERE n = 1
  UNION ALL SELECT p.doc_id, p.n, CASE WHEN f.held + p.len + 1 > 400 THEN p.len + 1 ELSE f.held + p.len + 1 END, CASE WHEN f.held + p.len + 1 > 400 THEN f.pack + 1 ELSE f.pack END FROM f JOIN p ON p.doc_id = f.doc_id AND p.n = f.n + 1)
SELECT doc_id, CAST(pack AS BIGINT) AS pack, count(*) AS pieces, CAST(sum(len) AS BIGINT) AS chars FROM f JOIN p USING (doc_id, n) GROUP BY doc_id, pack""")
def greedy_packs(spark, sf):
    pieces = F.filter(F.transform(F.split("text", "\n", -1), t.strip), lambda p: p != "")
    packs = documents(spark, sf).select("doc_id", F.posexplode(segment.packed(pieces, 400)).alias("pack", "p"))
    return packs.select("doc_id", F.col("pack").cast("long").alias("pack"), F.size("p").cast("long").alias("pieces"), segment.chars(F.col("p")).alias("chars"))


@query()
def chunks(spark, sf):
    c = segment.chunks(segment.chapters(documents(spark, sf), (LATIN,), "doc_id"), 1800, 2600, "doc_id")
    return c.select("doc_id", "chunk_id", "chapter_index", "chunk_index", F.size("paragraphs").cast("long").alias("pieces"), segment.chars(F.col("paragraphs")).alias("chars"))


@query()
def chunk_signatures(spark, sf):
    return segment.signature(segment.chunks(segment.chapters(documents(spark, sf), (LATIN,), "doc_id"), 1800, 2600, "doc_id"), "doc_id")


_VALID = """v0 AS (SELECT source, doc_id AS position, n_chars AS chars, max((n_chars >= 300)::INT) OVER (PARTITION BY source) AS a FROM documents),
v AS (SELECT source, position, chars, row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total FROM v0 WHERE a = 0 OR chars >= 300)"""


@query(f"""WITH {_VALID}, b AS (SELECT *, (SELECT max(r) FROM range(6) t(r) WHERE floor(r::DOUBLE * (total::DOUBLE / 6)) <= pos) AS bucket FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY chars DESC, pos) AS rk FROM b)
SELECT source, position, chars FROM k WHERE total <= 6 OR rk = 1""")
def strided_sample(spark, sf):
    return sample.strided(_as_chapters(spark, sf), "source").select("source", "position", "chars")


_REGION = f"""{_VALID}, b AS (SELECT *, (SELECT max(r) FROM range(3) t(r) WHERE r < least(3, total) AND floor(r * total / least(3, total)) <= pos) AS bucket FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY chars DESC, pos) AS rk FROM b)"""


@query(f"WITH {_REGION} SELECT source, position, chars FROM k WHERE total <= 6 OR rk BETWEEN 1 AND 2")
def region_sample(spark, sf):
    return sample.regional(_as_chapters(spark, sf), "source").select("source", "position", "chars")


@query(f"WITH {_REGION} SELECT source, position, chars FROM k WHERE total <= 6 OR rk BETWEEN 3 AND 4")
def region_sample_next_round(spark, sf):
    return sample.regional(_as_chapters(spark, sf), "source", skip=2).select("source", "position", "chars")


@query(f"""WITH {_REGION}, s AS (SELECT source, position FROM k WHERE total <= 6 OR rk BETWEEN 1 AND 2),
w AS (SELECT source, doc_id AS position, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, sum(n_chars) OVER (PARTITION BY source) AS tc, sum((n_chars >= 300)::INT) OVER (PARTITION BY source) AS nv FROM documents),
j AS (SELECT w.*, CASE WHEN n <= 1 THEN 1.0 ELSE round(p / (n - 1)::DOUBLE, 3) END AS pr FROM w JOIN s USING (source, position))
SELECT source, n AS total_chapters, CAST(CASE WHEN nv > 0 THEN nv ELSE n END AS BIGINT) AS valid_chapters, count(*) AS sample_chapters, CAST(tc AS BIGINT) AS total_chars,
 CAST(least(60000, greatest(30000, 30000 + 20000 * (tc // 100000))) AS BIGINT) AS budget_chars, bool_or(pr BETWEEN 0.25 AND 0.75) AS middle_covered, count(*) = n AS all_chapters
FROM j GROUP BY source, n, nv, tc""")
def sampling_report(spark, sf):
    from pyspark.sql import Window

    rows = _as_chapters(spark, sf)
    order = Window.partitionBy("source").orderBy("position")
    rows = rows.withColumn("position", F.row_number().over(order).cast("long") - 1)
    out = sample.report(rows, sample.regional(rows, "source"), "source")
    return out.select("source", "total_chapters", "valid_chapters", "sample_chapters", "total_chars", "budget_chars", "middle_covered", "all_chapters")


# a small glossary of words of the stand-in corpus, with nested sources and a chain trap
_TERMS = [
    (0, "the", "THE", "term", "", True, ["thee", "there"], False, []),
    (1, "and", "AND", "term", "joined", False, [], False, []),
    (2, "ther", "the", "person", "", True, ["ther THE"], False, ["thor", "AND"]),
    (3, "the", "DAS", "term", "second", True, [], False, []),
    (4, "", "leer", "term", "", True, ["ing"], False, []),
    (5, "ent", "", "term", "", True, [], False, []),
    (6, "ion", "ION!", "person-nickname", "", True, ["ti", "ION"], True, ["tion"]),
]
_COMMON = [(0, "and", "UND", "term", "", True, ["ANDE"], False, []), (1, "", "der", "term", "", True, ["die"], False, ["das"]), (2, "ther", "THER", "term", "", True, [], False, [])]


def _entries(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, glossary.SCHEMA)


def _values(name: str, rows: list) -> str:
    lit = lambda v: str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"[{', '.join(map(lit, v))}]::VARCHAR[]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'"
    return f"{name}(ord, ko, zh, kind, note, confirmed, alternatives, replace_short, zh_history) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


def _pairs_sql(name: str, table: str, without_ko: bool) -> str:
    some = f"zh <> '' AND (ko <> ''{' OR len(alternatives) > 0 OR len(zh_history) > 0' if without_ko else ''})"
    return f"""{name} AS (SELECT src, dst, min(ord) AS ord FROM (
 SELECT ko AS src, zh AS dst, ord FROM {table} WHERE {some} AND ko <> ''
 UNION ALL SELECT src, zh, ord FROM (SELECT unnest(alternatives) AS src, zh, ord, replace_short FROM {table} WHERE {some} AND confirmed) WHERE length(src) >= 2 AND (NOT contains(zh, src) OR replace_short)
 UNION ALL SELECT src, zh, ord FROM (SELECT unnest(zh_history) AS src, zh, ord FROM {table} WHERE {some} AND confirmed) WHERE length(src) >= 2 AND src <> zh AND src NOT IN (SELECT zh FROM {table} WHERE kind = 'person-nickname' AND zh <> '' AND ko <> '')
) GROUP BY src, dst)"""


_MERGED = f"""{_values('g', _TERMS)}, {_values('c', _COMMON)}, {_pairs_sql('gp', 'g', False)}, {_pairs_sql('cp', 'c', True)},
m AS (SELECT src, dst, origin FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY origin, ord, dst) AS rn FROM (SELECT *, 'common' AS origin FROM cp UNION ALL SELECT *, 'dedicated' FROM gp)) WHERE rn = 1)"""


@query(f"WITH {_values('g', _TERMS)} SELECT CAST(ord AS INT) AS ord, ko, zh FROM (SELECT *, row_number() OVER (PARTITION BY ko ORDER BY ord) AS rn FROM g WHERE ko <> '') WHERE rn = 1")
def glossary_dedupe(spark, sf):
    return glossary.deduplicated(_entries(spark, _TERMS)).select("ord", "ko", "zh")


@query(f"""WITH {_values('g', _TERMS)}, {_values('c', _COMMON)}
SELECT CAST(ord AS INT) AS ord, ko, zh FROM g UNION ALL SELECT CAST(ord + 7 AS INT), ko, zh FROM c WHERE ko <> '' AND zh <> '' AND ko NOT IN (SELECT ko FROM g)""")
def glossary_append(spark, sf):
    return glossary.appended(_entries(spark, _TERMS), _entries(spark, _COMMON)).select("ord", "ko", "zh")


@query(f"""WITH {_values('g', _TERMS)}, {_values('c', _COMMON)}, l AS (SELECT ko, arg_max(zh, ord) AS czh FROM c WHERE ko <> '' AND zh <> '' GROUP BY ko)
SELECT CAST(ord AS INT) AS ord, ko, coalesce(czh, zh) AS zh, array_to_string(CASE WHEN czh IS NOT NULL AND czh <> zh AND zh <> '' AND NOT list_contains(zh_history, zh) THEN list_append(zh_history, zh) ELSE zh_history END, ',') AS history,
 coalesce(czh <> zh, FALSE) AS overridden FROM g LEFT JOIN l USING (ko)""")
def glossary_override(spark, sf):
    return glossary.overridden(_entries(spark, _TERMS), _entries(spark, _COMMON)).select("ord", "ko", "zh", F.array_join("zh_history", ",").alias("history"), "overridden")


@query(f"""WITH {_values('g', _TERMS)}, {_values('c', _COMMON)}, e AS (SELECT * FROM g WHERE ord <> 3)
SELECT CAST(coalesce(e.ord, c.ord + (SELECT max(ord) FROM e) + 1) AS INT) AS ord, ko, coalesce(c.zh, e.zh) AS zh,
 array_to_string(CASE WHEN e.ord IS NOT NULL AND c.ord IS NOT NULL AND e.zh <> c.zh AND e.zh <> '' AND NOT list_contains(e.zh_history, e.zh) THEN list_append(e.zh_history, e.zh) ELSE coalesce(e.zh_history, c.zh_history) END, ',') AS history
FROM e FULL OUTER JOIN c USING (ko)""")
def glossary_upsert(spark, sf):
    kept = _entries(spark, [r for r in _TERMS if r[0] != 3])
    return glossary.upserted(kept, _entries(spark, _COMMON)).select("ord", "ko", "zh", F.array_join("zh_history", ",").alias("history"))


@query(f"WITH {_MERGED} SELECT src, dst, origin FROM m")
def replacement_pairs(spark, sf):
    return glossary.merged_pairs(_entries(spark, _TERMS), _entries(spark, _COMMON))


@query(f"""WITH {_MERGED}, r AS (SELECT string_agg(src, '|' ORDER BY length(src) DESC, src) AS re, map(list(src), list(dst)) AS mp FROM m)
SELECT doc_id, length(out) AS new_chars, sha256(out) AS sha FROM (SELECT doc_id, list_reduce(list_transform(range(len(s)), lambda i: s[i + 1] || coalesce(mp[h[i + 1]], '')), lambda a, b: a || b) AS out
 FROM (SELECT doc_id, regexp_split_to_array(text, re) AS s, regexp_extract_all(text, re) AS h, mp FROM documents, r))""")
def replacement_apply(spark, sf):
    pairs = glossary.collected(glossary.merged_pairs(_entries(spark, _TERMS), _entries(spark, _COMMON)))
    out = documents(spark, sf).select("doc_id", one_pass(F.col("text"), pairs).alias("out"))
    return out.select("doc_id", F.length("out").cast("long").alias("new_chars"), F.sha2("out", 256).alias("sha"))


_SOME = "list_distinct(regexp_extract_all(text, '[a-z]+'))"


@query(f"""WITH w AS (SELECT DISTINCT unnest({_SOME}) AS src FROM documents), g AS (SELECT src FROM w WHERE length(src) BETWEEN 2 AND 5 AND (src LIKE 's%' OR src LIKE 'an%')),
r AS (SELECT string_agg(src, '|' ORDER BY length(src) DESC, src) AS re FROM g), h AS (SELECT doc_id, regexp_split_to_array(text, re) AS s, regexp_extract_all(text, re) AS h FROM documents, r)
SELECT doc_id, CAST(len(h) AS BIGINT) AS replaced, CAST(len(list_distinct(h)) AS BIGINT) AS sources, sha256(list_reduce(list_transform(range(len(s)), lambda i: s[i + 1] || coalesce('<' || upper(h[i + 1]) || '>', '')), lambda a, b: a || b)) AS sha FROM h""")
def glossary_replacements(spark, sf):
    """Short words of the documents as a glossary of some thousand terms, nested in each other and in longer words: replaced in one pass, and counted as replaced."""
    d = documents(spark, sf)
    words = d.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))).alias("src")).where("length(src) BETWEEN 2 AND 5 AND (src LIKE 's%' OR src LIKE 'an%')").distinct()
    pairs = glossary.collected(words.select("src", F.concat(F.lit("<"), F.upper("src"), F.lit(">")).alias("dst")))
    counts = replacements(d, "doc_id", pairs).groupBy("doc_id").agg(F.sum("replaced").alias("replaced"), F.count("*").alias("sources"))
    both = d.select("doc_id", F.sha2(one_pass(F.col("text"), pairs), 256).alias("sha")).join(counts, "doc_id", "left")
    return both.select("doc_id", F.coalesce("replaced", F.lit(0)).alias("replaced"), F.coalesce("sources", F.lit(0)).alias("sources"), "sha")


@query(f"""WITH {_MERGED}, {_LINES} SELECT src, origin, count(*) AS paragraphs, CAST(sum((length(text) - length(replace(text, src, ''))) // length(src)) AS BIGINT) AS occurrences
FROM paras JOIN m ON contains(text, src) GROUP BY src, origin""")
def replacement_preview(spark, sf):
    pairs = glossary.merged_pairs(_entries(spark, _TERMS), _entries(spark, _COMMON))
    found = glossary.hits(_paragraphs(spark, sf), F.broadcast(pairs), "doc_id")  # a literal table
    return found.groupBy("src", "origin").agg(F.count("*").alias("paragraphs"), F.sum("occurrences").alias("occurrences"))


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, ord, regexp_replace(regexp_replace(regexp_replace(text, '\\.{{3,}}', '……', 'g'), '[!！]{{2,}}', '！', 'g'), '[?？]{{2,}}', '？', 'g') AS x FROM
 (SELECT doc_id, ord, CASE WHEN ends_with(text, ',') AND NOT starts_with(text, ',') THEN rtrim(text, ',' || chr(9) || chr(10) || chr(13) || ' ') ELSE text END AS text FROM
 (SELECT doc_id, ord, regexp_replace(regexp_replace(regexp_replace(text, '^\\s*\\[\\d+\\]\\s*', ''), '^\\s*\\(\\d+\\)\\s*', ''), '^\\s*\\d+\\.\\s+', '') AS text FROM paras)))
SELECT doc_id, CAST(ord AS BIGINT) AS ord, trim(x, {_TRIM}) AS clean FROM p""")
def clean_paragraphs(spark, sf):
    return _paragraphs(spark, sf).select("doc_id", F.col("ord").cast("long").alias("ord"), t.Cleaning()(F.col("text")).alias("clean"))


@query("""WITH p AS (SELECT p_partkey, trim(p_brand || ' (' || p_size || ')') AS ko FROM part)
SELECT regexp_replace(regexp_replace(regexp_replace(ko, '\\s*\\(\\s*\\d+\\s*\\)\\s*$', ''), '\\s+', ' ', 'g'), '^$', ko) AS core, min(p_partkey) AS first_ord, count(*) AS members FROM p GROUP BY 1""")
def title_groups(spark, sf):
    titles = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("ord"), F.concat("p_brand", F.lit(" ("), "p_size", F.lit(")")).alias("ko"))
    return archive.title_groups(titles).select("core", "first_ord", "members")


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents) SELECT doc_id, CAST(ord AS BIGINT) AS ord FROM l WHERE ord % 3 = 0""")
def pending_chunks(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "text")).withColumn("ord", F.col("ord").cast("long"))
    return archive.pending(rows.drop("text"), rows.where("ord % 3 <> 0"), "doc_id", "ord")


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, unnest(string_split(text, chr(10))) AS text FROM documents),
a AS (SELECT doc_id, string_agg(CASE WHEN ord % 3 <> 0 THEN text || '*' ELSE text END, chr(10) ORDER BY ord) AS s, sum((ord % 3 <> 0)::INT) AS n FROM l GROUP BY doc_id)
SELECT doc_id, sha256(s) AS sha, CAST(n AS BIGINT) AS translated FROM a""")
def assembled_books(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    done = rows.where("ord % 3 <> 0").select("doc_id", "ord", F.concat("text", F.lit("*")).alias("text"))
    out = archive.assembled(rows, done, "doc_id", "ord").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "final"))).alias("l"), F.sum(F.col("translated").cast("long")).alias("translated"))
    return out.select("doc_id", F.sha2(F.array_join(F.transform("l", lambda x: x["final"]), "\n"), 256).alias("sha"), "translated")


@query("SELECT doc_id, regexp_matches(text, '[0-9a-f]{16,}') AS hit FROM documents WHERE regexp_matches(text, '[0-9a-f]{16,}')")
def pattern_audit(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.split("text", "\n", -1).alias("paragraphs"))
    return archive.matching(rows, "[0-9a-f]{16,}").select("doc_id", F.lit(True).alias("hit"))


@query("""WITH ch AS (SELECT source, CAST(doc_id AS BIGINT) AS i, string_split(text, chr(10))[1] AS title FROM documents), sv AS (SELECT source, i + 1 AS k, trim(title, chr(32)||chr(9)||chr(10)||chr(13)) AS title, 'z' || i AS zh FROM ch WHERE trim(title, chr(32)||chr(9)||chr(10)||chr(13)) <> ''),
ex AS (SELECT ch.source, ch.i, ch.title, sv.zh, sv.k FROM ch JOIN sv ON sv.source = ch.source AND sv.k = ch.i AND sv.title = ch.title),
r AS (SELECT *, row_number() OVER (PARTITION BY source, title ORDER BY i) AS n FROM ch WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.source = ch.source AND ex.i = ch.i) AND title <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY source, title ORDER BY k) AS n FROM sv WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.source = sv.source AND ex.k = sv.k))
SELECT source, i AS chapter_index, title, zh FROM ex UNION ALL SELECT r.source, r.i, r.title, f.zh FROM r JOIN f ON r.source = f.source AND r.title = f.title AND r.n = f.n""")
def matched_titles(spark, sf):
    rows = documents(spark, sf).select("source", F.col("doc_id").alias("chapter_index"), F.split("text", "\n", -1)[0].alias("title"))
    saved = rows.select("source", (F.col("chapter_index") + 1).alias("key"), F.col("title").alias("ko"), F.concat(F.lit("z"), "chapter_index").alias("zh"))
    return archive.matched_titles(saved, rows, "source")


@query("""WITH r AS (SELECT source, doc_id, n_chars, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS k FROM documents WHERE n_chars > 0),
c AS (SELECT source, avg(CASE WHEN k > floor(n * 0.1) AND k <= n - floor(n * 0.1) THEN n_chars END) AS mean, median(n_chars) AS med FROM r GROUP BY source),
e AS (SELECT source, CASE WHEN med > 0 AND NOT (mean BETWEEN med * 0.5 AND med * 2) THEN med ELSE mean END AS ce FROM c)
SELECT source, doc_id AS position, n_chars AS chars FROM r JOIN e USING (source) WHERE NOT (n_chars BETWEEN ce * 0.5 AND ce * 1.5)""")
def abnormal_chapters(spark, sf):
    return books.abnormal(_as_chapters(spark, sf), "source").select("source", "position", "chars")


@query("""WITH d AS (SELECT CAST(substr(source, 4) AS INT) + 1 AS v, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, lang FROM documents),
z AS (SELECT v, count(*) + 1 AS size FROM d GROUP BY v), s AS (SELECT v, coalesce(sum(size) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM z)
SELECT CAST(start + i + 1 AS INT) AS chapter_index, v AS volume_no, lang AS title, CAST(2 AS INT) AS heading_level, CAST(CASE WHEN i % 5 = 0 THEN start ELSE start + i - i % 5 + 1 END AS INT) AS parent_index, FALSE AS is_section FROM d JOIN s USING (v)
UNION ALL SELECT CAST(start AS INT), v, '合集 第' || v || '卷', 1, NULL, TRUE FROM s""")
def merged_volumes(spark, sf):
    from pyspark.sql import Window

    d = documents(spark, sf).select((F.substring("source", 4, 9).cast("int") + 1).alias("volume_no"), "doc_id", F.col("lang").alias("title"))
    d = d.withColumn("chapter_index", F.row_number().over(Window.partitionBy("volume_no").orderBy("doc_id")) - 1)
    tree = d.withColumn("parent_index", F.when(F.col("chapter_index") % 5 > 0, F.col("chapter_index") - F.col("chapter_index") % 5)).withColumn("heading_level", F.lit(1))
    return books.merged_volumes(tree, "合集")


@query("""WITH d AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, 'EP.' || (n_chars % 97) || ' ' || lang AS title, n_chars % 97 AS num FROM documents),
k AS (SELECT *, i - (i - 1) % 4 AS up FROM d), s AS (SELECT *, row_number() OVER (PARTITION BY source, CASE WHEN i = up THEN -1 ELSE up END ORDER BY num, i) AS seq FROM k),
p AS (SELECT s.*, CASE WHEN s.i = s.up THEN lpad(s.seq::VARCHAR, 10, '0') ELSE lpad(r.seq::VARCHAR, 10, '0') || '/' || lpad(s.seq::VARCHAR, 10, '0') END AS path FROM s JOIN s r ON r.source = s.source AND r.i = s.up)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY path) AS new_index, i AS chapter_index, CASE WHEN i = up THEN title ELSE '第 ' || num || ' 章 ' || trim(regexp_replace(title, '^EP\\.\\d+', '')) END AS new_title FROM p""")
def organised_titles(spark, sf):
    from pyspark.sql import Window

    d = documents(spark, sf).select("source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("chapter_index"), F.concat(F.lit("EP."), F.col("n_chars") % 97, F.lit(" "), "lang").alias("title"))
    top = F.col("chapter_index") - (F.col("chapter_index") - 1) % 4
    d = d.withColumn("parent_index", F.when(F.col("chapter_index") != top, top)).withColumn("heading_level", F.when(F.col("chapter_index") == top, 1).otherwise(2))
    return books.organised(d, "source", "第 x 章", by_number=True)


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, ord, text, regexp_matches(text, '^[^ ]+ [^ ]+\\.$') AS h, max(ord) OVER (PARTITION BY doc_id) AS ends FROM paras),
p AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS part FROM m),
g AS (SELECT doc_id, part, coalesce(max(CASE WHEN h THEN text END), '正文') AS title, count(CASE WHEN NOT h THEN 1 END) AS n_paragraphs, CAST(coalesce(sum(CASE WHEN NOT h THEN length(text) END), 0) AS BIGINT) AS chars, max(ord) = max(ends) AS fin FROM p GROUP BY doc_id, part)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS chapter_index, title, n_paragraphs, chars FROM g WHERE n_paragraphs > 0 OR NOT fin""")
def regex_resplit(spark, sf):
    out = segment.resplit(_paragraphs(spark, sf), "^[^ ]+ [^ ]+\\.$", book="doc_id")
    return out.withColumn("chapter_index", F.col("chapter_index").cast("long"))


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, ord, text, rtrim(text, '")]>)') AS core FROM paras)
SELECT doc_id, CAST(min(ord) AS BIGINT) AS first_ord, count(*) AS n FROM c WHERE length(text) <= 60 AND NOT regexp_matches(core, '[。！？…!?，、；：:]$') AND NOT regexp_matches(text, '^[\\d\\s（）()、，,.\\-—]+$') GROUP BY doc_id""")
def body_titles(spark, sf):
    rows = _paragraphs(spark, sf).where(t.looks_like_body_title(F.col("text")))
    return rows.groupBy("doc_id").agg(F.min("ord").cast("long").alias("first_ord"), F.count("*").alias("n"))


@query("SELECT doc_id, length(regexp_replace(text, '[^a-e]', '', 'g')) AS a_to_e, regexp_matches(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]') AS han, length(text) <= 2 AS weak FROM documents")
def text_predicates(spark, sf):
    c = F.col("text")
    return documents(spark, sf).select("doc_id", F.length(t.replaced(c, "[^a-e]")).cast("long").alias("a_to_e"), t.has_han(c).alias("han"), t.is_weak_title(c).alias("weak"))


@query("""SELECT source, sum(n_chars) AS chars, CAST(round_even(sum(n_chars) / 400.0, 0) AS BIGINT) AS minutes, count(*) AS chapters, grouping(source) AS total FROM documents GROUP BY ROLLUP (source)""")
def volume_chars(spark, sf):
    return books.volume_chars(documents(spark, sf).select("source", F.col("n_chars").alias("chars")), "source")


@query("""SELECT source, doc_id, CAST(grouping(source) + grouping(doc_id) AS INT) AS level, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(round_even(sum(n_chars) / 400.0, 0) AS BIGINT) AS minutes FROM documents GROUP BY ROLLUP (source, doc_id)""")
def char_tree(spark, sf):
    return books.char_tree(documents(spark, sf).select("source", "doc_id", F.col("n_chars").alias("chars")), "source", "doc_id")


@query()
def html_text_nodes(spark, sf):
    from quire.functions.html import text_nodes

    return text_nodes(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "html")


@query()
def html_replacement(spark, sf):
    from quire.functions.html import spliced_pages

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    done = spliced_pages(pages, "page_id", "html", [("the", "THE"), ("and", "AND"), ("der", "DER")])
    return done.select("page_id", "changed", F.sha2("content", 256).alias("sha"))


@query("""SELECT CAST(o_custkey AS BIGINT) AS archive, CAST(month(o_orderdate) AS INT) AS chapter_index, arg_max(o_orderpriority, o_orderkey) AS ko, arg_max(trim(substr(o_orderpriority, 3)), o_orderkey) AS zh
FROM orders WHERE o_orderstatus <> 'O' AND trim(substr(o_orderpriority, 3)) <> '' GROUP BY 1, 2""")
def saved_titles(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    zh = F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.substring("o_orderpriority", 3, 99))
    items = o.select(F.col("o_custkey").alias("archive"), F.month("o_orderdate").alias("chapter_index"), F.col("o_orderpriority").alias("ko"), zh.alias("zh"), F.col("o_orderkey").alias("seq"))
    return archive.saved_titles(items, "archive")


@query("""WITH e AS (SELECT c_nationkey AS series, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY 1)
SELECT series, CASE WHEN lo = hi THEN lo ELSE regexp_replace(left(lo, CAST(len(list_filter(range(1, length(lo) + 1), lambda k: left(lo, k) = left(hi, k))) AS BIGINT)), '[ \\t·—_/-]+$', '') END AS title FROM e""")
def common_titles(spark, sf):
    return books.common_title(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").alias("series"), F.col("c_name").alias("title")), "series")


@query(f"""WITH t AS (SELECT source, trim(string_split(text, chr(10))[1], {_TRIM}) AS title, min(doc_id) AS position FROM documents GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS n FROM t WHERE title <> '' AND length(title) <= 60) SELECT source, position, title FROM k WHERE n <= 80""")
def distinct_titles(spark, sf):
    """First lines as titles; the operator leaves out those over 60 characters."""
    rows = documents(spark, sf).select("source", F.col("doc_id").alias("position"), F.split("text", "\n", -1)[0].alias("title"))
    return sample.distinct_titles(rows, "source")


@query("""WITH d AS (SELECT source, doc_id AS position, n_chars AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS t FROM documents)
SELECT source, position, chars FROM d WHERE CASE WHEN least(t, 10) > 1 THEN list_contains(list_transform(range(0, least(t, 10)), lambda i: CAST(round_even(i * (t - 1) / (least(t, 10) - 1), 0) AS BIGINT)), p) ELSE p = 0 END""")
def evenly_spaced(spark, sf):
    return sample.evenly(_as_chapters(spark, sf), "source").select("source", "position", "chars")


@query("""WITH f AS (SELECT doc_id, n_chars, source, string_split(text, chr(10)) AS own FROM documents WHERE n_chars % 3 = 0), c AS (SELECT doc_id FROM documents WHERE n_chars % 2 = 0)
SELECT doc_id, CAST(CASE WHEN n_chars % 9 = 0 THEN 1 WHEN c.doc_id IS NOT NULL THEN len(own) END AS BIGINT) AS n_paragraphs, n_chars % 9 <> 0 AND c.doc_id IS NULL AS missing FROM f LEFT JOIN c USING (doc_id)""")
def failed_chunks(spark, sf):
    d = documents(spark, sf)
    failed = d.where("n_chars % 3 = 0").select("doc_id", F.when(F.col("n_chars") % 9 == 0, F.array("text")).alias("paragraphs"))
    own = d.where("n_chars % 2 = 0").select("doc_id", F.split("text", "\n", -1).alias("paragraphs"))
    found = archive.failed_view(failed, own, "doc_id")
    return found.select("doc_id", F.when(~F.col("missing"), F.size("paragraphs")).cast("long").alias("n_paragraphs"), "missing")


@query("""WITH b AS (SELECT source AS file, doc_id AS block, greatest(n_chars, 1) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), r AS (
WITH RECURSIVE f AS (SELECT file, k, n AS held, 0 AS batch FROM b WHERE k = 1 UNION ALL
 SELECT b.file, b.k, CASE WHEN f.held + b.n > 3000 THEN b.n ELSE f.held + b.n END, CASE WHEN f.held + b.n > 3000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN b ON b.file = f.file AND b.k = f.k + 1) SELECT * FROM f)
SELECT file, CAST(batch AS INT) AS batch, block FROM r JOIN b USING (file, k)""")
def block_batches(spark, sf):
    rows = documents(spark, sf).select(F.col("source").alias("file"), F.col("doc_id").alias("block"), F.col("n_chars").alias("chars"))
    return packs.packs(rows, "file", "block", "chars", 3000).select("file", "batch", "block")  # a source may hold a third of all rows


@query()
def narrator_progress(spark, sf):
    """Blocks of the pages, a third of them failed and a third completed."""
    from quire.functions.html import text_nodes

    options = narrator.Options("N", strategy="coverage")
    blocks = narrator.blocks(text_nodes(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "html"), "page_id", options)
    errors = blocks.where("block % 3 = 0").select("page_id", "block", F.lit(1).alias("seq"), F.lit("time-out").alias("error"))
    edits = blocks.where("block % 3 = 1").select("page_id", "block", F.lit(2).alias("seq"), F.transform("segments", F.upper).alias("segments"))
    events = narrator.failures(blocks, errors, "page_id").unionByName(narrator.manual(blocks, edits, "page_id").where("problem IS NULL").drop("problem"))
    return narrator.progress(narrator.state(blocks, events, "page_id"), "page_id")


from quire import queries_books  # noqa: E402, F401  registers its queries here
