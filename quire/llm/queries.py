"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quire.llm.bpe import op6_bpe
from quire.llm.chat import op10_chat
from quire.llm.decontaminate import op3_decontaminate
from quire.llm.divergence import op12_divergence
from quire.llm.embedding import op8_embedding
from quire.llm.imatch import op13_imatch
from quire.llm.langid import op2_langid
from quire.llm.phrases import op7_phrases
from quire.llm.quality import op5_quality
from quire.llm.simhash import op9_simhash
from quire.llm.suffix import op1_suffix
from quire.llm.toxicity import op4_toxicity
from quire.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_suffix, op2_langid, op3_decontaminate, op4_toxicity, op5_quality, op6_bpe, op7_phrases, op8_embedding, op9_simhash, op10_chat, op11_whitening, op12_divergence, op13_imatch)}
ORACLE: dict[str, str] = {}

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE["op3_decontaminate"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), {_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), {_WORD}) AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + 9], ' ') AS k FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(i) WHERE len(w) > 0),
spots AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS k FROM d, (SELECT DISTINCT size FROM wins), unnest(range(1, greatest(1, len(w) - size + 2))) t(i)),
m AS (SELECT DISTINCT doc_id, i, size, item_id FROM spots JOIN wins USING (k, size)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: Bytes as pairs of hexadecimal digits; windows are told apart by their MD5.
ORACLE["op1_suffix"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, generate_subscripts(ks, 1) - 1 AS i, unnest(ks) AS k FROM (SELECT doc_id, list_transform(range(0, greatest(0, len(x) // 2 - 99)), lambda i: md5(substr(x, 2 * i + 1, 200))) AS ks FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
new AS (SELECT doc_id, i, i > coalesce(max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new FROM again),
span AS (SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM new) GROUP BY doc_id, run),
gap AS (SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS a, low AS b FROM span UNION ALL SELECT doc_id, max(high), 1000000000 FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS y FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

ORACLE["op7_phrases"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM d, unnest(range(1, greatest(1, len(w) - 18))) t(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

ORACLE["op8_embedding"] = """
WITH RECURSIVE link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT x AS vec_id, coalesce(n_links, 0) AS n_links, component_id, x = component_id AS kept FROM least LEFT JOIN n USING (x)"""

ORACLE["op10_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length(x) + len(regexp_extract_all(x, '\\|</?s>|\[/?(?:INST|ROLE)\b')) + CASE r WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 19 + length(r) + len(regexp_extract_all(r, '[\\\]]')) END AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
 CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""

ORACLE["op12_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d), g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3), a AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, CAST(1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM a),
l AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (sum(n) + 1) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM a GROUP BY lang, term),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
v AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM v) SELECT * FROM o WHERE part = 'pair' OR rank <= 200"""
