"""The registered queries and the pipeline over small whole tables, against brute force, and over empty tables."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import queries, toxicity
from tests.llm.test_operators import WORDS, repeats, texts

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, rest int, doc int, z int, kept int, score double, _id int, _h int, n_removed int, `a.b` int"
TABLES = {
    "documents": DOCUMENTS, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string",
}


def documents():
    """The texts of the operator tests with toxic, contaminated, wholly repeated and id-less documents."""
    rng = np.random.default_rng(11)
    rows = texts(seed=11)
    passage = " ".join(rng.choice(WORDS, 30))
    rows += [(200, passage + " one"), (201, "two " + passage), (202, passage), (203, "leaked " + BENCHMARK[0][1]), (204, "alpha")]
    rows += [(None, "a row without an id " + " ".join(rng.choice(WORDS, 50))), (206, "said twice"), (206, "said twice")]
    rows += [(300 + k, " ".join([*rng.choice(WORDS, 30), "slur", "folk"])) for k in range(60)]
    return rows


BENCHMARK = [(1, "what is the tallest mountain of the seven old kingdoms called today"), (2, None), (3, "...")]


def stored(spark, root, **tables):
    for name, kind in TABLES.items():
        spark.createDataFrame(tables.get(name, []), kind).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rows = [(i, t, "en", "hot", None if t is None else len(t), 1, 2, 3, 4, 0.5, 5, 6, 7, 8) for i, t in documents()]
    labels = [(i, int(i % 3 > 0), int(i >= 300)) for i, _ in documents() if i is not None] + [(None, 1, 1), (7, None, None)]
    return stored(spark, tmp_path_factory.mktemp("tables"), documents=rows, labels=labels, benchmark=BENCHMARK)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("empty"))


def low(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", low(text))
    shingles = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def components(prints):
    label = {i: i for i in prints}
    for _ in prints:
        after = {i: min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if after == label:
            return label
        label = after
    return label


def hit(text):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, wins = cut(text), set()
    for _, item in BENCHMARK:
        v = cut(item)
        wins |= {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9) if v else 0)}
    return any(tuple(w[k : k + n]) in wins for n in {len(x) for x in wins} for k in range(len(w) - n + 1))


def key(row):
    return [-(1 << 63) if row[0] is None else row[0], *map(str, row[1:])]


def test_pipeline_is_its_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    machine = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    gone = {r["doc_id"] for r in toxicity.score(docs, machine).where("score >= 0.5").collect()}
    assert gone == set(range(300, 360))
    left = [(i, t, None if t is None else len(t)) for i, t in documents() if i not in gone]
    want = [left]
    label = components({i: fingerprint(t) for i, t, _ in left if i is not None})
    want.append([r for r in left if r[0] is None or label[r[0]] == r[0]])
    cut = []
    for n, (i, t, chars) in enumerate(ordered := sorted(want[-1], key=key)):
        words, mask = repeats([(k, x[1]) for k, x in enumerate(ordered)], bytes.split, 20)[n]
        if mask.any():
            kept = b" ".join(w for w, off in zip(words, mask, strict=True) if not off).decode()
            if kept:
                cut.append((i, kept, len(kept)))
        else:
            cut.append((i, t, chars))
    assert len(cut) < len(want[-1])  # a document made of repeated passages alone is there, and goes
    want += [cut, [r for r in cut if not hit(r[1])]]
    assert len(want[-1]) < len(cut)
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert [f.name for f in docs.schema] == [x.split()[0].strip("`") for x in DOCUMENTS.split(", ")], name
        got = [(r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()]
        plain = lambda rs: sorted(((i, t or "", c or 0) for i, t, c in rs), key=key)
        assert plain(got) == plain(rows), name
        assert docs.where("rest <> 1 OR doc <> 2 OR z <> 3 OR kept <> 4 OR score <> 0.5 OR source <> 'hot'").count() == 0
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    got = sorted(((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()), key=key)
    ids = [(i, tuple(tok.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _ in want[-1]]
    assert got == sorted(((i, x, hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids), key=key)


def result(spark, name, sf):
    number = f"op{name}_"
    df = next(f for q, f in queries.QUERIES.items() if q.startswith(number))(spark, sf)
    return {(r["doc_id"], n): r for n, r in enumerate(df.collect())}, df.columns


def test_suffix_query_is_its_brute_force(spark, sf):
    found, _ = result(spark, 1, sf)
    got = {i: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for (i, _), r in found.items()}
    ordered = sorted(documents(), key=key)
    for n, (u, mask) in repeats([(k, t) for k, (_, t) in enumerate(ordered)], bytes, 100).items():
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(u, np.uint8)[~mask])
        assert got[ordered[n][0]] == (len(u), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()), ordered[n][0]


def test_simhash_query_is_its_brute_force(spark, sf):
    found, _ = result(spark, 9, sf)
    prints = {i: fingerprint(t) for i, t in documents() if i is not None}
    label = components(prints)
    for (i, _), r in found.items():
        if i is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[i]:016x}", label[i])


def test_bpe_query_is_the_library(spark, sf):
    found, _ = result(spark, 6, sf)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for (i, _), r in found.items():
        text = next(t for j, t in documents() if i == j) or ""
        ids = tok.encode(text, add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


@pytest.mark.parametrize(("name", "column", "fold", "part"), [(2, "lang_pred", 4, 2), (4, "predicted", 5, 0), (5, "predicted", 5, 0)])
def test_classifier_queries_tell_every_row_once(spark, sf, name, column, fold, part):
    import zlib

    found, columns = result(spark, name, sf)
    assert {"doc_id", "held_out", "score", column} <= set(columns)
    assert sorted(str(i) for i, _ in found) == sorted(str(i) for i, _ in documents())
    for (i, _), r in found.items():
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % fold == part)
        if column == "predicted":
            assert r["predicted"] == int(r["score"] >= (0.5 if name == 4 else 0.3))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_over_empty_tables(spark, empty, name):
    got = queries.QUERIES[name](spark, empty).collect()
    assert [r["conv_id"] for r in got] == ([-7] if name.startswith("op10_") else [])


def test_pipeline_over_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_takes_unlike_rows_of_one_id_one_by_one(spark, tmp_path):
    rng = np.random.default_rng(24)
    one, two, three, four = (" ".join(rng.choice(WORDS, 70)) for _ in range(4))
    rows = [(1, one), (2, one), (2, two), (2, three + " leaked " + BENCHMARK[0][1]), (3, two), (3, four), (3, four), (4, four[40:] + " and " + one[:150]), (None, two), (None, three), (5, None), (5, "end")]
    sf = stored(spark, tmp_path, documents=[(i, t, "en", "s", None if t is None else len(t), 1, 2, 3, 4, 0.5, 5, 6, 7, 8) for i, t in rows], benchmark=BENCHMARK)
    named = [(i, t) for i, t in rows if i is not None]
    prints = [fingerprint(t) for _, t in named]
    label = components(dict(enumerate(prints)))
    least = {c: min(i for (i, _), m in zip(named, label.values(), strict=True) if m == c) for c in set(label.values())}
    kept = [r for r, c in zip(named, label.values(), strict=True) if least[c] == r[0]] + [r for r in rows if r[0] is None]
    hashes = {t: spark.createDataFrame([(t,)], "t string").selectExpr("xxhash64(t)").first()[0] for _, t in kept}
    order = sorted(set(kept), key=lambda r: (-1 if r[0] is None else r[0], hashes[r[1]]))
    cut = {}
    for n, (words, mask) in repeats([(k, t) for k, (_, t) in enumerate(order)], bytes.split, 20).items():
        cut[order[n]] = b" ".join(w for w, gone in zip(words, mask, strict=True) if not gone).decode() if mask.any() else order[n][1]
    last = [(i, cut[i, t]) for i, t in kept if cut[i, t] or not t]
    want = sorted(((i, t or "") for i, t in last if not hit(t)), key=repr)
    assert len(want) < len(last) < len(rows) and any(cut[r] != r[1] for r in kept)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
    assert sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=repr) == want
