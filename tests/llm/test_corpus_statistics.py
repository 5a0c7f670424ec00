"""Whitening, divergence of sources and fingerprints against plain versions, with nulls, ties, repeats, hot rows and empty tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quire.llm import divergence, imatch, queries, whitening

EXTRA = "rest int, id int, x int, key int, range int, term string, n long, marks int, last boolean"
FILL = (1, 2, 3, 4, 5, "t", 6, 7, True)


def table(spark, root, name, rows, kind):
    spark.createDataFrame([(*r, *FILL) for r in rows], f"{kind}, {EXTRA}").write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    return str(root)


# whitening


def whitened_plainly(vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors])
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, deviation, values[::-1], c @ axes[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300)), values.sum()


def test_whitening_is_its_plain_version(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((300, 40)) * np.linspace(4, 0.5, 40)).astype(np.float32).astype(float).tolist()
    good += [good[0], good[0][:30] + [0.0] * 10]
    bad = [None, [None, *good[1][1:]], [float("nan"), *good[1][1:]], [*good[1][:-1], float("inf")]]
    rows = [(i, v) for i, v in enumerate(good[:-1])] + [(None, good[-1][:30])] + [(1000 + i, v) for i, v in enumerate(bad)]
    sf = table(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>")
    got = queries.QUERIES["op11_whitening"](spark, sf).collect()
    n, deviation, values, plain, trace = whitened_plainly(good)
    ids = [*range(len(good) - 1), None]
    assert len(got) == 32 * len(good) and {r["vec_id"] for r in got} == set(ids) and {r["n"] for r in got} == {n}
    assert {(r["vec_id"], r["deviation"]) for r in got} == set(zip(ids, deviation, strict=True))
    for k in range(32):
        mine = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        column = np.array([mine[i]["whitened"] for i in ids])
        assert min(np.abs(column - plain[:, k]).max(), np.abs(column + plain[:, k]).max()) < 1e-8
        assert math.isclose(mine[0]["explained"], values[k] / trace, rel_tol=1e-9) and mine[0]["identity_error"] < 1e-9


def test_whitening_of_tables_without_variance(spark, tmp_path):
    for k, rows in enumerate(([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, None)])):
        sf = table(spark, tmp_path / str(k), "embeddings", rows, "vec_id long, embedding array<float>")
        assert queries.QUERIES["op11_whitening"](spark, sf).collect() == []


def test_whitening_has_as_many_components_as_the_vectors_have_directions(spark, tmp_path):
    rows = [(i, [float(i), float(2 * i), 0.0, float(i % 2)]) for i in range(20)]
    got = queries.QUERIES["op11_whitening"](spark, table(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>")).collect()
    assert {r["component"] for r in got} == {1, 2} and math.isclose(sum(r["explained"] for r in got if r["vec_id"] == 0), 1, rel_tol=1e-12)


def test_lanczos_finds_the_eigenvectors_of_hard_operators():
    rng = np.random.default_rng(1)
    for values in (np.r_[np.zeros(150), 1.0, 2, 2, 3], np.r_[np.ones(100), 5, 5], np.linspace(1, 200, 200), np.r_[np.full(96, 1e-9), 1, 2, 3, 4.0]):
        basis = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        matrix = basis * values @ basis.T
        asked = []

        def apply(block, matrix=matrix, asked=asked):
            asked.append(block.shape[1])
            return matrix @ block

        found, vectors = whitening.lanczos(apply, len(values), 4)
        assert np.allclose(found, np.sort(values)[::-1][:4], atol=1e-10 * values.max())
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-10 * values.max() and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
        assert sum(asked) <= len(values)


def test_deviations_are_exact_beyond_a_long():
    x = np.array([[1 << 40, 0], [-(1 << 40), 5]])
    assert whitening._deviations(x, 1 << 40, [7, 9]) == [((1 << 80) - 7) ** 2 + 81, ((1 << 80) + 7) ** 2 + ((5 << 40) - 9) ** 2]


# divergence


def diverged_plainly(rows, least=3, ranks=200):
    terms = [[w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")] for t, _, _ in rows]
    out = set()
    for lang in {lang or "" for _, lang, _ in rows}:
        mine = [(w, s or "") for w, (_, g, s) in zip(terms, rows, strict=True) if (g or "") == lang]
        docs = Counter(t for w, _ in mine for t in set(w))
        kept = sorted((t for t in docs if docs[t] >= least), key=lambda t: t.encode())
        counts = {s: Counter() for _, s in mine}
        for w, s in mine:
            counts[s].update(t for t in w if t in set(kept))
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            own = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))):
                    if part == "pair" or k < ranks:
                        out.add((lang, s, part, item, value, k + 1))
    return out


def corpus():
    rng = np.random.default_rng(5)
    words = ["Ärger", "ärger", "Zoo", "zoo", "a1b", "été", "x", "Y", "漢字", "👍", "end", "ending", "ｚ"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 9))), ["en", "fr"][k % 2], f"s{rng.integers(0, 4)}") for k in range(80)]
    rows += [(None, "en", "none"), ("", None, None), ("alone here", "de", "only"), ("alone here", "de", "other"), ("zoo " * 5000, "en", "s1")]
    return rows + [rows[3]] * 4 + [("x x", "fr", None)] * 3


@pytest.mark.parametrize("cells", [1, 12, divergence.CELLS])
def test_divergence_is_its_plain_version(spark, cells):
    rows = corpus()
    df = spark.createDataFrame([(*r, *FILL) for r in rows], f"text string, lang string, source string, {EXTRA}")
    got = divergence.divergences(df, ranks=3, cells=cells).collect()
    assert {tuple(r) for r in got} == diverged_plainly(rows, ranks=3) and len(got) == len({tuple(r) for r in got})


def test_divergence_of_nothing(spark, tmp_path):
    sf = table(spark, tmp_path, "documents", [], "text string, lang string, source string")
    assert queries.QUERIES["op12_divergence"](spark, sf).collect() == []


def test_shares_are_exact_for_large_counts():
    counts, total = np.array([0, 10**15, 7 * 10**15]), np.array([8 * 10**15 + 1])
    assert divergence._shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(total[0]) for c in counts]


# fingerprints


def hashed(data, seed=42):
    value = xxhash.xxh64_intdigest(data, seed)
    return value - (1 << 64) if value >> 63 else value


def chained(values):
    seed = 42
    for v in values:
        seed = hashed(v.to_bytes(8, "little", signed=True), seed % (1 << 64))
    return seed


def terms_of(text):
    return {hashed(w.encode()) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower())}


def mark(text, lexicon):
    found = terms_of(text)
    kept = sorted(found & lexicon) or [chained(sorted(found)) if found else hashed(text.encode())]
    short, parts, left = lambda v: chained(v) % 0xFFFF + 1, [], kept
    for k in range(imatch.LEVELS):
        here = left if k == imatch.LEVELS - 1 else [t for t in left if t & imatch.PARTS << k]
        left = [t for t in left if t not in here]
        split = [[t for t in here if t % imatch.PARTS == p] for p in range(imatch.PARTS)]
        parts += [short(here)] * imatch.PARTS if len(here) > imatch.FULL else [short(s) if s else 0 for s in split]
    return chained(kept), parts


def alike(a, b):
    if a == b:
        return 1.0
    levels = [[(x, y) for x, y in zip(a[1][k : k + imatch.PARTS], b[1][k : k + imatch.PARTS], strict=True) if x or y] for k in range(0, len(a[1]), imatch.PARTS)]
    first = next((k for k, level in enumerate(levels) if len(level) <= imatch.CROWDED), imatch.LEVELS - 1)
    told = [x == y for level in levels[first:] for x, y in level]
    return sum(told) / len(told) if told else 0.0


def spelt(m):
    return f"{m[0] % (1 << 64):016x} " + "".join(f"{d:04x}" if d else "-" for d in m[1])


def matched_plainly(rows, low=imatch.LOW, high=imatch.HIGH):
    rows = [(i, t or "") for i, t in rows]
    df = Counter(t for _, text in rows for t in terms_of(text))
    lexicon = {t for t, n in df.items() if low * len(rows) <= n <= high * len(rows)}
    order = sorted(rows, key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0], hashed(r[1].encode())))
    out = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = mark(text, lexicon), mark(edited, lexicon), mark(after, lexicon)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), spelt(a), spelt(b), alike(a, b), alike(a, c)))
    return sorted(out, key=repr)


def many_texts():
    rng = np.random.default_rng(9)
    words = [c + a + b for c in "bdfgklmnprstvz" for a in "aeiouyäöüéèà" for b in ("a", "é", "i", "ol", "漢", "um", "x9y", "ING")]
    ids = rng.permutation(400).tolist()
    rows = [(i - 50, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in ids]
    rows += [(900, None), (901, ""), (902, "123 ..."), (903, "👍"), (904, " ".join(rng.choice(words, 6000))), (905, rows[7][1])]
    rows += [(906, "one and the same row")] * 30 + [(None, None)] * 25 + [(None, "no id"), (907, "first"), (907, "second"), (907, "third")]
    return rows


@pytest.mark.parametrize(("rows_a_range", "group", "hot"), [(imatch.RANGE_ROWS, imatch.GROUP, imatch.HOT_ROWS), (20, 2, 10), (7, 3, 4)])
def test_fingerprints_are_their_plain_version(spark, tmp_path, monkeypatch, rows_a_range, group, hot):
    for name, value in (("RANGE_ROWS", rows_a_range), ("GROUP", group), ("HOT_ROWS", hot)):
        monkeypatch.setattr(imatch, name, value)
    rows = many_texts()
    got = queries.QUERIES["op13_imatch"](spark, table(spark, tmp_path, "documents", rows, "doc_id long, text string")).collect()
    plain = matched_plainly(rows)
    assert sorted(map(tuple, got), key=repr) == plain
    assert 0.2 < np.mean([r[5] for r in plain]) and np.mean([r[6] for r in plain]) < 0.2 and len({r[3] for r in plain}) > 350


def test_rows_repeated_often_are_one_row_of_the_windows(spark, monkeypatch):
    monkeypatch.setattr(imatch, "HOT_ROWS", 50)
    df = spark.createDataFrame([(None, "again")] * 3000 + [(i, f"row {i}") for i in range(20)], "doc_id long, text string")
    beside, repeated = imatch.with_next(df)
    assert beside.where("NOT last").count() == 21 and [tuple(r) for r in repeated.collect()] == [(None, "again", 2999)]
    dealt = imatch._as_often(repeated.withColumn("marks", repeated["text"]), 50)
    assert dealt.count() == 2999


@pytest.mark.parametrize("rows", [[], [(1, "alone")], [(None, None)]])
def test_fingerprints_of_next_to_nothing(spark, tmp_path, rows):
    got = queries.QUERIES["op13_imatch"](spark, table(spark, tmp_path, "documents", rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == matched_plainly(rows)


def test_fingerprint_column_is_that_of_the_query(spark):
    df = spark.createDataFrame([(i, f"word{'abcdefgh'[i % 8]} other{'xyz'[i % 3]} text") for i in range(100)], "doc_id long, text string")
    found = {r["text"]: r["fingerprint"] for r in imatch.fingerprinted(df).collect()}
    assert len(found) == 24 == len(set(found.values()))
