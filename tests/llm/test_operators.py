"""The ten operators against brute force on small tables with nulls, ties, repeated rows and odd columns."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import textbytes as tb
from quire.llm import bpe, chat, decontaminate, embedding, labelled, langid, phrases, quality, queries, simhash, suffix, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
EXTRA = ", z int, doc string, rest int, w int, h int, fp int, block int, key int"


def texts(n=60, seed=0):
    """Documents with shared passages, copies, near copies, empty, null, very long and repetitive texts."""
    rng = np.random.default_rng(seed)
    line = " ".join(rng.choice(WORDS, 40))
    out = []
    for i in range(n):
        words = list(rng.choice(WORDS, rng.integers(1, 160)))
        if i % 4 == 0:
            words[:0] = line.split()
        out.append((i, "  ".join(words) if i % 7 else "\n".join(words)))
    out += [(100, None), (101, ""), (102, " \t\n"), (103, "Ünï cödé " * 60), (104, "ab" * 400), (105, "x " * 900)]
    out += [(106 + k, line + f" tail{k}") for k in range(5)] + [(120, out[3][1]), (121, out[3][1])]
    out += [(130, " ".join(rng.choice(WORDS, 6000)))]
    return out


def frame(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


def widened(spark, rows):
    """The same rows with further columns whose names the operators use inside."""
    return frame(spark, [(i, t, *[1] * 1, "d", *[1] * 6) for i, t in rows], "doc_id long, text string" + EXTRA)


def repeats(rows, units, width):
    """Brute force: for each row the units in a window that also starts earlier."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        u = units((t or "").encode())
        mask = np.zeros(len(u), bool)
        for k in range(len(u) - width + 1):
            w = bytes(u[k : k + width]) if isinstance(u, bytes) else tuple(u[k : k + width])
            if w in seen:
                mask[k : k + width] = True
            seen.add(w)
        out[i] = (u, mask)
    return out


@pytest.mark.parametrize("width", [100, 23])
def test_suffix_removes_exactly_the_repeated_strings(spark, width):
    rows = texts()
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix.deduplicated(widened(spark, rows), width).collect()}
    for i, (u, mask) in repeats(rows, bytes, width).items():
        assert got[i] == bytes(np.frombuffer(u, np.uint8)[~mask]), i


def test_suffix_spans_are_maximal_and_empty_tables_work(spark):
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffix.removed_spans(frame(spark, [(1, "a" * 250), (2, None)])).collect()}
    assert spans == {1: [(1, 250)], 2: []}
    assert suffix.deduplicated(frame(spark, [])).count() == 0


def test_suffix_takes_rows_of_one_id_as_one_document(spark):
    text = "0123456789" * 3 + "".join(map(chr, range(65, 91))) * 4
    got = [bytes(r["kept"]) for r in suffix.deduplicated(frame(spark, [(5, text[:120]), (5, text[:120]), (None, "q" * 99)])).collect()]
    assert sorted(got) == sorted([text[:120].encode(), text[:120].encode(), b"q" * 99])


@pytest.mark.parametrize("width", [20, 6])
def test_phrases_removes_exactly_the_repeated_windows(spark, width):
    rows = texts(seed=1)
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["w"]) for r in phrases.deduplicated(widened(spark, rows), width).collect()}
    for i, (u, mask) in repeats(rows, bytes.split, width).items():
        kept = b" ".join(w for w, gone in zip(u, mask, strict=True) if not gone).decode()
        text = dict(rows)[i] or ""
        assert got[i] == (kept if mask.any() else text, mask.sum(), 1), i
    assert phrases.deduplicated(frame(spark, [])).count() == 0


def test_phrases_spells_large_alphabets_with_two_letters():
    alphabet = phrases.Alphabet()
    ids = alphabet.ids([b"w%d" % k for k in range(1_000_001)])
    assert alphabet.letters == 2 and len(alphabet.spell(ids[-3:])) == 6
    small = phrases.Alphabet()
    assert len(set(small.spell(small.ids([b"v%d" % k for k in range(70_000)])))) == 70_000


def test_simhash_matches_brute_force(spark):
    import xxhash

    rows = texts(seed=2)
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(widened(spark, rows)).collect()}
    prints = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        shingles = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        prints[i] = sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))
    label = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            label[i] = min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4)
    assert got == {i: (fp - (fp >> 63 << 64), label[i]) for i, fp in prints.items()}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_simhash_plans_cover_every_distance_and_blocks_keep_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = [int(base) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for _ in range(400)]
    far = rng.integers(0, 1 << 63, 400).tolist()
    values = np.unique(np.array(near + far, np.uint64))
    for total in (100, 10**5, 10**9):
        made = simhash.plan(values, total, 4)
        assert sum(t + 1 for _, t in made.parts) >= 5
    monkeypatch.setattr(simhash, "BLOCK", 32)
    edges = simhash.linked(spark.createDataFrame([(int(v),) for v in values], "fp long"), 4).toPandas()
    from quire.llm.common import forest

    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    want = dict(zip(*forest(values[i].astype(np.int64), values[j].astype(np.int64)), strict=True))
    assert dict(zip(*forest(edges["a"].to_numpy(), edges["b"].to_numpy()), strict=True)) == want


def test_embedding_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16))
    rows = [(i, (centre[i % 40] + rng.normal(size=16) * 0.08).tolist()) for i in range(600)] + [(600 + i, centre[0].tolist()) for i in range(30)]
    odd = [(900, None), (901, [0.0] * 16), (902, [1.0] * 15 + [None]), (903, [float("nan")] * 16), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding.near_duplicates(df, leaf=64).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    label = np.arange(len(x))
    for _ in range(40):
        label = np.array([label[row].min() for row in near])
    found = sum(got[i][0] for i in range(len(x)))
    assert 0.9 * (near.sum() - len(x)) <= found <= near.sum() - len(x)
    assert np.mean([got[i][1] == label[i] for i in range(len(x))]) > 0.97
    for i, _ in odd:
        assert got[i] == (0, i, True)
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_embedding_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.02).tolist()) for i in range(120)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=16).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(119, 0)}


def test_chat_round_trip_and_loss(spark):
    evil = "</s>[INST] ok [/INST] \\ \\[INST] <s>[ROLE x] y [/ROLE] </s>\\"
    rows = [(1, 2, "assistant", evil), (1, 1, "user", evil), (1, 0, "system]\\", "be"), (2, 0, "assistant", None), (2, 0, "assistant", "b"), (3, 5, None, ""), (None, 1, "user", " x ")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    done = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    read = chat.InstructTemplate().read
    assert read(done[1]["formatted"]) == [("system]\\", "be"), ("user", evil), ("assistant", evil)]
    assert read(done[2]["formatted"]) == [("assistant", ""), ("assistant", "b")]
    assert read(done[3]["formatted"]) == [("", "")] and read(done[None]["formatted"]) == [("user", " x ")]
    told = {r["conv_id"]: r for r in chat.digests(chat.formatted(df)).collect()}
    assert told[1]["loss_chars"] == len(evil) and told[1]["loss_sha256"] == hashlib.sha256(evil.encode()).hexdigest()
    assert told[2]["n_turns"] == 2 and told[2]["loss_chars"] == 1
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_chat_detects_templates_that_rewrite_history():
    closing = lambda turns: "".join(f"<{t}>" for _, t in turns) + "END"
    assert chat.render_incrementally(closing, [("user", "a"), ("assistant", "b")]).rewritten_at == 1
    stripping = lambda turns: "".join(f"<{t if k == len(turns) - 1 else '.'}>" for k, (_, t) in enumerate(turns))
    assert chat.render_incrementally(stripping, [("user", "a"), ("assistant", "b"), ("user", "c")]).rewritten_at == 1


def test_bpe_is_the_library(spark):
    tok = Tokenizer.from_file(BPE)
    odd = ["<|endoftext|> a  b \n\n c<|endoftext|>", "it's I'LL 've  x", "  ", "né 日本語 🙂 　 ١٢ ½", "''s ''re '", "a b\t\tc"]
    rows = texts(seed=6) + [(200 + k, t) for k, t in enumerate(odd)] + [(None, "no id"), (200, odd[0])]
    got = bpe.encoded(widened(spark, rows), BPE)
    found = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), tuple(r["ids"])) for r in got.collect())
    want = sorted(((i if i is not None else -1), tuple(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert found == want
    back = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text"]) for r in bpe.decoded(got, BPE).collect())
    assert back == sorted(((i if i is not None else -1), t or "") for i, t in rows)
    assert bpe.digests(frame(spark, []), BPE).count() == 0


def test_decontamination_matches_brute_force(spark):
    rows = texts(seed=7)
    long = dict(rows)[130].split()
    items = [(1, " ".join(long[50:75])), (2, "Alpha-BETA, gamma"), (3, None), (4, "!!"), (5, " ".join(long[60:72]).upper()), (None, " ".join(long[300:312])), (1, "nowhere to be found at all")]
    rows += [(300, "… " + " ".join(long[55:66]) + " É"), (301, "alpha beta GAMMA alpha beta gamma"), (301, "alpha beta GAMMA alpha beta gamma"), (None, "alpha beta gamma")]
    got = decontaminate.decontaminated(widened(spark, rows), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, size int"))
    lower = lambda t: "".join(c.lower() if c < "\x80" else c for c in t or "")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    table = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            table.setdefault(tuple(w[k : k + 10]), set()).update({str(i)} if i is not None else set())
    want = []
    for i, t in rows:
        w = cut(t)
        mask, names = np.zeros(len(w), bool), set()
        for size in {len(x) for x in table}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in table:
                    mask[k : k + size] = True
                    names |= table[tuple(w[k : k + size])]
        want.append((i if i is not None else -1, len(w), int(mask.sum()), tuple(sorted(names))))
    found = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()]
    assert sorted(found) == sorted(want)
    assert {r["doc_id"] for r in decontaminate.cleaned(widened(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()} == {i for i, t in rows if (i if i is not None else -1) in {x[0] for x in want if not x[2]}}
    assert decontaminate.decontaminated(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.decontaminated(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_language_is_learned_and_told(spark):
    rng = np.random.default_rng(8)
    vocabularies = {"aa": ["gora", "mita", "selu", "pon"], "bb": ["krzt", "vlno", "hrux", "dzem"]}
    rows = [(i, " ".join(rng.choice(vocabularies[lang], 30)), lang) for i in range(200) for lang in ("aa" if i % 3 else "bb",)]
    rows += [(500, None, "aa"), (501, "12 !?", "bb"), (502, "", None), (503, "—…", "aa"), (504, "日本", None)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, score int")
    filters = langid.learn(df, labelled.fold(4) != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, filters).collect()}
    assert np.mean([got[i][0] == lang for i, _, lang in rows[:200]]) > 0.98
    assert all(got[i] == ("und", 0.0) for i in (500, 501, 502, 503)) and got[504] == ("aa", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    none = langid.learn(df.limit(0), labelled.fold(4) != 2)
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}


def test_toxicity_learns_a_pair_that_no_linear_model_can(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(1500):
        a, b = rng.random(2) < 0.5
        rows.append((i, " ".join([*rng.choice(WORDS, 5), *["slur"] * int(a), *["folk"] * int(b)])))
        labels.append((i, int(a and b), 1))
    rows += [(5000, None), (5001, "")]
    labels += [(0, None, None), (None, 1, 1)]
    docs, marks = widened(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    machine = toxicity.learn(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y, _ in labels[:1500]]) > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    assert toxicity.accepted(docs, machine).columns == docs.columns
    empty = toxicity.learn(docs, marks.limit(0))
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} == {0.5}
    assert toxicity.accepted(docs, empty).count() == len(rows)


def test_quality_ranks_and_keeps_the_quantile(spark):
    rng = np.random.default_rng(10)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        rows.append((i, " ".join(rng.choice(WORDS, 60)) + "." if good else " ".join(w + "###" for w in rng.choice(WORDS, 60))))
        labels.append((i, int(good)))
    docs, marks = widened(spark, [*rows, (900, None), (901, "")]), spark.createDataFrame(labels, "doc_id long, quality int")
    ranking = quality.learn(docs, marks)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, ranking).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, y in labels]) > 0.98
    assert all(0 <= s <= 1 for s in got.values())


def test_queries_are_registered_and_the_pipeline_runs(spark):
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))
    sf = "/root/testdata/sf0.001"
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    tok = Tokenizer.from_file(BPE)
    assert 0 < len(rows) < len(documents)
    for r in rows:
        assert hashlib.sha256(tok.decode(r["ids"], skip_special_tokens=False).encode()).hexdigest() == r["decoded_sha256"]


def test_toxicity_keeps_a_quarter_of_the_terms_by_frequency():
    import inspect

    n, words = 40, 40
    doc, term = np.repeat(np.arange(n), words), np.tile(np.arange(words, dtype=np.uint64), n)
    machine = toxicity.fit(doc, term, np.arange(n) % 2.0, terms=32, rounds=1)
    assert len(machine.terms) == 8  # words of every document tell nothing alone
    assert inspect.signature(toxicity.learn).parameters["most"].default == 20_000


def test_simhash_keeps_a_clean_text_that_shares_its_id_with_a_copy(spark):
    rng = np.random.default_rng(8)
    one, two, three = (" ".join(rng.choice(WORDS, 80)) for _ in range(3))
    rows = [(1, one), (2, one), (2, two), (3, None), (4, None), (4, three), (5, two), (None, one), (6, "said twice"), (6, "said twice")]
    got = [(r["doc_id"], r["text"], r["w"]) for r in simhash.deduplicated(widened(spark, rows)).collect()]
    want = [(1, one), (2, two), (3, None), (4, three), (None, one), (6, "said twice"), (6, "said twice")]
    assert sorted(got, key=repr) == sorted([(i, t, 1) for i, t in want], key=repr)


def test_language_tells_more_languages_than_a_mask_has_bits(spark):
    rng = np.random.default_rng(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:02d}": ["".join(rng.choice(list(letters), 6)) for _ in range(6)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(own[f"l{i % 70:02d}"], 12)), f"l{i % 70:02d}") for i in range(1400)]
    rows += [(2000, "x" * 300_000 + " " + " ".join(own["l69"] * 9000), "l69"), (None, " ".join(own["l03"] * 3), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.learn(df, labelled.fold(4) != 2, max_train_docs=700, least=5)
    assert len(filters.languages) == 70 and len(filters.planes) == 2
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, filters).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows[:1400]]) > 0.99
    assert got[2000] == "l69" and got[None] == "l03"


def plain_languages(rows, filters, planes):
    """The decision of language filters in plain Python: sets of n-grams and counts."""
    size, out = len(planes[0]), {}
    rounds = lambda x: tb.mix(np.array([x], np.uint64))[0]
    for i, text in rows:
        data = "".join(c if c.isalpha() else " " for c in text or "").lower().encode()  # texts of ASCII alone
        hits, total = [0] * len(filters.languages), 0
        for n in langid.GRAMS:
            for k in range(len(data) - n + 1):
                packed = int.from_bytes(data[k : k + n], "big") | n << 56
                total += 1
                h = int(rounds(packed))
                at = [h >> (p * 21) & (size - 1) for p in range(langid.PROBES)]
                for b in range(len(hits)):
                    hits[b] += all(int(planes[b // 64][a]) >> (b % 64) & 1 for a in at)
        true = [max(0.0, (h - total * f) / max(1e-9, 1 - f)) for h, f in zip(hits, filters.false_rate, strict=True)]
        best = max(range(len(true)), key=lambda b: (true[b], -b))
        out[i] = (filters.languages[best], true[best] / sum(true) if sum(true) else 0.0) if any(c.isalpha() for c in text or "") else ("und", 0.0)
    return out


def test_language_scores_are_those_of_a_plain_count(spark):
    rng = np.random.default_rng(13)
    vocabularies = {"aa": ["gora", "mita", "selu", "pon"], "bb": ["krzt", "mita", "hrux", "dzem"]}
    rows = [(i, " ".join(rng.choice(vocabularies["aa" if i % 2 else "bb"], 8)), "aa" if i % 2 else "bb") for i in range(60)] + [(60, None, "aa"), (61, "Gora KRZT 12!", None), (62, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.learn(df, labelled.fold(4) != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, filters).collect()}
    for i, (lang, score) in plain_languages([r[:2] for r in rows], filters, filters.planes).items():
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9, i


def test_decontamination_takes_windows_in_blocks_and_equal_rows(spark, monkeypatch):
    rng = np.random.default_rng(14)
    text = " ".join(rng.choice(WORDS, 200))
    rows = [(1, text), (1, text), (1, "other " + text[:200]), (2, None), (None, text), (None, text), (3, "clean text of its own"), (4, ""), (5, "eta " * 40_000)]
    items = spark.createDataFrame([(k, " ".join(text.split()[k * 20 : k * 20 + 14])) for k in range(8)] + [(50, "clean of"), (51, "own")], "item_id long, text string")
    want = sorted((tuple(r) for r in decontaminate.decontaminated(frame(spark, rows), items).collect()), key=repr)
    for name, value in (("BLOCK_WINDOWS", 7), ("BROADCAST_CANDIDATES", 0)):
        monkeypatch.setattr(decontaminate, name, value)
        got = sorted((tuple(r) for r in decontaminate.decontaminated(frame(spark, rows), items).collect()), key=repr)
        assert got == want and len(got) == len(rows)
        kept = [r["doc_id"] for r in decontaminate.cleaned(widened(spark, rows), items).collect()]
        assert sorted(kept, key=repr) == sorted([2, 4, 5], key=repr)


@pytest.mark.parametrize("width", [100, 23])
def test_suffix_takes_unlike_rows_of_one_id_as_documents(spark, width):
    rng = np.random.default_rng(15)
    one, two = (" ".join(rng.choice(WORDS, 60)) for _ in range(2))
    rows = [(3, one), (5, one), (5, two), (5, two), (None, two[:150]), (7, two[40:] + one), (None, None), (9, "é" * 70 + one[:120])]
    got = [(r["doc_id"], bytes(r["kept"])) for r in suffix.deduplicated(widened(spark, rows), width).collect()]
    distinct = {(i, t or "") for i, t in rows}
    hashed = {t: spark.range(1).selectExpr(f"xxhash64('{t}')").first()[0] for _, t in distinct}
    ordered = sorted(distinct, key=lambda r: (-1 if r[0] is None else r[0], hashed[r[1]]))
    kept = {ordered[k]: bytes(np.frombuffer(u, np.uint8)[~mask]) for k, (u, mask) in repeats([(k, t) for k, (_, t) in enumerate(ordered)], bytes, width).items()}
    assert sorted(got, key=repr) == sorted([(i, kept[i, t or ""]) for i, t in rows], key=repr)
    assert [k for i, k in got if i == 5].count(kept[5, two]) == 2


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_window_rows_are_settled_alike_however_they_are_dealt(hot):
    import pyarrow as pa

    from quire.llm import windows as win

    rng = np.random.default_rng(16)
    n = 4000
    key = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 900, n)).astype(np.uint64)
    sub, sub2 = rng.integers(0, 12, n).astype(np.uint64), rng.integers(0, 2, n).astype(np.uint64)
    doc, at = rng.permutation(n).astype(np.int64), np.zeros(n, np.int64)
    content = dict(zip(doc.tolist(), zip(key.tolist(), sub.tolist(), sub2.tolist(), strict=True), strict=True))
    tasks = [b for k in range(0, n, 130) for b in win._settle_locally(*(x[k : k + 130] for x in (key, sub, sub2, doc, at)), hot=hot)]
    table = pa.Table.from_batches(tasks).sort_by([(c, "ascending") for c in ("key", "sub", "sub2", "doc", "at")])
    for rows in (3, 64, n):
        out = pa.Table.from_batches(list(win.settled(iter(table.to_batches(rows)), ["key", "sub", "sub2"], False))).to_pylist()
        opened = {r["doc"] for r in out if r["open"]}
        again = {r["doc"]: r["doc0"] for r in out if not r["open"]}
        assert len(out) == len(opened) + len(again) and not opened & set(again)
        assert all(content[a] == content[b] and b < a for a, b in again.items())
        contents: dict = {}
        for c in content.values():
            contents.setdefault(c[0], set()).add(c)
        for d, c in content.items():
            if d not in again:  # of a digit with several contents none is taken to be alone
                assert (d in opened) >= (len(contents[c[0]]) > 1)
        assert {content[d] for d in opened} >= {c for s in contents.values() if len(s) > 1 for c in s}


@pytest.mark.parametrize(("words", "docs"), [(1 << 19, 20_000), (60, 3)])
def test_phrases_shards_and_cells_find_every_occurrence(spark, monkeypatch, words, docs):
    monkeypatch.setattr(phrases, "SHARD_WORDS", words)
    monkeypatch.setattr(phrases, "CELL_DOCS", docs)
    monkeypatch.setattr(phrases, "BROADCAST_SHARDS", 1 if words < 100 else 10)
    rng = np.random.default_rng(17)
    rows = texts(seed=17)
    one, two = (" ".join(rng.choice(WORDS, 60)) for _ in range(2))
    rows += [(300, one), (301, one), (301, one), (302, two[100:] + " " + one), (None, two)]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in phrases.deduplicated(widened(spark, rows), 20).collect()), key=repr)
    distinct = sorted(set(rows), key=lambda r: -1 if r[0] is None else r[0])
    want = {}
    for k, (u, mask) in repeats([(k, t) for k, (_, t) in enumerate(distinct)], bytes.split, 20).items():
        kept = b" ".join(w for w, gone in zip(u, mask, strict=True) if not gone).decode()
        want[distinct[k]] = (kept if mask.any() else distinct[k][1] or "", int(mask.sum()))
    assert got == sorted(((i, *want[i, t]) for i, t in rows), key=repr)


def test_phrases_takes_unlike_rows_of_one_id_as_documents(spark):
    rng = np.random.default_rng(18)
    one, two = (" ".join(rng.choice(WORDS, 60)) for _ in range(2))
    got = [(r["doc_id"], r["n_removed"]) for r in phrases.deduplicated(widened(spark, [(3, one), (5, one), (5, two), (7, two + " end")])).collect()]
    assert sorted(got) == [(3, 0), (5, 0), (5, 60), (7, 60)]


def brute_links(rows, cosine=0.95):
    """n_links and component of (id, vector) rows, whose ids may be null or repeat."""
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    label = np.array([np.iinfo(np.int64).max if i is None else i for i, _ in rows])
    for _ in range(60):
        label = np.array([label[row].min() for row in near])
    return near.sum(1) - 1, label


def test_embedding_trees_are_deep_and_lose_next_to_nothing(spark):
    rng = np.random.default_rng(19)
    centre = rng.normal(size=(900, 24))
    rows = [(i, (centre[i % 900] + rng.normal(size=24) * 0.12).tolist()) for i in range(3600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    classes = embedding.vectors(df).select("vec_id", "vec").withColumnRenamed("vec_id", "id").cache()
    leaves = embedding.placed(classes, 24, 0.95, 4, 12, 64, 64).groupBy("leaf").count().toPandas()["count"]
    assert len(leaves) > 4 * 2**6 and leaves.max() <= 3 * 12  # fitted on 64 of 3,600 and split on from there
    got = {r["vec_id"]: r["n_links"] for r in embedding.near_duplicates(df, leaf=12, fit_sample=64, refit_sample=64).collect()}
    n, _ = brute_links(rows)
    assert n.sum() > 2000 and all(got[i] <= n[i] for i in got)
    assert sum(got.values()) >= 0.99 * n.sum()


def test_embedding_links_rows_without_an_id_and_ignores_other_columns(spark):
    rng = np.random.default_rng(20)
    base = rng.normal(size=(6, 12))
    rows = [(i if i % 3 else None, (base[i % 6] + rng.normal(size=12) * 0.02).tolist()) for i in range(60)]
    rows += [(7, rows[1][1]), (7, rows[2][1]), (None, rows[1][1])]  # repeated ids, equal vectors
    odd = [(None, None), (None, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, "x", 1, 2, 3, 4) for i, v in rows + odd], "vec_id long, embedding array<double>, label string, id int, leaf int, n int, component int")
    n, label = brute_links(rows)
    last = np.iinfo(np.int64).max
    want = [(i, int(k), None if c == last else int(c), (None if c == last else int(c)) == i) for (i, _), k, c in zip(rows, n, label, strict=True)]
    want += [(None, 0, None, True)] * 2
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding.near_duplicates(df, leaf=8).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bpe_encodes_rows_of_one_id_and_small_blocks_alike(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 2000)
    tok = Tokenizer.from_file(BPE)
    rows = [*texts(seed=21), (3, "another text of the id"), (3, None), (None, "no id"), (None, "none either")]
    found = sorted(((r["doc_id"], tuple(r["ids"])) for r in bpe.encoded(widened(spark, rows), BPE).collect()), key=repr)
    assert found == sorted(((i, tuple(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)


def test_toxicity_scores_are_those_of_a_double_loop(spark):
    rng = np.random.default_rng(22)
    rows = [(i, " ".join([*rng.choice(WORDS, 6), *["slur"] * (i % 2), *["Folk!"] * (i % 3 == 0)])) for i in range(300)] + [(900, None), (901, ""), (902, "slur folk " * 50_000), (902, "same id")]
    docs = frame(spark, rows)
    machine = toxicity.learn(docs, spark.createDataFrame([(i, int(i % 6 == 3)) for i in range(300)], "doc_id long, toxic int"))
    place = {int(t): k for k, t in enumerate(machine.terms)}
    want = []
    for i, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        terms = sorted({int(toxicity.term_sets(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[1][0]) for w in re.findall(rb"[0-9a-z]+", bytes(toxicity.tb.LOWER[data]))})
        at = [place[t] for t in terms if t in place]
        logit = machine.bias + sum(machine.linear[k] for k in at) + sum(float(machine.factors[j] @ machine.factors[k]) for n, j in enumerate(at) for k in at[n + 1 :])
        want.append((i, 1 / (1 + np.exp(-np.clip(logit, -40, 40)))))
    got = sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs, machine).collect())
    assert np.allclose(got, sorted(want))


def test_quality_scores_are_those_of_a_plain_measurement(spark):
    rng = np.random.default_rng(23)
    rows = [(i, "  ".join(w.title() if k % 5 == 0 else w + "#" * (i % 2) for k, w in enumerate(rng.choice(WORDS, 20))) + "\n42, ok!") for i in range(120)] + [(900, None), (901, ""), (902, "Long | word\n" * 3_000), (902, "one")]
    docs = frame(spark, rows)
    ranking = quality.learn(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id long, quality int"))

    def measured(text):
        data = (text or "").encode()
        if not data:
            return [0.0] * len(quality.COLUMNS)
        share = [sum(bool(member[b]) for b in data) / len(data) for member in quality._CLASSES.values()]
        words, n = data.split(), len(data.split())
        low, mark, upper = [w.lower() for w in words], set(b"#$%&*+=<>@^_`{|}~\\/[]()!"), set(range(65, 91))
        lines = data.count(b"\n") + 1
        rest = [np.log1p(n) / 10, sum(map(len, words)) / n / 10, sum(len(w) > 12 for w in words) / n, sum(len(w) < 3 for w in words) / n, len(set(low)) / n,
                sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, np.log1p(n / lines) / 10, sum(w[-1] in mark for w in words) / n, sum(w[0] in upper for w in words) / n, sum(len(w) > 1 and w[0] in upper and w[1] in upper for w in words) / n]
        hashed = [int(toxicity.tb.mix(toxicity.tb.ranged(toxicity.tb.prefix(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)])))[0]) % quality.BUCKETS for w in low]
        return [*share, np.log1p(len(data)) / 10, *rest, *(hashed.count(k) / n for k in range(quality.BUCKETS))]

    want = []
    for i, text in rows:
        z = np.clip((np.array(measured(text)) - ranking.mean) / ranking.scale, -6, 6)
        strength = sum(a * w for a, w in zip([*z, *abs(z[: len(quality.NAMES)])], ranking.weights, strict=True))
        want.append((i, 1 / (1 + np.exp(-np.clip(ranking.slope * (strength - ranking.threshold) + np.log(0.3 / 0.7), -40, 40)))))
    got = sorted((r["doc_id"], r["score"]) for r in quality.score(docs, ranking).collect())
    assert np.allclose(got, sorted(want))


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_joins_with_hot_keys_are_joins(spark, rows):
    from quire.llm.common import dealt_join

    many = spark.createDataFrame([(k % 40 if k % 2 else 3, k) for k in range(400)] + [(None, 900), (77, 901)], "key long, x long")
    one_ = spark.createDataFrame([(k, f"v{k}") for k in range(60) if k != 9], "key long, y string")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, many.join(one_, "key", how).select("key", "x", "y").collect()), key=repr)
        assert sorted(map(tuple, dealt_join(many, one_, "key", how, rows).select("key", "x", "y").collect()), key=repr) == plain
