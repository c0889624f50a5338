"""Hard negatives, language identification and spelling variants against plain versions, on tables with everything that can go wrong."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import hard_negatives as hn
from brindle.llm import language_id as li
from brindle.llm import oracles, queries
from brindle.llm import spelling as sp


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_spelling_variants"])
def test_queries_give_the_rows_of_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.execute(f"select {', '.join(df.columns)} from ({oracles.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert got and Counter(got) == Counter(want)


# ---- hard negatives -----------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, q string, cell int"


def vectors(n=300, dim=6, seed=5, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = [(i, [c + spread * r.gauss(0, 0.3) for c in centres[r.randrange(8)]], r.randrange(3), "x", 1) for i in range(n)]
    same = [1.0] * dim
    rows += [(1000 + i, same, i % 3, "x", 1) for i in range(60)]  # a group of equal vectors: ties
    rows += [rows[5], rows[20], rows[20]]  # repeated rows
    rows += [(2000, None, 1, "x", 1), (2001, [0.5] * dim, None, "x", 1), (None, [0.5] * dim, 1, "x", 1), (2003, [0.1, None, 1.0, 1.0, 1.0, 1.0], 1, "x", 1)]
    rows += [(2004, [math.nan] + [0.0] * (dim - 1), 1, "x", 1), (2005, [math.inf] + [0.0] * (dim - 1), 1, "x", 1), (2010, [0.0] * dim, 1, "x", 1), (2020, [2.0, 2.0], 1, "x", 1), (2030, [], 2, "x", 1)]
    return rows


def plain_negatives(rows, every, percent=(80, 100)):
    good = {}
    for i, v, lab, *_ in rows:
        if None in (i, v, lab) or any(x is None or not math.isfinite(x) for x in v):
            continue
        good[i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = []
    for i, lab, q in good:
        if i % every:
            continue
        score = {(j, b, p): sum(x * y for x, y in zip(q, p)) for j, b, p in good}
        first = sorted((-s, j) for (j, b, _), s in score.items() if b == lab and j != i)[:5]
        for s, j in first:
            fits = sorted((-t, k) for (k, b, _), t in score.items() if b != lab and percent[0] * -s <= 100 * t <= percent[1] * -s)[:5]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fits)]
    return Counter(out)


@pytest.mark.parametrize("leaf, chunk, block", [(256, 16_384, 2_000_000), (4, 50, 20)])
def test_negatives_as_by_brute_force(spark, monkeypatch, leaf, chunk, block):
    monkeypatch.setattr(hn, "CANDIDATE_LEAF", leaf)
    monkeypatch.setattr(hn, "ANCHOR_LEAF", leaf)
    monkeypatch.setattr(hn, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(hn, "BLOCK_NUMBERS", block)
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hn.mine(hn.quantised(df), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, 50)
    assert len(want) > 50 and Counter(map(tuple, got.collect())) == want


def test_no_vectors_give_no_negatives(spark):
    for rows in ([], [(100, [1.0, 2.0], 1, "x", 1)], [(100, None, None, None, None)]):
        assert hn.mine(hn.quantised(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 100 == 0).count() == 0


def test_whole_groups_of_anchors_are_pruned():
    """On clustered vectors few pairs of leaves are scored, and none that counts is missed."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16)) * 1000
    q = (centres[r.integers(0, 40, 8000)] + r.normal(size=(8000, 16)) * 20).astype(np.int64)
    label = r.integers(0, 4, 8000)
    ids = np.arange(8000)
    own = ids[:400]
    open_ = hn.Anchors.of(own, label[:400], q[:400], own, np.full(400, hn._NONE), np.full(400, np.iinfo(np.int64).max), own)
    best, scored = hn.Best(open_, True, 5), []
    take = best._take
    best._take = lambda w, s, *a: (scored.append(s.size), take(w, s, *a))
    best.search(ids, label, q)
    assert sum(scored) < 0.25 * 400 * 8000
    for w in (0, 77, 399):
        a = open_.owner[w]
        s = q @ open_.q[a]
        fits = np.flatnonzero((label == open_.label[a]) & (ids != open_.ids[a]))
        want = fits[np.lexsort((fits, -s[fits]))][:5]
        assert best.id[w].tolist() == want.tolist()


def test_scores_beyond_doubles_are_exact():
    x = np.array([[2**30 + 1, 3]])
    assert hn._product(x, x)[0, 0] == (2**30 + 1) ** 2 + 9


# ---- spelling -----------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("most", [1, 20, 10_000])
def test_near_words_as_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(sp, "CHUNK_WORDS", 50)
    r = random.Random(most)
    words = sorted({"".join(r.choice("abéÿ") for _ in range(r.randint(1, 7))) for _ in range(500)} | {"z" * i for i in range(3, 40)} | {"q" * 300, "q" * 301})
    vocab = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long").repartition(3)
    got = [tuple(r) for r in sp.near_pairs(vocab, most).collect()]
    n = {w: i + 2 for i, w in enumerate(words)}
    want = {(a, b, n[b]) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def plain_variants(docs):
    n = Counter()
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
                w = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                n[w] += len(w) > 6
                run = ""
    n = {w: c for w, c in n.items() if c > 1}
    by_rest = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by_rest[i, w[:i] + w[i + 1 :]].add(w)
    out = {}
    for w, c in n.items():
        friends = {x for i in range(len(w)) for x in by_rest[i, w[:i] + w[i + 1 :]]} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {x for i in range(len(w) + 1) for x in by_rest[i, w]}
        friends = (friends & set(n)) - {w}
        best = min(friends, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 10 * c else None, c, len(friends))
    rows = []
    for w, (form, c, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, c, k, n[form] if form else None))
    return Counter(rows)


def test_variants_of_whole_texts(spark):
    r = random.Random(8)
    base = ["separate", "Necessary", "accommodate", "überraschung", "éÉléphants×÷", "x" * 300, "rhythms"]
    texts = [" ".join(r.choice(base) for _ in range(60)) for _ in range(40)]
    typo = ["seperate", "seperete", "necesary", "acommodate", "rhytms", "uberraschung"]
    texts += [" ".join([*typo, *typo, *base]), "seperete " * 2, "seperate, " * 30, "chainaaa " * 2 + "chainbaa " * 20 + "chainbba " * 200, None, "", "1 2 3", "accommodate" * 3 + " " + "long words here, " * 60_000]
    rows = [(i, t, "de", 3, "w") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "necessary separate", "en", 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, prefix string").repartition(4)
    got = sp.variants(sp.vocabulary(sp.document_words(docs)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants([(i, t) for i, t, *_ in rows])
    assert any(r[2] != r[1] for r in want if r[1]) and Counter(map(tuple, got.collect())) == want
    empty = sp.variants(sp.vocabulary(sp.document_words(docs.limit(0))))
    assert empty.count() == 0 and empty.columns == got.columns
    assert sp.variants(sp.vocabulary(sp.document_words(docs, every=None))).where("word = 'seperate'").first().form == "separate"


# ---- language -----------------------------------------------------------------------------------------------------------


def plain_keys(text):
    codes = [0, 0, 0]
    for c in text:
        code = li._codes()[0][ord(c)]
        if code or codes[-1]:
            codes.append(int(code))
    return [sum(codes[i - b] << 16 * b for b in range(4)) for i in range(3, len(codes))]


def test_grams_of_texts_and_of_pieces(monkeypatch):
    texts = ["", "A b", "  ...", "né, à\n\nl'été 42!", "日本語 text", "\U00010400x", "x" * 50 + "  " + "Yz " * 40]
    for size in (1 << 20, 7, 1, 2):
        monkeypatch.setattr(li, "SLICE_CHARS", size)
        got, letter = defaultdict(list), defaultdict(bool)
        for i, j, g in li.grams(texts):
            for t, k in zip(g.text, g.key):
                got[i + int(t)].append(int(k))
            for t in range(i, j):
                letter[t] |= bool(g.has_letter[t - i])
        for i, t in enumerate(texts):
            assert got[i] == plain_keys(t), (size, t)
            assert letter[i] == any(c.isalpha() for c in t)


def plain_kneser_ney(texts):
    """P(last | first three) of every gram by the textbook's recursion, with counts in dictionaries."""
    c = {4: Counter(k for t in texts for k in plain_keys(t))}
    for size in (3, 2, 1):
        c[size] = Counter(k & ((1 << 16 * size) - 1) for k in c[size + 1])
    discount, total, kinds = {}, {}, {}
    for size, n in c.items():
        n1, n2 = (sum(v == i for v in n.values()) for i in (1, 2))
        discount[size] = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.9)
        total[size], kinds[size] = Counter(), Counter()
        for k, v in n.items():
            total[size][k >> 16] += v
            kinds[size][k >> 16] += 1

    def p(key, size):
        if not size:
            return 1 / 65536
        key &= (1 << 16 * size) - 1
        h, d = key >> 16, discount[size]
        if not total[size][h]:
            return p(key, size - 1)
        return max(c[size][key] - d, 0) / total[size][h] + d * kinds[size][h] / total[size][h] * p(key, size - 1)

    return lambda key: p(key, 4)


@pytest.fixture(scope="module")
def tongues(spark):
    r = random.Random(4)
    sets = {"aa": ["kala", "mutta", "että", "on", "tämä"], "bb": ["wieder", "und", "nicht", "größe", "das"], "cc": ["которые", "это", "ни", "так"], None: ["zzz"]}
    rows = [(i, " ".join(r.choice(sets[g]) for _ in range(r.randint(3, 60))), g, "l", 0.5) for i, g in enumerate(r.choice(list(sets)) for _ in range(600))]
    rows += [(700, None, "aa", "l", 0.5), (701, "", "aa", "l", 0.5), (702, "12 %", "bb", "l", 0.5), (None, "und nicht das", "bb", "l", 0.5), (703, "das größe " * 150_000, "bb", "l", 0.5)]
    rows += [rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(3).cache()


def test_probabilities_are_kneser_neys(spark, tongues):
    own = tongues.where("lang is not null and text is not null and length(text) < 10000").select("lang", "text", F.lit(0).alias("fold"))
    counts = li.gram_counts(own).select(F.lit("m").alias("model"), "lang", "gram", "n")
    model = li.model_of(li.probabilities(counts))
    texts = defaultdict(list)
    for g, t, _ in own.collect():
        texts[g].append(t)
    assert model.langs == ["aa", "bb", "cc"]
    keys = np.array(sorted({k for t in ["kala on und ~ это", "größe xyz", *texts["bb"][:5]] for k in plain_keys(t)}), np.uint64)
    got = model.log_probabilities(keys)
    for i, g in enumerate(model.langs):
        p = plain_kneser_ney(texts[g])
        assert np.allclose(got[:, i], [math.log(p(int(k))) for k in keys], atol=2e-4)
    small = li.model_of(li.probabilities(counts), max_cells=90)  # rare grams go to their lower orders: still a distribution
    assert sum(len(k) for k in small.key[1:]) * 3 <= 90
    h, n, _ = li.entropies(small, texts["aa"][:5])
    assert np.isfinite(h).all() and (h.argmin(1) == 0).all()


def test_languages_of_any_text(spark, tongues):
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = li.train(tongues, learn)
    out = li.identify(tongues, model, ["doc_id", "lang", "text"])
    rows = out.collect()
    assert out.columns == ["doc_id", "lang", "text", "lang_pred", "score", "rejected"] and len(rows) == tongues.count()
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert r.lang_pred == "und" and r.score == 0 and not r.rejected
        elif r.lang:
            assert r.lang_pred == r.lang and r.score > 0.8
        else:
            assert r.lang_pred in model.langs
    foreign = spark.createDataFrame([(1, "qqq xjx vvwx qzx " * 20), (2, "und nicht das größe und")], "doc_id long, text string")
    assert [r.rejected for r in li.identify(foreign, model, ["doc_id"]).orderBy("doc_id").collect()] == [True, False]
    again = li.identify(tongues, li.train(tongues, learn), ["doc_id", "lang", "text"]).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    none = li.train(tongues.limit(0), learn)
    assert {(r.lang_pred, r.score) for r in li.identify(tongues, none, ["doc_id"]).collect()} == {("und", 0.0)}
    assert li.identify(tongues.limit(0), model, ["doc_id"]).count() == 0


def test_languages_of_the_held_out_documents(spark):
    got = queries.op12_language_id(spark, "/root/testdata/sf0.01").alias("g").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    held = got.where("held_out and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[0] >= 0.98 and held[1] > 200
