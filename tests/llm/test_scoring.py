"""Search, toxicity and language ID against brute force and held-out accuracy; hostile tables."""

import zlib

import numpy as np
import pytest

from entityframe.llm import ann, language_id, toxicity

SF = "/root/testdata/sf0.001"


def brute_nearest(rows, k=20, every=20):
    """(query, rank) -> (id, score) of vectors that take part."""
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max({len(v) for _, v in good}, key=lambda d: sum(len(v) == d for _, v in good)) if good else 0
    good = [(i, v) for i, v in good if len(v) == dim]
    out = {}
    for q, v in good:
        if q % every == 0:
            best = sorted(((float((w * v).sum()), i) for i, w in good if i != q), key=lambda p: (-p[0], p[1]))[:k]
            out |= {(q, r + 1): (i, s) for r, (s, i) in enumerate(best)}
    return out


def test_search_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 700)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 14)) * rng.uniform(0.2, 3, (2000, 1)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df).collect()}
    want = brute_nearest(rows)
    assert got.keys() == want.keys()
    by = dict(rows)
    for (q, _), (i, s) in got.items():
        assert s == pytest.approx(float(np.dot(by[q], by[i])), rel=1e-12)
    near = lambda found: {(q, i) for (q, _), (i, _) in found.items()}
    assert len(near(got) & near(want)) >= 0.9 * len(want)


def test_search_finds_the_nearest_among_near_copies(spark):
    """More near copies of one vector in a block than a scan reranks first, at scales beyond single precision too."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1800, 64))
    v[::3] = v[0] + 0.01 * rng.normal(size=(600, 64))
    for scale in (1.0, 1e-60, 1e60):
        rows = [(i, x.tolist()) for i, x in enumerate(v * scale)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, every=300).collect()}
        assert got == brute_nearest(rows, every=300)


def test_rows_of_one_id_are_queries_and_candidates_each(spark):
    """Two rows have the id 20: each asks for itself, and has the other as a candidate."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in (0, *range(1, 40), 20, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(df, k=5).collect())
    want = []
    for n, (q, v) in enumerate(rows):
        if q % 20 == 0:
            best = sorted(((-float(np.dot(v, w)), i) for m, (i, w) in enumerate(rows) if m != n))[:5]
            want += [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(best)]
    assert got == sorted(want) and len(got) == 15


def test_search_hostile_rows(spark):
    """Rows that take no part, ties between copies, fewer candidates than asked for, clashing names."""
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (20, [1.0, None, 1.0]), (40, [float("nan"), 1.0, 1.0]), (60, [float("inf"), 1.0, 1.0]), (80, [1.0, 1.0]), (100, [0.5, 0.0, 0.0]), (7, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([*rows, (None, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS score", "3 AS query_id", "4 AS _v")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df).collect()}
    assert got == brute_nearest(rows)
    assert [got[0, r][0] for r in (1, 2)] == [1, 2]
    assert ann.search(df.limit(0)).collect() == []
    assert ann.search(df.where("vec_id IN (3, 4, 5)")).collect() == []


def made_toxic(n=600, seed=1):
    rng = np.random.default_rng(seed)
    calm = ["river", "stone", "window", "garden", "letter", "music", "morning", "harbour", "table", "forest"]
    rude = ["zlorp", "grimbag", "snivelwit", "idiot"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [calm[j] for j in rng.integers(0, 10, 30)]
        if toxic:
            for j in rng.integers(0, 30, 4):
                w[j] = rude[rng.integers(0, 4)]
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_catches_held_out_rows_and_leaves_clean_ones(spark):
    docs, labels = made_toxic()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS _y", "2 AS score", "'x' AS _text")
    lab = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 != 1], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == bool(y) for i, y in held) and len(got) == len(docs)
    kept = toxicity.reject(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}


def plain_label_model(votes, labels, rounds):
    """The same estimates by loops over rows and voters."""
    from math import exp, log, sqrt

    n, m = len(votes), len(votes[0])
    q = [0.95 if y else 0.05 for y in labels]
    for _ in range(rounds):
        est, near = [], [[i == j for j in range(m)] for i in range(m)]
        for soft in (q, [1 - x for x in q]):
            total = sum(soft)
            p = [(sum(s * v[j] for s, v in zip(soft, votes, strict=True)) + 0.5) / (total + 1) for j in range(m)]
            est.append((total, p, (sum(s * y for s, y in zip(soft, labels, strict=True)) + 1) / (total + 2)))
            cov = [[sum(s * (v[i] - p[i]) * (v[j] - p[j]) for s, v in zip(soft, votes, strict=True)) for j in range(m)] for i in range(m)]
            for i in range(m):
                for j in range(m):
                    near[i][j] |= cov[i][j] / (sqrt(cov[i][i]) + 1e-9) / (sqrt(cov[j][j]) + 1e-9) > toxicity.CORRELATED
        (n1, p1, l1), (n0, p0, l0) = est
        for k in range(n):
            z = log(n1) - log(n0) + (log(l1 / l0) if labels[k] else log((1 - l1) / (1 - l0)))
            for j in range(m):
                z += (log(p1[j] / p0[j]) if votes[k][j] else log((1 - p1[j]) / (1 - p0[j]))) / sum(near[j])
            q[k] = 1 / (1 + exp(-max(-30, min(30, z))))
    return q


def test_label_model_equals_plain_loops_and_discounts_copies():
    rng = np.random.default_rng(3)
    y = rng.random(300) < 0.3
    labels = np.where(rng.random(300) < 0.1, ~y, y).astype(int)
    rates = np.array([[0.1, 0.8], [0.05, 0.5], [0.3, 0.4], [0.02, 0.6]])
    votes = (rng.random((300, 4)) < rates[:, y.astype(int)].T).astype(int)
    copied = np.column_stack([votes, votes[:, :1], votes[:, :1]])
    for v in (votes, copied):
        assert toxicity.label_model(v, labels).tolist() == pytest.approx(plain_label_model(v.tolist(), labels.tolist(), 8), abs=1e-9)
    plain, with_copies = toxicity.label_model(votes, labels), toxicity.label_model(copied, labels)
    assert np.abs(plain - with_copies).max() < 0.02
    assert ((plain > 0.5) == y).mean() > 0.93 > ((labels == 1) == y).mean()
    # a row that stands several times is several rows
    weight = rng.integers(1, 4, 300)
    assert toxicity.label_model(votes, labels, weight).tolist() == pytest.approx(toxicity.label_model(np.repeat(votes, weight, 0), np.repeat(labels, weight))[np.cumsum(weight) - 1].tolist())


def test_scores_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "river idiot " * 40_000 + "scum!! " + "x" * 1_200_000 + " moron" + " window" * 100_000
    model = toxicity.Model(np.sort(toxicity._features([b"idiot", b"scum", b"moron", b"window", b"vermin"])[0][:5]), np.empty(0), 0.0)
    cut = model.votes(["a", text, "idiot"])
    monkeypatch.setattr(toxicity, "pieces", lambda t, gap: [t])
    assert (model.votes(["a", text, "idiot"]) == cut).all() and cut.sum(axis=1).tolist() == [0, 5, 1]


@pytest.mark.parametrize("max_rows", [3, 60, 250])
def test_toxicity_fits_the_rows_of_smallest_hash(spark, max_rows):
    """The cut of the hash range before the last sort changes no row of the fit."""
    docs, labels = made_toxic()
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    smallest = lab.selectExpr("*", "xxhash64(doc_id) AS h").orderBy("h").limit(max_rows).select("doc_id", "toxic")
    cut, plain = toxicity.fit(df, lab, max_rows=max_rows), toxicity.fit(df, smallest)
    assert cut.buckets.tolist() == plain.buckets.tolist() and cut.weights.tolist() == pytest.approx(plain.weights.tolist()) and cut.bias == pytest.approx(plain.bias)


def test_toxicity_hostile_rows(spark):
    docs, labels = made_toxic(60)
    docs += [(None, "idiot"), (1000, None), (1001, ""), (1002, "river " * 300_000), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (0, None), (0, 0), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, lab)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    of = {r.doc_id: r.score for r in got}
    assert of[1000] == of[1001] < 0.7
    one_class = toxicity.fit(df, lab.where("toxic = 1"))
    assert {r.score for r in toxicity.score(df, one_class).collect()} == {1.0}
    none = toxicity.fit(df, lab.limit(0))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.0}
    assert toxicity.score(df.limit(0), none).collect() == []


def brute_language(train, texts):
    """The prediction by plain dictionaries of n-grams, without hashing."""
    from collections import Counter
    from math import log

    def grams(t):
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        while "  " in s:
            s = s.replace("  ", " ")
        s = s.lstrip(" ")
        return [s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1) if s[i] != " " or s[i + k - 1] != " "]

    counts, rows = {}, Counter()
    for t, lang in train:
        counts.setdefault(lang, Counter()).update(grams(t))
        rows[lang] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    size = language_id.BUCKETS
    prior = {x: log((rows[x] + 1) / (sum(rows.values()) + len(rows))) for x in rows}
    out = []
    for t in texts:
        if not t or not any(c.isalpha() for c in t):
            out.append("und")
            continue
        g = grams(t)
        out.append(max(sorted(rows), key=lambda x: prior[x] + sum(log(counts[x][y] + 0.5) - log(total[x] + 0.5 * size) for y in g)))
    return out


def test_language_equals_brute_force_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    train = [(r.text, r.lang) for r in docs if not held(r) and r.text is not None and r.lang is not None]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    chosen = spark.createDataFrame([r for r in docs if not held(r)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, language_id.fit(chosen)).collect()}
    want = dict(zip([r.doc_id for r in docs], brute_language(train, [r.text for r in docs]), strict=True))
    same = sum(got[i] == want[i] for i in want)
    assert same >= 0.99 * len(want)
    known = [r for r in docs if held(r) and r.lang is not None and got[r.doc_id] != "und"]
    assert sum(got[r.doc_id] == r.lang for r in known) >= 0.95 * len(known)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "text string, lang string")
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_id.fit(df)


def test_language_hostile_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "el gato y el perro", "es"), (2, "el gato y el perro", "es"), (3, None, "en"), (4, "", "es"), (5, "12 !? 34", None), (None, "the dog", None), (6, "the cat " * 200_000, None), (7, "\U00030000\U00030001", None), (8, "\0a\0", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS _id", "3 AS lang_pred")
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in language_id.predict(df, language_id.fit(df)).collect())
    of = {i: lang for i, lang, _ in got}
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    assert (of[0], of[1], of[2], of[3], of[4], of[5], of[6]) == ("en", "en", "es", "und", "und", "und", "en")
    assert of[7] in ("en", "es") and of[8] in ("en", "es")
    unlearnt = language_id.predict(df, language_id.fit(df.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in unlearnt} == {("und", 0.0)}
    assert language_id.predict(df.limit(0), language_id.fit(df)).collect() == []
