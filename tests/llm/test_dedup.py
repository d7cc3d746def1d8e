"""Suffix dedup and the n-gram join against brute force."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from entityframe.llm import common, ngram_join, suffix_dedup


def brute_spans(texts, length):
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                flags[i : i + length] = True
        out.append(flags)
    return out


def random_texts(seed, length):
    rng = np.random.default_rng(seed)
    make = lambda n, k: rng.integers(97, 97 + k, n).astype(np.uint8).tobytes()
    base = [make(int(rng.integers(1, 6 * length)), int(rng.integers(1, 26))) for _ in range(12)]
    texts = list(base)
    for _ in range(40):
        b = base[rng.integers(0, 12)]
        cut = sorted(rng.integers(0, len(b) + 1, 2).tolist())
        texts.append(make(int(rng.integers(0, 80)), 26) + b[cut[0] : cut[1]] + make(int(rng.integers(0, 80)), 26))
    return [t.decode() for t in [*texts, base[0], b"", b"a" * 5 * length]]


@pytest.mark.parametrize(("seed", "length", "hot"), [(0, 200, 20_000), (1, 60, 20_000), (2, 60, 1), (3, 37, 20_000)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 3000)
    texts = [*random_texts(seed, length), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS _key", "2 AS _spans")
    got = {r.doc_id: r for r in suffix_dedup.digests(df, length).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (t, flags) in enumerate(zip(raw, brute_spans(raw, length), strict=True)):
        r = got[i]
        kept = bytes(np.frombuffer(t, np.uint8)[~flags])
        runs = int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(flags.sum()), runs, hashlib.sha256(kept).hexdigest()), i


def test_long_text_in_pieces_equals_brute_force(spark):
    """A text of many pieces repeats itself across their borders and holds a passage of another text."""
    rng = np.random.default_rng(6)
    text = rng.integers(97, 123, 3_000_000).astype(np.uint8).tobytes()
    size = suffix_dedup.STEP_BYTES
    at = [100, size - 150, 2 * size - 60, 2_900_000]
    passage = rng.integers(65, 91, 300).astype(np.uint8).tobytes()
    for i, a in enumerate(at):  # unlike bytes beside each, so that no match is longer
        text = text[: a - 1] + b"%d" % i + passage + b"%d" % (i + 4) + text[a + 301 :]
    other = b"z" * 50 + passage[:250]
    df = spark.createDataFrame([(1, text.decode()), (2, other.decode())], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.digests(df).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[2].n_spans) == (1200, 4, 250, 1)
    kept = text
    for a in reversed(at):
        kept = kept[:a] + kept[a + 300 :]
    assert got[1].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_places_beyond_24_bits_are_refused_and_never_wrap():
    with pytest.raises(ValueError):
        suffix_dedup.places(np.zeros((1 << 24) + 1, np.uint64), 128)
    grams = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    got = suffix_dedup.places(grams, 100)
    assert got.tolist() == [i + int(np.argmin(grams[i : i + 100] >> np.uint64(24))) for i in range(len(grams) - 99)]


def thue_morse(n):
    t = np.zeros(1, np.uint8)
    while len(t) < n:
        t = np.concatenate([t, 1 - t])
    return t


def test_words_built_to_collide_modulo_a_power_of_two_differ(spark):
    t = thue_morse(1024)
    words = [(t + 97).tobytes().decode(), (98 - t).tobytes().decode()]
    df = spark.createDataFrame([(11, words[0]), (12, words[1])], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.components(df).collect()) == [(11, 11), (12, 12)]
    assert [r.n_removed for r in suffix_dedup.digests(df, 1000).collect()] == [0, 0]


def test_spans_of_every_length_hash_their_bytes_alone():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    roll = common.Rolling(data)
    start, end = np.divmod(np.arange(400 * 40), 40)
    end = np.minimum(start + end, 400)
    seen = {}
    for s, e, h in zip(start.tolist(), end.tolist(), roll.spans(start, end).tolist(), strict=True):
        assert seen.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_merge_gives_the_common_prefixes():
    strings = [[3, 1, 2, 1, 2], [1, 2, 1], [2, 1, 2, 3]]
    tables = [suffix_dedup.transform(np.array(s), np.array([*range(1, len(s)), -1]))[0] for s in strings]
    interleave, common = suffix_dedup.merge(tables, 3)
    suffixes = sorted([(tuple(s[i:]), k) for k, s in enumerate(strings) for i in range(len(s) + 1)])
    assert interleave.tolist()[3:] == [k for _, k in suffixes[3:]] or sorted(interleave.tolist()) == sorted(k for _, k in suffixes)
    want = [0]
    for (a, _), (b, _) in zip(suffixes, suffixes[1:], strict=False):
        n = 0
        while n < min(len(a), len(b), 3) and a[n] == b[n]:
            n += 1
        want.append(n)
    assert common.tolist() == want


def bucket(seed=4, pairs=2000):
    """A full bucket: pairs of strings that share 210 bytes between ends of their own."""
    rng = np.random.default_rng(seed)
    make = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    shared = [make(210) for _ in range(pairs)]
    strings = [make(int(rng.integers(1, 80))) + s for s in shared] + [s + make(int(rng.integers(1, 80))) for s in shared]
    return np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), np.ones(len(strings), np.int64)


def test_merge_of_a_bucket_takes_little_memory():
    """Two workers beside a JVM: the arrays of a merge are bounded by its bytes."""
    data, sizes, counts = bucket()
    tracemalloc.start()
    found = suffix_dedup.repeated_starts(data, sizes, counts, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.sum() == 4000 * 11
    assert peak < 75 * len(data)


def test_merge_of_a_bucket_sorts_no_indices(monkeypatch):
    """Indirect sorts were more than half of a merge's time: codes and places are sorted as single numbers."""
    data, sizes, counts = bucket(5, 300)
    want = suffix_dedup.repeated_starts(data, sizes, counts, 200)
    for name in ("argsort", "unique", "lexsort"):
        monkeypatch.setattr(np, name, lambda *a, **b: pytest.fail("an indirect sort"))
    assert (suffix_dedup.repeated_starts(data, sizes, counts, 200) == want).all() and want.sum() == 600 * 11


def test_packed_sorts_equal_plain_ones():
    rng = np.random.default_rng(3)
    for code, top in ((rng.integers(0, 50, 1000), 49), (rng.integers(0, 1 << 60, 1000) // (1 << 55), (1 << 60)), (np.zeros(0, np.int64), 0)):
        value, order = suffix_dedup.in_order(code, top)
        assert order.tolist() == np.argsort(code, kind="stable").tolist() and value.tolist() == sorted(code.tolist())
    far = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    near = np.uint64(1 << 62) + np.tile(np.arange(3, dtype=np.uint64), 100)  # values that differ in their low bits alone, mixed
    for h in (np.tile(far, 3), near, np.concatenate([far, near])):
        order, new = suffix_dedup.numbered(h)
        assert sorted(order.tolist()) == list(range(len(h)))
        runs = np.split(h[order], np.flatnonzero(new)[1:])
        assert all(len(set(r.tolist())) == 1 for r in runs) and len(runs) == len(set(h.tolist()))


def test_groups_stay_whole_and_buckets_small():
    """Buckets close before a group that doesn't fit, wherever the batches are cut; a larger group is alone."""
    rng = np.random.default_rng(8)
    size = rng.integers(1, 9, 60)
    size[20] = 50
    key = np.repeat(np.arange(60) * 7 - 100, size)
    rows = pa.table({"_key": key, "_content": np.arange(len(key)), "_count": np.ones(len(key), np.int64), "_string": [b"x" * 10] * len(key)})
    for cut in (1, 3, 17, 1000):
        empty = rows.slice(0, 0).to_batches() or [pa.RecordBatch.from_pylist([], rows.schema)]
        got = list(suffix_dedup.groups(iter([*empty, *rows.to_batches(cut), *empty]), 200))
        assert pa.concat_tables(got).combine_chunks() == rows.combine_chunks()
        keys = [set(t["_key"].to_pylist()) for t in got]
        assert sum(map(len, keys)) == 60
        assert all(len(t) <= 20 or len(k) == 1 for t, k in zip(got, keys, strict=True))
        data, sizes = suffix_dedup.joined(got[1].column(3))
        assert len(data) == 10 * len(got[1]) and set(sizes.tolist()) == {10}
    assert list(suffix_dedup.groups(iter([]), 200)) == []


def test_suffix_apply_and_empty(spark):
    text = "é" * 150 + "x" * 10
    df = spark.createDataFrame([(1, text, "k"), (2, text, "k"), (3, None, None), (4, "short", "k")], "doc_id long, text string, _bytes2 string")
    got = {r.doc_id: r for r in suffix_dedup.apply(df).collect()}
    assert (got[1].text, got[3].text, got[4].text) == ("", None, "short") and got[4]._bytes2 == "k"
    assert suffix_dedup.digests(df.limit(0)).collect() == []


def near_copies(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(200)]
    base = [[words[j] for j in rng.integers(0, 200, int(rng.integers(5, 120)))] for _ in range(5)]
    docs = []
    for i in range(250):
        w = list(base[rng.integers(0, 5)])
        for _ in range(int(rng.integers(0, 6))):
            k = int(rng.integers(0, len(w)))
            w[k : k + int(rng.integers(0, 2))] = [f"u{rng.integers(0, 60)}"]
        docs.append((i, " ".join(w)))
    return [*docs, (600, ""), (601, None), (602, "a"), (603, "A"), (604, " \t "), (605, docs[0][1])]


def components_by_brute_force(docs, k, percent, words=str.split):
    """(set of each document, least id that links reach)."""
    sets = {}
    for i, t in docs:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u, v = find(i), find(j)
                least[max(u, v)] = min(u, v)
    return sets, {i: find(i) for i in sets}


@pytest.mark.parametrize(("seed", "k", "percent"), [(0, 4, 85), (1, 5, 80), (2, 2, 60)])
def test_components_equal_brute_force(spark, seed, k, percent):
    docs = near_copies(seed)
    sets, least = components_by_brute_force(docs, k, percent)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS _t", "2 AS component_id").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, k, percent).collect()}
    assert got == {i: (len(sets[i]), least[i]) for i in sets}


def test_members_dealt_anew_lose_no_link(spark, monkeypatch):
    """Documents that share a passage, and pairs of near copies among them: no rounds of one-member meetings, tiny tables."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for i in range(60):
        own = [f"o{i // 2}_{j}" for j in range(int(rng.integers(5, 60)))]
        docs.append((i, " ".join(passage + (docs and i % 2 and docs[-1][1].split()[40:] or own) + ([f"x{i}"] if i % 2 else []))))
    sets, least = components_by_brute_force(docs, 3, 80)
    assert 20 < len(set(least.values())) < 60
    got = {r.doc_id: r.component_id for r in ngram_join.components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 80).collect()}
    assert got == least


def test_join_of_empty_and_unlinked(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.components(df).collect()) == [(1, 1), (2, 2)]
    assert ngram_join.components(df.limit(0)).collect() == []


def test_row_without_id_links_two_others(spark):
    """The texts 1 and 2 link only by way of rows that have no id."""
    words = [f"w{i}" for i in range(30)]
    rows = [(1, words[0:10]), (None, words[2:12]), (None, words[2:12]), (2, words[4:14]), (None, words[20:30])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.components(df, 1, 60).collect())
    assert got == [(0, 0), (0, 1), (0, 1), (1, 1), (2, 1)]


def test_repeated_rows_cost_no_more_than_one(spark):
    """Two linked texts in 500 equal rows each, rows without id among them: the joins see one set of each class."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59)) + " x"
    rows = [(5, a)] * 500 + [(7, b)] * 250 + [(None, b)] * 250
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.components(df).collect()
    assert len(got) == 1000 and {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(5, 56, 5), (7, 56, 5), (None, 56, 5)}
    assert [r.doc_id for r in ngram_join.deduplicate(df).collect()] == [5]


def test_deduplicate_keeps_one_row_of_each_component(spark):
    """One id with two texts, rows without id, texts without words, other columns that differ or clash."""
    words = [f"w{i}" for i in range(40)]
    t = [" ".join(words), " ".join(words[:39]), "other text of six plain words"]
    rows = [(1, t[0], "a"), (1, t[2], "b"), (2, t[1], "c"), (None, t[2], "d"), (None, "no id but seven words in it", "e"), (None, "no id but seven words in it", "f"), (3, None, "g"), (3, " \t", "h"), (3, "", "i"), (4, t[0], "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ra string")
    got = ngram_join.deduplicate(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, t[0]), (1, t[2]), (None, "no id but seven words in it"), (3, None), (3, " \t"), (3, "")]))


def test_very_long_text_links(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 400_000)]
    changed = [w if i % 1000 else "changed" for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:200_000]))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.components(df).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_gap_code_round_trip():
    for cells in (np.array([0, 0, 254, 255, 510, 65535]), np.sort(np.random.default_rng(0).integers(0, 65536, 3000))):
        assert ngram_join.cells_of(ngram_join.gaps_of(cells)).tolist() == cells.tolist()
