"""BPE and the token store against the tokenizers library."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from entityframe.llm import bpe, token_store
from entityframe.llm.queries import tokenizer_path

PATH = tokenizer_path()
ALPHABET = "ab'st \n\t\r\x1c\x1f\x85\xa0éß²½٣中😀<|endoftext|>.!_-09 ́"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed=1, n=3000):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*made, "", "<|endoftext|>x <|endoftext|>", "a" * 5000, "we're  they'll\n\n  done", "abababab" * 40]


def test_encoders_equal_the_library(library):
    t = texts()
    own, stored = bpe.vocabulary(PATH).encode_texts(t), token_store.library_encoder(PATH).encode_texts(t)
    for text, a, b in zip(t, own, stored, strict=True):
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert a == want and b == want, repr(text)


def test_decode_equals_the_library(library):
    rng = np.random.default_rng(3)
    v = bpe.vocabulary(PATH)
    for _ in range(300):
        ids = rng.integers(0, 50257, 20)
        assert v.decode_ids(ids.astype("<u4").tobytes()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_small_word_table_gives_the_same(library, monkeypatch):
    """A table of few slots: words without a slot and emptied tables change nothing."""
    monkeypatch.setattr(bpe, "SLOTS", 32)
    monkeypatch.setattr(bpe, "PROBES", 3)
    v, t = bpe.Vocabulary(PATH), texts(5, 200)
    for text in t + t:
        assert v.encode_texts([text])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert v.encode_texts(t) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(t, add_special_tokens=False)]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ab", "a", "éü中"])
def test_long_words_equal_the_library(library, letters):
    rng = random.Random(7)
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in (399, 401, 1000, 40_000)]
    for own in (bpe.Vocabulary(PATH), token_store.library_encoder(PATH)):
        for w, raw in zip(words, own.encode_texts(words), strict=True):
            assert raw == np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()


def test_word_of_a_million_letters_ends_soon():
    rng = np.random.default_rng(0)
    word = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)[rng.integers(0, 52, 1_000_000)].tobytes()
    v, began = bpe.vocabulary(PATH), time.process_time()
    ids, counts = v.merge_words([word])
    assert v.decode_run(ids, counts) == [word.decode()] and time.process_time() - began < 60


def test_block_random_access():
    rng = np.random.default_rng(0)
    for ids in ([], [0], [255, 256, 65536, 2**31], rng.integers(0, 70000, 3000), 2 ** rng.integers(0, 32, 3000)):
        b, ids = token_store.Block(token_store.pack(np.array(ids, np.uint32))), np.array(ids).tolist()
        assert len(b) == len(ids) and b.span(0, len(ids)).tolist() == ids and [b[i] for i in range(len(ids))] == ids
        for _ in range(50):
            lo, hi = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert b.span(lo, hi).tolist() == ids[lo:hi]


def test_store_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 50)
    rows = [(7, "one two"), (3, None), (5, ""), (3, "again, id 3"), (9, "long " * 400), (None, "no id"), (11, "very long " * 300_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, block string")
    got = token_store.read(token_store.write(df, PATH)).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 3, 3, 5, 7, 9, 11]
    at, left = 0, [(i, t or "") for i, t in rows]
    for r in got:
        assert r.start == at
        at += r.n_tokens
        crcs = {zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in left if i == r.doc_id}
        assert r.ids_crc32 in crcs
    assert token_store.read(token_store.write(df.limit(0), PATH)).collect() == []


def test_bpe_query_digests(spark, library):
    df = spark.createDataFrame([(1, "a b"), (2, None), (2, "é" * 50)], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS _id")
    got = bpe.digests(bpe.decode(bpe.encode(df, PATH), PATH)).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in got) == sorted((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in [(1, "a b"), (2, None), (2, "é" * 50)])
    assert all(r.n_tokens == len(library.encode(t).ids) for r, t in zip(sorted(got, key=lambda r: (r.doc_id, r.n_tokens)), ["a b", "", "é" * 50], strict=True))
