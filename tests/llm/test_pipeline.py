"""The corpus pipeline on a small corpus: every stage against brute force over its own input."""

import hashlib

import numpy as np
import pytest
from test_dedup import brute_spans
from tokenizers import Tokenizer

import corpus_pipeline
from entityframe.llm import common, mixing, toxicity
from entityframe.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    calm, rude = [f"calm{i}" for i in range(300)], ["zlorp", "grimbag", "snivelwit"]
    words = lambda n: [calm[j] for j in rng.integers(0, 300, n)]
    passage, docs, labels = words(60), [], []
    for i in range(240):
        w = words(int(rng.integers(8, 80)))
        if i % 6 == 0:
            w[2:6] = [rude[j] for j in rng.integers(0, 3, 4)]
        if i % 10 == 1:
            w[5:5] = passage
        docs.append((i, " ".join(w), "en", ["a", "b", None][i % 3], len(" ".join(w))))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 1, int(i % 6 == 0)))
    for k in range(30):  # exact copies and copies with one word put on
        docs.append((300 + k, docs[7][1] if k % 2 else docs[8][1] + " tail", "en", "a", None))
    return [*docs, (400, None, None, None, None), (401, "", "en", "b", 0), (402, " \t", None, "a", 2)], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def near_groups(texts, k=5, percent=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    least = {i: i for i in sets}
    for _ in sets:
        before = dict(least)
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    least[i] = min(least[i], least[j])
        if least == before:
            return least
    return least


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert docs.columns == COLUMNS and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "bpe"]
    inputs, frames = [], []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs.collect())
        frames.append(docs)
        docs = common.stored(stage(spark, docs, folder), f"test-{name}")
        if name != "bpe":
            assert docs.columns == COLUMNS
    result = docs.collect()

    # toxicity: what scores 0.7 or more goes, clean documents stay
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(common.crc32_of("doc_id") % 3 != 1)
    score = {r.doc_id: r.score for r in toxicity.score(frames[0], toxicity.fit(frames[0], labels)).collect()}
    assert {r.doc_id for r in inputs[1]} == {i for i, s in score.items() if s < 0.7}
    assert {i for i, s in score.items() if s >= 0.7} == {i for i in score if i < 240 and i % 6 == 0}

    # near copies: one of each group
    group = near_groups({r.doc_id: r.text for r in inputs[1]})
    assert sorted(r.doc_id for r in inputs[2]) == sorted(set(group.values())) and len(inputs[2]) < len(inputs[1])

    # repeats: the text without them, other columns as they were
    order = sorted(inputs[2], key=lambda r: r.doc_id)
    raw = [(r.text or "").encode() for r in order]
    cut = {r.doc_id: r for r in inputs[3]}
    assert len(cut) == len(order) and sum(len(t) for t in raw) > sum(len(r.text or "") for r in inputs[3])
    for r, t, flags in zip(order, raw, brute_spans(raw, 200), strict=True):
        assert (cut[r.doc_id].text or "").encode() == bytes(np.frombuffer(t, np.uint8)[~flags])
        assert (cut[r.doc_id].text is None) == (r.text is None) and cut[r.doc_id][2:4] == r[2:4]
        assert cut[r.doc_id].n_chars == (r.n_chars if r.text is None else len(cut[r.doc_id].text))

    # mixing: each document as often as the mix takes it; what rounding leaves is carried along its source
    taken = {r._id: (r._taken, r._size) for r in mixing.mix(frames[3]).collect()}
    source = {r.doc_id: r.source for r in inputs[3]}
    times = {i: 0 for i in taken}
    for r in inputs[4]:
        times[r.doc_id] += 1
        assert r.text == cut[r.doc_id].text
    share = {i: t / n if n else 0 for i, (t, n) in taken.items()}
    assert all(abs(times[i] - share[i]) < 1 and (share[i] or not times[i]) for i in times)
    for s in set(source.values()):
        assert abs(sum(times[i] - share[i] for i in times if source[i] == s)) <= 0.5 + 1e-6

    # token ids of the library, and the text back
    library = Tokenizer.from_file(tokenizer_path())
    assert len(result) == len(inputs[4])
    for r in result:
        ids = library.encode(cut[r.doc_id].text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(cut[r.doc_id].text.encode()).hexdigest()

    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, result))


def test_empty_tables(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs[:1], "doc_id long, text string, lang string, source string, n_chars long").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels[:1], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
