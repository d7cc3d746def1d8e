"""The ten registered queries on the given tables at sf0.001, whole, against brute force, the library or SQL."""

import hashlib
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from test_dedup import brute_spans, components_by_brute_force
from test_scoring import brute_nearest
from test_tables import WORD, brute_verdict
from tokenizers import Tokenizer

from entityframe.llm import media_ogg, mixing, queries

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import connection, difference  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG, INT, TEXT, REAL, FLAG = "bigint", "int", "string", "double", "boolean"
COLUMNS = {
    "op1_ann_search": {"query_id": LONG, "rank": INT, "vec_id": LONG, "score": REAL},
    "op2_source_mix": {"doc_id": LONG, "size": LONG, "source_size": LONG, "target": REAL, "taken": LONG},
    "op3_ogg_media": {"doc_id": LONG, "n_bytes": LONG, "payload_bytes": LONG, "payload_sha256": TEXT, "tail_crc32": LONG, "media_bytes": LONG, "media_sha256": TEXT, "feature": TEXT},
    "op4_suffix_dedup": {"doc_id": LONG, "n_bytes": LONG, "n_removed": LONG, "n_spans": LONG, "kept_sha256": TEXT},
    "op5_toxicity": {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": INT},
    "op6_url_filter": {"page_id": LONG, "host": TEXT, "path": TEXT, "rule": TEXT, "verdict": TEXT},
    "op7_ngram_join": {"doc_id": LONG, "n_shingles": LONG, "component_id": LONG},
    "op8_token_store": {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG},
    "op9_bpe": {"doc_id": LONG, "n_tokens": LONG, "ids_sha256": TEXT, "decoded_sha256": TEXT},
    "op10_language_id": {"doc_id": LONG, "held_out": FLAG, "lang_pred": TEXT, "score": REAL},
}


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark, docs):
    def one(name):
        df = queries.queries()[name](spark, SF)
        assert dict(df.dtypes) == COLUMNS[name]
        rows = df.collect()
        if "doc_id" in COLUMNS[name]:
            assert sorted(r.doc_id for r in rows) == sorted(docs)
        return rows

    return one


def test_every_operator_is_registered():
    assert set(queries.queries()) == set(COLUMNS) and set(queries.oracle_sql()) <= set(COLUMNS)


def test_op1(spark, run):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {(r.query_id, r["rank"]): (r.vec_id, pytest.approx(r.score)) for r in run("op1_ann_search")}
    assert brute_nearest(rows) == got


def test_op2(docs, run):
    size = {i: len(WORD.findall(r.text or "")) for i, r in docs.items()}
    total = {}
    for i, r in docs.items():
        total[r.source] = total.get(r.source, 0) + size[i]
    goal, taken = mixing.targets(total), dict.fromkeys(total, 0)
    for r in run("op2_source_mix"):
        s = docs[r.doc_id].source
        assert (r.size, r.source_size, r.target) == (size[r.doc_id], total[s], pytest.approx(goal[s])) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] + mixing.BLOCK * mixing.SHARDS for s in goal)


def test_op3(docs, run):
    for r in run("op3_ogg_media"):
        payload = media_ogg.padded((docs[r.doc_id].text or "").encode())
        stored = media_ogg.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((docs[r.doc_id].text or "").encode()), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), sha(stored)) and f"seconds={len(payload) / media_ogg.RATE:.6f}" in r.feature


def test_op4(docs, run):
    order = sorted(docs)
    raw = [(docs[i].text or "").encode() for i in order]
    want = {}
    for i, t, flags in zip(order, raw, brute_spans(raw, 200), strict=True):
        runs = int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())
        want[i] = (len(t), int(flags.sum()), runs, sha(bytes(np.frombuffer(t, np.uint8)[~flags])))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run("op4_suffix_dedup")} == want
    assert sum(w[1] for w in want.values()) > 0


def test_op5(spark, docs, run):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in run("op5_toxicity")}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    clean = [i for i, y in toxic.items() if got[i].held_out and not y]
    assert sum(got[i].predicted for i in clean) <= 0.05 * len(clean)
    assert all(a.score == b.score for a in got.values() for b in got.values() if docs[a.doc_id].text == docs[b.doc_id].text)


def test_op6(spark, run):
    assert difference(queries.queries()["op6_url_filter"](spark, SF), connection(SF), queries.oracle_sql()["op6_url_filter"]) == ""
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in run("op6_url_filter")} == {i: brute_verdict(u, queries.URL_RULES) for i, u in urls.items()}


def test_op7(docs, run):
    sets, least = components_by_brute_force([(i, r.text) for i, r in docs.items()], 4, 85, re.compile(r"[^\x20\x09-\x0D]+").findall)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run("op7_ngram_join")} == {i: (len(sets[i]), least[i]) for i in docs}


def test_op8_and_op9(docs, run):
    library = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: library.encode(r.text or "", add_special_tokens=False).ids for i, r in docs.items()}
    raw = {i: np.array(x, "<u4").tobytes() for i, x in ids.items()}
    at = 0
    for r in sorted(run("op8_token_store"), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]) + 1, zlib.crc32(raw[r.doc_id] + b"\0\0\0\0"))
        at += r.n_tokens
    for r in run("op9_bpe"):
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), sha(raw[r.doc_id]), sha(library.decode(ids[r.doc_id], skip_special_tokens=False).encode()))


def test_op10(docs, run):
    got = run("op10_language_id")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    judged = [(docs[r.doc_id].lang, r.lang_pred) for r in got if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged) > 0
