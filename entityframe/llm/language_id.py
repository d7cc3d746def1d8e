"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of every training row are summed by language and slice of the hash range; the
matrix of log probabilities (languages x buckets, float32) is broadcast with the scoring
function; rows are scored in numpy batches.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every
text if no training row has a language; repeated rows count as often as they occur; very
long texts are scored whole; ties go to the first language by name; an empty table gives an
empty one; other columns don't matter. More than ``MAX_LANGUAGES`` languages are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

BUCKETS, SLICE, ORDERS = 1 << 16, 4096, (1, 2, 3)
#: n-grams whose evidence counts in full; more are weighed down, so that scores stay below certainty.
EVIDENCE = 40.0
#: Languages that a model may have: they bound what is collected and broadcast (256 KB each as float32).
MAX_LANGUAGES = 500
_letters: list[np.ndarray] = []
_codes: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
        _codes.append(mix(np.arange(0x110000, dtype=np.uint64), 3))
    return _letters[0], _codes[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams, text of each, letters in each text). Runs of non-letters count as one space."""
    letters, codes = _tables()
    points = np.frombuffer("\0".join(t.lower() for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t.lower()) + 1 for t in texts])[: len(points)]
    is_letter = letters[points]
    n_letters = np.bincount(owner[is_letter], minlength=len(texts))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # a run of other characters leaves its first one
    points, owner, is_letter = points[keep], owner[keep], is_letter[keep]
    code = np.where(is_letter, codes[points], np.uint64(0))
    found, whose = [], []
    h = np.zeros(len(code), np.uint64)
    for k in ORDERS:
        m = len(code) - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9FB21C651E98DF25) + code[k - 1 :]
        same = owner[: m] == owner[k - 1 :]
        same &= is_letter[:m] | is_letter[k - 1 :]
        found.append(((h[same] ^ (h[same] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64))
        whose.append(owner[:m][same])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), n_letters
    return np.concatenate(found), np.concatenate(whose), n_letters


def _runs(texts: list[str | None], size: int = 500_000) -> Iterator[tuple[int, list[str]]]:
    run, first, total = [], 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and total + len(t) > size:
            yield first, run
            run, first, total = [], i, 0
        run.append(t)
        total += len(t)
    if run:
        yield first, run


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities: languages x buckets) of all rows with text and language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, run in _runs(texts):
                bucket, owner, _ = grams(run)
                here = langs[first : first + len(run)]
                names = sorted(set(here))
                index = np.array([names.index(x) for x in here])[owner] if len(owner) else owner
                for k, name in enumerate(names):
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(bucket[index == k], minlength=BUCKETS)
                    rows[name] = rows.get(name, 0) + here.count(name)
        for name, s in sums.items():
            parts = [s[i : i + SLICE].astype("<i8").tobytes() for i in range(0, BUCKETS, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([rows[name]] + [0] * (len(parts) - 1), pa.int64())], names=["lang", "slice", "counts", "n"])

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = np.zeros(SLICE, np.int64), 0
        for b in batches:
            for raw in b.column(2):
                out += np.frombuffer(raw.as_py(), "<i8")
            n += sum(b.column(3).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["lang", "slice", "counts", "n"])

    kinds = "lang string, slice int, counts binary, n long"
    found = docs.select(F.col(lang_col)).where(F.col(lang_col).isNotNull()).distinct().limit(MAX_LANGUAGES + 1).count()
    if found > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model would not fit a broadcast")
    src = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    got = src.mapInArrow(count, kinds).groupBy("lang", "slice").applyInArrow(total, kinds).collect()
    langs = sorted({r["lang"] for r in got})
    counts, rows = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    for r in got:
        k = langs.index(r["lang"])
        counts[k, r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], "<i8")
        rows[k] += r["n"]
    logp = np.log(counts + 0.5) - np.log(counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    return langs, np.log((rows + 1) / (rows.sum() + len(langs))) if langs else rows, logp.astype(np.float32)


def predict_texts(texts: list[str | None], langs: list[str], prior: np.ndarray, logp: np.ndarray) -> tuple[list[str], list[float]]:
    names: list[str] = []
    scores: list[float] = []
    table = np.ascontiguousarray(logp.T)
    for _, run in _runs(texts):
        if not langs:
            names += ["und"] * len(run)
            scores += [0.0] * len(run)
            continue
        bucket, owner, letters = grams(run)
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
        n = np.bincount(owner, minlength=len(run))
        ll = np.zeros((len(run), len(langs)))
        has = np.flatnonzero(n)
        if len(bucket):
            starts = (np.cumsum(n) - n)[has]
            for k in range(len(langs)):
                ll[has, k] = np.add.reduceat(table[bucket, k].astype(np.float64), starts)
        ll = (ll + prior) / (1 + n / EVIDENCE)[:, None]
        p = np.exp(ll - ll.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for i in range(len(run)):
            names.append(langs[best[i]] if letters[i] else "und")
            scores.append(float(p[i, best[i]]) if letters[i] else 0.0)
    return names, scores


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row. The model travels as a broadcast: languages x 256 KB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logp = shared.value
        for b in batches:
            names, scores = predict_texts(b.column(1).to_pylist(), langs, prior, logp)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["_id", "lang_pred", "score"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return src.mapInArrow(step, f"_id {src.schema['_id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("_id", id_col)


