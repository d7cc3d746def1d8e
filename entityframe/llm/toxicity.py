"""Toxicity by weak supervision.

Voters are lexicon entries (a hand-written list; whole words and word beginnings of four to six bytes, found
by their association with labelled rows) and text patterns. A generative label model
estimates, in turns, each row's class, each voter's rates of firing in either class, and the
correlations of voters within a class (voters that fire together share their evidence). The
given label is one more voter. The posteriors are the targets of a linear classifier over
the votes, which scores every text.

Fitting takes at most ``max_rows`` labelled rows, those of smallest id hash; scoring takes
all rows, whole texts. Defined results: null and empty texts get the classifier's score of
no vote; very long texts are scored whole, in pieces; repeated rows get equal scores;
without labelled rows of both classes every score is the share of label 1 (0 if there is
none); several labels of one id count as toxic if one does; null labels are ignored; an
empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, pieces, release, slices, text_batches

BITS, SLICE = 21, 1 << 16
MAX_ROWS, VOTERS = 40_000, 256
#: Correlation within a class from which voters share their evidence: a word and its beginning, not words that one text happens to hold.
CORRELATED = 0.8
_STOP = np.ones(256, bool)
_STOP[[*range(97, 123), *range(128, 256)]] = False
_NO_LETTER = re.compile(rb"[^a-z\x80-\xff]")
#: A hand-written lexicon of common insults in four languages, voters from the start.
LEXICON = (
    "idiot", "moron", "stupid", "dumb", "fool", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting", "imbecile", "jerk", "filth", "vermin", "idiots", "morons", "losers", "bastard", "creep", "garbage",
    "dummkopf", "trottel", "blödmann", "arschloch", "abschaum", "versager", "widerlich", "schwachkopf",
    "imbécil", "estúpido", "basura", "escoria", "asqueroso", "inútil", "payaso", "cabrón",
    "crétin", "stupide", "ordure", "minable", "connard", "abruti", "salaud", "débile",
)
PATTERNS = (re.compile(r"!{2,}"), re.compile(r"\b[A-Z]{4,}\b(?:\W+\b[A-Z]{4,}\b)+"), re.compile(r"[A-Za-z][*@#$]{1,4}[a-z]"))


def features(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, buckets, text of each from there) of runs of texts: words, then their beginnings."""
    lowered = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    for first, whole in slices(lowered):
        if len(whole) > 1:
            yield first, *_features(whole)
        else:
            found = np.unique(np.concatenate([np.unique(_features([p])[0]) for p in pieces(whole[0], _NO_LETTER)]))
            yield first, found, np.zeros(len(found), np.int64)


def _features(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(run) + b" ", np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~_STOP[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in run]), start, side="right")
    roll = Rolling(data)
    spans = [(roll.spans(start, end), owner)]
    for k in (4, 5, 6):
        long = end - start > k
        spans.append((roll.spans(start[long], start[long] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)), owner[long]))
    return (np.concatenate([h for h, _ in spans]) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([o for _, o in spans])


def pattern_votes(text: str) -> list[bool]:
    return [bool(p.search(text)) for p in PATTERNS]


@dataclass
class Model:
    buckets: np.ndarray  # of the lexicon voters
    weights: np.ndarray  # of lexicon voters, patterns, any-vote; empty: constant score
    bias: float

    def votes(self, texts: list[str]) -> np.ndarray:
        """Texts x (voters + patterns), whether each fires."""
        k = len(self.buckets)
        out = np.zeros((len(texts), k + len(PATTERNS)), np.float32)
        place = np.full(1 << BITS, -1, np.int16)
        place[self.buckets] = np.arange(k)
        for first, bucket, owner in features(texts):
            v = place[bucket]
            on = v >= 0
            out[first + owner[on], v[on]] = 1
        for i, t in enumerate(texts):
            out[i, k:] = pattern_votes(t)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.bias)
        v = self.votes(texts)
        z = design(v, len(self.buckets)) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def design(votes: np.ndarray, k: int) -> np.ndarray:
    lexicon = votes[:, :k].sum(axis=1)
    return np.column_stack([votes, lexicon > 0, np.log1p(lexicon)]).astype(np.float32)


def label_model(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None, rounds: int = 8) -> np.ndarray:
    """Posterior of class 1 of each row, which stands ``weight`` times: EM over the voters' firing rates and correlations.

    The given label is one more voter, whose error rate is estimated with the others'. In
    each round, voters that correlate within a class above ``CORRELATED`` share their evidence: each
    one's is divided by their number.
    """
    weight = np.ones(len(votes)) if weight is None else weight
    votes, label = votes.astype(np.float64), labels.astype(np.float64)
    q = np.where(label == 1, 0.95, 0.05)
    for _ in range(rounds):
        rates, near = [], np.zeros((votes.shape[1],) * 2, bool)
        for part in (weight * q, weight * (1 - q)):
            n = part.sum()
            p = (part @ votes + 0.5) / (n + 1)
            rates.append((n, p, (part @ label + 1) / (n + 2)))
            cov = (votes.T * part) @ votes - np.outer(p, part @ votes) - np.outer(part @ votes, p) + n * np.outer(p, p)
            dev = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
            near |= cov / dev[:, None] / dev > CORRELATED
        np.fill_diagonal(near, True)
        share = 1 / near.sum(axis=1)
        (n1, p1, l1), (n0, p0, l0) = rates
        fire = np.log(p1) - np.log(p0)
        quiet = np.log1p(-p1) - np.log1p(-p0)
        z = np.log(n1) - np.log(n0) + votes @ ((fire - quiet) * share) + (quiet * share).sum()
        z += np.where(label == 1, np.log(l1) - np.log(l0), np.log1p(-l1) - np.log1p(-l0))
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q


def linear_fit(x: np.ndarray, q: np.ndarray, weight: np.ndarray, rounds: int = 400, penalty: float = 2e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Nesterov's gradient steps; x: rows x features, each row ``weight`` times."""
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    weight = weight / weight.sum()
    step = 4 / (1 + float(weight @ (x.astype(np.float64) ** 2).sum(axis=1)) * 2)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30)))
        g = (p - q) * weight
        nw, nb = vw - step * (x.T @ g + penalty * vw), vb - step * float(g.sum())
        m = r / (r + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, voters: int = VOTERS) -> Model:
    """The model of at most ``max_rows`` labelled rows. Their ids (16 bytes each) are broadcast, their votes reach the driver."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    labelled = chosen.count()
    if labelled > 2 * max_rows:  # only the low end of the hash range can be among the smallest: few rows meet in the last sort
        low = chosen.where(F.xxhash64("_id") < F.lit(int(1.5 * max_rows / labelled * 2**64) - 2**63))
        chosen = low if low.count() >= max_rows else chosen
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        n = np.zeros(2, np.int64)
        for b, raw in text_batches(batches, "_text"):
            texts, y = [t.decode() for t in raw], b.column(1).to_numpy()
            n += np.bincount(y, minlength=2)[:2]
            for first, bucket, owner in features(texts):
                distinct = np.unique(owner << BITS | bucket)
                cls = y[first + (distinct >> BITS)]
                for c in (0, 1):
                    sums[c] += np.bincount(distinct[cls == c] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
        if n.sum():
            for k in range((1 << BITS) // SLICE):
                at = slice(k * SLICE, (k + 1) * SLICE)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums[:, at].tobytes()], pa.binary()), pa.array([int(n[0])], pa.int64()), pa.array([int(n[1])], pa.int64())], names=["slice", "counts", "n0", "n1"])

    def rank(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n0, n1 = np.zeros((2, SLICE), np.int64), 0, 0
        for b in batches:
            for raw in b.column(1):
                total += np.frombuffer(raw.as_py(), np.int32).reshape(2, SLICE)
            n0, n1 = n0 + sum(b.column(2).to_pylist()), n1 + sum(b.column(3).to_pylist())
        neg, pos = total.astype(np.float64)
        odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
        merit = np.where((pos >= 2) & (odds > 2), pos * odds, 0)
        top = np.argsort(-merit, kind="stable")[:voters]
        top = top[merit[top] > 0]
        k = key[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array(k * SLICE + top, pa.int64()), pa.array(merit[top], pa.float64()), pa.array([n0] * len(top), pa.int64()), pa.array([n1] * len(top), pa.int64())], names=["bucket", "merit", "n0", "n1"])

    counted = rows.mapInArrow(count, "slice int, counts binary, n0 long, n1 long").groupBy("slice").applyInArrow(rank, "bucket long, merit double, n0 long, n1 long")
    found = counted.orderBy(F.desc("merit"), "bucket").limit(voters).collect()
    words = _features([w.encode() for w in LEXICON])[0][: len(LEXICON)]
    model = Model(np.array(sorted({r["bucket"] for r in found} | set(words.tolist())), np.int64), np.empty(0), 0.0)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in text_batches(batches, "_text"):
            packed = np.packbits(model.votes([t.decode() for t in raw]).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(map(bytes, packed)), pa.binary())], names=["y", "votes"])

    got = rows.mapInArrow(vote, "y int, votes binary").toArrow()
    y = np.array(got.column("y").to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        model.bias = float(y.mean()) if len(y) else 0.0
        return model
    k = len(model.buckets) + len(PATTERNS)
    # equal rows count as one, in one order: no sum depends on the order in which rows arrive
    packed = np.frombuffer(b"".join(got.column("votes").to_pylist()), np.uint8).reshape(len(y), -1)
    distinct, weight = np.unique(np.column_stack([y.astype(np.uint8), packed]), axis=0, return_counts=True)
    votes = np.unpackbits(np.ascontiguousarray(distinct[:, 1:]), axis=1, count=k).astype(np.float32)
    posterior = label_model(votes, distinct[:, 0], weight)
    model.weights, model.bias = linear_fit(design(votes, len(model.buckets)), posterior, weight.astype(np.float64))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` reduced to (id, score) of every row. The model is a few kilobytes."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in text_batches(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(model.scores([t.decode() for t in raw]), 6), pa.float64())], names=["_id", "score"])
        release()

    return src.mapInArrow(step, f"_id {src.schema['_id'].dataType.simpleString()}, score double").withColumnRenamed("_id", id_col)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all their columns unchanged."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in text_batches(batches, text_col):
            yield b.filter(pa.array(np.round(model.scores([t.decode() for t in raw]), 6) < threshold))
        release()

    return docs.mapInArrow(step, docs.schema)
