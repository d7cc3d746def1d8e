"""Maximum-inner-product search with score-aware (anisotropic) product quantisation.

Vectors are cut into two-dimensional subspaces of 16 centres each. The codes minimise a
loss in which the residual parallel to the vector weighs more than the orthogonal one,
since only the parallel part changes the scores of near queries. Codes are packed two to a
byte; a query's table has 256 sums for each byte, and a block of codes is scanned by table
look-ups. The best of each scan are reranked exactly, in double precision. So is every other
row of the block whose approximate score, plus the query's norm times the norm of the row's
residual (stored with its code), reaches the k-th best of these: no other row can be nearer,
so the result is that of brute force, however crowded the vectors are.

The centres are fitted to at most ``SAMPLE`` vectors, those of smallest id hash; every row
is indexed. Defined results: vectors that are null, empty, zero or hold null or non-finite
components, or another number of components than the most frequent one, take no part; ties
go to the smaller id; rows of one id are queries and candidates each, all but the query's own
row; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

SAMPLE, BLOCK, QUERIES = 20_000, 8_192, 512
#: Weight of the parallel residual against the orthogonal one; candidates of a block whose exact scores set the bound for the others.
ETA, SCAN_KEEP = 4.0, 150


def assign(x: np.ndarray, centres: np.ndarray, eta: float = ETA, rounds: int = 3) -> np.ndarray:
    """Codes (rows x subspaces) by coordinate descent on the score-aware loss."""
    n, m, d = len(x), centres.shape[0], centres.shape[2]
    parts = x.reshape(n, m, d)
    norm = np.maximum((x**2).sum(axis=1), 1e-30)
    codes = np.empty((n, m), np.uint8)
    dist = np.empty((n, m, 16), np.float32)  # orthogonal part: plain squared residuals
    along = np.empty((n, m, 16), np.float32)  # <x, r> of each choice
    for j in range(m):
        r = parts[:, j, None, :] - centres[None, j]
        dist[:, j] = (r**2).sum(axis=2)
        along[:, j] = (r * parts[:, j, None, :]).sum(axis=2)
        codes[:, j] = dist[:, j].argmin(axis=1)
    rows = np.arange(n)
    total = sum(along[rows, j, codes[:, j]] for j in range(m))
    for _ in range(rounds):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            loss = dist[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2 / norm[:, None]
            codes[:, j] = loss.argmin(axis=1)
            total = rest + along[rows, j, codes[:, j]]
    return codes


def fit(sample: np.ndarray, rounds: int = 8, eta: float = ETA, seed: int = 5) -> np.ndarray:
    """Centres (subspaces x 16 x 2), by alternating score-aware codes and weighted least squares."""
    x = sample.astype(np.float32)
    n, dim = x.shape
    m = dim // 2
    parts = x.reshape(n, m, 2)
    rng = np.random.default_rng(seed)
    centres = np.stack([parts[rng.choice(n, 16, replace=n < 16), j] for j in range(m)])
    norm = np.maximum((x**2).sum(axis=1), 1e-30)
    for r in range(rounds):
        codes = assign(x, centres, eta if r >= rounds // 2 else 1.0, 1)
        rows = np.arange(n)
        recon = centres[np.arange(m)[None], codes]
        along = ((parts - recon) * parts).sum(axis=2)
        total = along.sum(axis=1)
        for j in range(m):
            rest = total - along[:, j]
            for c in range(16):
                of = rows[codes[:, j] == c]
                if not len(of):
                    continue
                p = parts[of, j].astype(np.float64)
                w = ((eta - 1) / norm[of])[:, None] if r >= rounds // 2 else np.zeros((len(of), 1))
                # minimise sum |p - c|^2 + w (rest + p.p - p.c)^2
                a = len(of) * np.eye(2) + (w * p).T @ p
                b = p.sum(axis=0) + (w[:, 0] * (rest[of] + (p**2).sum(axis=1))) @ p
                centres[j, c] = np.linalg.solve(a, b)
            recon_j = centres[j, codes[:, j]]
            along[:, j] = ((parts[:, j] - recon_j) * parts[:, j]).sum(axis=1)
            total = rest + along[:, j]
    return centres


def tables(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """queries x bytes x 256: the score sums of each pair of codes."""
    q = queries.astype(np.float32).reshape(len(queries), centres.shape[0], 2)
    single = np.einsum("qmd,mcd->qmc", q, centres)
    return (single[:, 0::2, None, :] + single[:, 1::2, :, None]).reshape(len(queries), -1, 256)


def scan(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate scores of one query: ``packed`` is bytes x candidates."""
    out = table[0][packed[0]]
    for j in range(1, len(packed)):
        out += table[j][packed[j]]
    return out


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        sure = np.flatnonzero(scores > edge)
        tied = np.flatnonzero(scores == edge)
        tied = tied[np.argsort(ids[tied], kind="stable")[: k - len(sure)]]
        pick = np.concatenate([sure, tied])
    else:
        pick = np.arange(len(scores))
    return pick[np.lexsort((ids[pick], -scores[pick]))]


def reaches(v: np.ndarray, codes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How far the score of a query of norm 1 can be above that of its table: residual norms, and room for rounding."""
    recon = centres[np.arange(len(centres))[None], codes].reshape(len(v), -1).astype(np.float64)
    room = (centres.shape[0] + 8) * 2.0**-22
    return np.linalg.norm(v - recon, axis=1) * (1 + room) + np.linalg.norm(recon, axis=1) * room + 1e-40


def unit(queries: np.ndarray) -> np.ndarray:
    """Queries of norm 1: of any scale in double, they fit the tables' single precision."""
    q = queries / np.abs(queries).max(axis=1, keepdims=True)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def nearest(q: np.ndarray, u: np.ndarray, rough: np.ndarray, reach: np.ndarray, v: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ``k`` best of ``others``, exactly: ``u`` is ``q`` of norm 1, ``rough`` are its table scores."""
    pick = _top(rough, ids, SCAN_KEEP + 1)
    pick = pick[others[pick]]
    exact = (v[pick] * q).sum(axis=1)
    rest = others.copy()
    rest[pick] = False
    if len(pick) >= k:
        last = v[pick[_top(exact, ids[pick], k)[-1]]] * u
        # rows that are not surely below the k-th best, those of scores out of range among them
        rest &= ~(rough + reach < last.sum() - 1e-12 * np.abs(last).sum())
    more = np.flatnonzero(rest)
    pick, exact = np.concatenate([pick, more]), np.concatenate([exact, (v[more] * q).sum(axis=1)])
    best = _top(exact, ids[pick], k)
    return pick[best], exact[best]


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): nearest ``k`` of every row whose id is divisible by ``every``, itself excluded.

    Queries against all rows in blocks: a task meets one block of codes with one block of
    queries and gives the exact ``k`` best of each; a query's rows of all blocks are then ranked.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("_id"), vec.alias("_v")).where("_id IS NOT NULL AND size(_v) > 0")
    src = src.where(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("_v", lambda x: x != 0))
    common = src.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    kinds = "query_id long, rank int, vec_id long, score double"
    if not common:
        return spark.createDataFrame([], kinds).withColumnRenamed("vec_id", id_col)
    dim = common[0]["n"]
    # written once, so that a row's number is the same for all that read it
    rows = stored(src.where(F.size("_v") == dim).withColumn("_row", F.monotonically_increasing_id()), "ann-rows")
    pad = -dim % 4
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("_v").toArrow()
    x = np.array(sample.column(0).combine_chunks().flatten()).reshape(-1, dim)
    centres = fit(np.pad(x, ((0, 0), (0, pad))))
    model = spark.sparkContext.broadcast(centres)

    def packed(arrays: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array([a.tobytes()], pa.binary()) for a in arrays]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                ids, number = part.column(0).to_numpy(), part.column(2).to_numpy()
                v = np.array(part.column(1).flatten()).reshape(-1, dim)
                order = np.lexsort((number, ids))
                ids, number, v = ids[order], number[order], v[order]
                padded = np.pad(v, ((0, 0), (0, pad)))
                codes = assign(padded.astype(np.float32), model.value)
                reach = reaches(padded, codes, model.value)
                codes = np.ascontiguousarray((codes[:, 0::2] | codes[:, 1::2] << 4).T)
                yield pa.RecordBatch.from_arrays(packed([ids.astype("<i8"), number.astype("<i8"), codes, reach.astype("<f8"), v.astype("<f8")]), names=["ids", "rows", "codes", "reach", "vectors"])

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, QUERIES):
                part = b.slice(lo, QUERIES)
                yield pa.RecordBatch.from_arrays(packed([part.column(0).to_numpy().astype("<i8"), part.column(2).to_numpy().astype("<i8"), np.array(part.column(1).flatten()).astype("<f8")]), names=["q_ids", "q_rows", "q_vectors"])

    blocks = stored(rows.mapInArrow(block, "ids binary, rows binary, codes binary, reach binary, vectors binary"), "ann-index", BLOCK)
    asked = rows.where(F.col("_id") % every == 0)
    asked = stored(asked.repartition(max(1, -(-asked.count() // QUERIES)), "_row").mapInArrow(queries, "q_ids binary, q_rows binary, q_vectors binary"), "ann-queries", BLOCK)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                q_ids, q_rows, q, ids, number, codes, reach, v = (np.frombuffer(b.column(i)[row].as_py(), t) for i, t in enumerate(("<i8", "<i8", "<f8", "<i8", "<i8", np.uint8, "<f8", "<f8")))
                q, v, codes = q.reshape(-1, dim), v.reshape(-1, dim), codes.reshape(-1, len(ids))
                found = []
                for lo in range(0, len(q), 64):
                    units = unit(q[lo : lo + 64])
                    lut = tables(np.pad(units, ((0, 0), (0, pad))), model.value)
                    for i in range(len(lut)):
                        at, scores = nearest(q[lo + i], units[i], scan(lut[i], codes), reach, v, ids, number != q_rows[lo + i], k)
                        found.append((np.full(len(at), lo + i), at, scores))
                of, at, scores = (np.concatenate([f[i] for f in found]) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[of]), pa.array(q_ids[of]), pa.array(number[at]), pa.array(ids[at]), pa.array(scores)], names=["_query", "query_id", "_row", "vec_id", "score"])

    met = asked.repartition(max(1, asked.count())).crossJoin(blocks).select("q_ids", "q_rows", "q_vectors", "ids", "rows", "codes", "reach", "vectors")
    near = met.mapInArrow(meet, "_query long, query_id long, _row long, vec_id long, score double")
    w = Window.partitionBy("_query").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("_row"))
    ranked = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = stored(ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score"), "ann-found")
    discard(rows, blocks, asked)
    return out
