"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source is cut into shards by a hash of the row. The sources' token targets are
turned into whole numbers of blocks (highest quotients target / (2 k + 1)), those of a
source likewise into quotas of its shards, bounded by what a shard can give. In a shard the
documents stand in a seeded order on a ring; the quota is a run of blocks of the ring from
a seeded start, which gives the words that the mix takes of each document.

What reaches the driver is one row for each source. Defined results: null texts have no
words; null sources are one source, last in order; repeated rows share the ring position of
their kind but are counted each (of rows equal in id and text but not in other columns, either
may get the words of the other); reruns agree, whatever the order of rows; an empty table
gives an empty one; other columns with clashing names don't matter, since all work columns
are prefixed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Tokens in a block; tokens that a shard holds about, over all sources; least number of shards.
BLOCK, SHARD_TOKENS, SHARDS = 8, 2_000_000, 64
#: Parts of a document in which its copies are summed.
PARTS = 1_000_000_000


def targets(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Target of each source: ``share`` of all sizes by weight, cut at ``most`` times its size, the excess reshared until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), {}, list(order)
    while free:
        left, mass = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / mass > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / mass for s in free}
            break
        out |= {s: most * sizes[s] for s in over}
        free = [s for s in free if s not in set(over)]
    return {s: float(out.get(s, 0.0)) for s in order}


def apportion(claims: list[float] | np.ndarray, seats: int, most: list[int] | np.ndarray) -> list[int]:
    """Sainte-Lague: ``seats`` by highest quotients claim / (2 k + 1), ties to the earlier claim, at most ``most`` each.

    A common divisor gives nearly all seats at once; the last ones are dealt by the heap of quotients.
    """
    claims, most = np.asarray(claims, np.float64), np.asarray(most, np.int64)
    most = np.where(claims > 0, most, 0)
    seats = min(seats, int(most.sum()))
    if seats <= 0:
        return [0] * len(claims)

    def at(divisor: float) -> np.ndarray:
        return np.minimum(most, np.minimum(np.floor(claims / divisor + 0.5), 2.0**62).astype(np.int64))

    lo, hi = claims[claims > 0].min() / (2 * int(most.max()) + 2), 2 * claims.max() + 1
    for _ in range(100):
        mid = math.sqrt(lo * hi)
        lo, hi = (lo, mid) if at(mid).sum() <= seats else (mid, hi)
    out = at(hi * (1 + 1e-12))
    left = seats - int(out.sum())
    # whoever gets one of the last seats is among as many highest quotients
    free = np.flatnonzero(out < most)
    free = free[np.lexsort((free, -(claims[free] / (2 * out[free] + 1))))[:left]]
    heap = [(-claims[i] / (2 * out[i] + 1), i) for i in free.tolist()]
    heapq.heapify(heap)
    for _ in range(left):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-claims[i] / (2 * out[i] + 1), i))
    return out.tolist()


def words_in(text):
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text column; null has none."""
    gaps = F.regexp_count(text, F.lit(r"(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0D]"))
    return F.coalesce(gaps, F.lit(0)).cast("long")


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, keep: bool = False) -> DataFrame:
    """Rows with _id, _size, _source_size, _target, _taken; with ``keep`` all columns of ``docs`` as a struct ``_row`` and the copies ``_times`` too.

    The copies are the steps of the rounded running sum of _taken / _size along the source's shards and their rings,
    so that rounding doesn't add up. Sums are of billionths: the order of summing can't change them.
    """
    size = words_in(F.col(text_col))
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), size.alias("_size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_hash"), *([F.struct(*docs.columns).alias("_row")] if keep else []))
    # written once: a row's number is the same for all that read it, and whole rows meet their copies in one shuffle
    whole = stored(sized.withColumn("_number", F.monotonically_increasing_id()), "mix-rows")
    meta = whole.drop("_row")
    by_source = {r["_source"]: int(r["n"]) for r in meta.groupBy("_source").agg(F.sum("_size").alias("n")).collect()}
    goal = targets(by_source, weights, share, most)
    names = list(goal)
    blocks = dict(zip(names, apportion([goal[s] for s in names], round(sum(goal.values()) / BLOCK), [math.ceil(most * by_source[s] / BLOCK) for s in names]), strict=True))
    shards = max(SHARDS, sum(by_source.values()) // SHARD_TOKENS)
    shard = F.pmod(F.col("_hash"), F.lit(shards)).cast("int").alias("_shard")
    cells = meta.select("*", shard).groupBy("_source", "_shard").agg(F.sum("_size").alias("_cell"))

    def quota(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = key[0].as_py()
        got = pa.Table.from_batches(batches).sort_by("_shard")
        shard, cell = (got.column(c).to_numpy() for c in ("_shard", "_cell"))
        ceiling = np.floor(most * cell).astype(np.int64)
        seats = np.array(apportion(cell, blocks[source], np.ceil(most * cell / BLOCK).astype(np.int64)), np.int64)
        taken = np.minimum(seats * BLOCK, ceiling)
        start = np.array([int(np.random.default_rng([seed, s]).integers(0, max(1, -(-c // BLOCK)))) * BLOCK for s, c in zip(shard.tolist(), cell.tolist(), strict=True)], np.int64)
        n = len(shard)
        yield pa.RecordBatch.from_arrays(
            [pa.array([source] * n, pa.string()), pa.array(shard, pa.int32()), pa.array(cell, pa.int64()), pa.array(taken, pa.int64()), pa.array(start, pa.int64()), pa.array([by_source[source]] * n, pa.int64()), pa.array([goal[source]] * n, pa.float64())],
            names=["_source", "_shard", "_cell", "_quota", "_start", "_source_size", "_target"],
        )

    quotas = cells.groupBy("_source").applyInArrow(quota, "_source string, _shard int, _cell long, _quota long, _start long, _source_size long, _target double")
    ring = Window.partitionBy("_source", "_shard").orderBy("_hash", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = quotas.select(F.col("_source").alias("_s"), F.col("_shard").alias("_k"), "_cell", "_quota", "_start", "_source_size", "_target")
    before = lambda x: f"(CASE WHEN _cell = 0 THEN 0 ELSE (({x}) div _cell) * _size + greatest(0, least(_size, ({x}) % _cell - (_end - _size))) END)"
    taken = F.expr(f"{before('_start + _quota')} - {before('_start')}").cast("long")

    def placed(rows: DataFrame) -> DataFrame:
        ended = rows.select("*", shard).withColumn("_end", F.sum("_size").over(ring))
        return ended.join(q, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_k"))).withColumn("_taken", taken).drop("_s", "_k")

    columns = ["_id", "_size", "_source_size", "_target", "_taken"]
    if not keep:
        return placed(meta).select(*columns)
    part = F.expr(f"CASE WHEN _size = 0 THEN 0L ELSE _taken * {PARTS} div _size END")
    ring = Window.partitionBy("_source", "_shard").orderBy("_hash", "_id", "_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_cell = placed(meta).groupBy("_source", "_shard").agg(F.sum(part).alias("_parts"))
    earlier = Window.partitionBy("_source").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    begun = of_cell.select(F.col("_source").alias("_s"), F.col("_shard").alias("_k"), F.coalesce(F.sum("_parts").over(earlier), F.lit(0)).alias("_begun"))
    summed = placed(meta).withColumn("_part", part).withColumn("_sum", F.sum("_part").over(ring))
    summed = summed.join(begun, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_k"))).withColumn("_sum", F.col("_sum") + F.col("_begun"))
    times = F.expr(f"(_sum + {PARTS // 2}) div {PARTS} - (_sum - _part + {PARTS // 2}) div {PARTS}").cast("int")
    return summed.select(*columns, "_number", times.alias("_times")).join(whole.select("_number", "_row"), "_number").drop("_number")


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, to a whole number next to it; columns of ``docs``."""
    mixed = mix(docs, keep=True, **options)
    return mixed.where("_times > 0").select(F.explode(F.array_repeat("_row", F.col("_times"))).alias("_row")).select("_row.*")
