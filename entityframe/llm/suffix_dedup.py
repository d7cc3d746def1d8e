"""Suffix-array dedup: repeated byte strings by merging Burrows-Wheeler transforms.

1. Sharding by content. Each string of ``length`` bytes chooses a place in its first
   ``WINDOW`` bytes (the 8-byte gram of least hash), so equal strings choose alike. Strings
   that choose one place of a text form a context; contexts meet by the hash of what all
   strings of the place share. A context that meets no other holds no repeat. All others go
   on, each distinct context once with its count.
2. Burrows-Wheeler transforms. In a bucket of groups, symbols are the hashes of ``length / D``
   bytes, and every residue of a context is a string of such symbols. Each shard of the
   bucket sorts its own suffixes and keeps its transform (the symbol before each suffix).
3. Merge. The interleave of the shards' rows is refined ``D`` times: walking it in order, each
   row goes to the bucket of its preceding symbol. The round in which neighbours part is
   their common prefix; no suffix is sorted again. Intervals that ``D`` rounds leave whole are
   the repeated strings.

Groups of more than ``HOT_CONTEXTS`` distinct contexts are not gathered in a task: their
strings are counted one by one by hash, which gives the same answer.

Defined results: null texts are empty; texts shorter than ``length`` keep all bytes; very
long texts are worked on in pieces that overlap by a string; equal rows (copies of a text)
repeat each other; ties don't exist; an empty table gives an empty one; other columns are
kept untouched, work columns start with an underscore. Strings are compared by 64-bit
hashes, texts by a 64-bit hash and their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GRAM, STEP_BYTES, Rolling, discard, release, stored, text_batches

WINDOW = 128
#: Bytes of contexts that one merge takes; shards of a merge; contexts of a group beyond which strings are counted by hash.
BUCKET_BYTES, SHARDS, HOT_CONTEXTS = 1_000_000, 4, 20_000
#: Bytes whose symbols are hashed at a time.
HASH_BYTES = 1 << 16


def places(grams: np.ndarray, window: int) -> np.ndarray:
    """For each start of a run of ``window`` grams, the place of the least gram (the first, if equal). At most 2**24 grams."""
    n = len(grams)
    if n < window:
        return np.empty(0, np.int64)
    if n > 1 << 24:
        raise ValueError("too many grams: cut the text into pieces")
    low = np.uint64(0xFFFFFF)
    least = (grams & ~low) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    m = n - window + 1
    if span < window:
        least = np.minimum(least[:m], least[window - span : window - span + m])
    return (least & low).astype(np.int64)


def stretches(texts: list[bytes], length: int, size: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first byte, texts): a long text alone in pieces, in which each of its strings of ``length`` bytes begins once."""
    if len(texts) != 1 or len(texts[0]) < 2 * size:
        yield 0, texts
        return
    for at in range(0, len(texts[0]) - length + 1, size):
        yield at, [texts[0][at : at + size + length - 1]]


def contexts(run: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, left, last, key, content hash) of the texts' contexts: strings beginning at left..last choose one place."""
    window = min(WINDOW, length - GRAM)
    sizes = np.array([len(t) for t in run])
    data = np.frombuffer(b"".join(run), np.uint8)
    ends = np.cumsum(sizes)
    roll = Rolling(data)
    place = places(roll.grams[: max(len(data) - GRAM + 1, 0)], window)
    start = np.arange(len(place))
    text = np.minimum(np.searchsorted(ends, start, side="right"), len(run) - 1)
    inside = start + length <= ends[text]
    start, place, text = start[inside], place[inside], text[inside]
    first = np.flatnonzero(np.diff(place, prepend=-1) != 0)
    last = np.append(first[1:], len(place))[: len(first)] - 1
    left, right, place, text = start[first], start[last], place[first], text[first]
    base = (ends - sizes)[text]
    key = roll.spans(place, place + length - window + 1)
    content = roll.spans(left, right + length)
    return text, left - base, right - base, key, content


def collapsed(text: np.ndarray, begin: np.ndarray, end: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """(one context of each content in a text, how often it stands there, the bytes that all its places cover if it is repeated there)."""
    order = np.lexsort((begin, content, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (content[order][1:] != content[order][:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    more: list = [None] * len(first)
    for i in np.flatnonzero(count > 1).tolist():
        at = order[first[i] : first[i] + count[i]]
        more[i] = [x for span in united(list(zip(begin[at].tolist(), end[at].tolist(), strict=True))) for x in span]
    return order[first], count, more


def symbols(length: int) -> tuple[int, int]:
    """(bytes of a symbol, symbols of a string)."""
    d = max(d for d in (1, 2, 3, 4) if length % d == 0)
    return length // d, d


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal values together, whether each is the first of its value in that order)."""
    n = len(h)
    low = np.uint64((1 << n.bit_length()) - 1)
    packed = (h & ~low) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int32)
    value = h[order]
    new = np.ones(n, bool)
    new[1:] = value[1:] != value[:-1]
    packed &= ~low
    if (new[1:] & (packed[1:] == packed[:-1])).any():  # values that differ in the low bits alone
        order = np.argsort(h, kind="stable").astype(np.int32)
        value = h[order]
        new[1:] = value[1:] != value[:-1]
    return order, new


def in_order(code: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes, their stable order) of codes from 0 to ``top``: each code is sorted as one number with its place, where both fit 63 bits."""
    bits = len(code).bit_length()
    if int(top).bit_length() + bits > 63:
        order = np.argsort(code, kind="stable")
        return code[order], order
    packed = code.astype(np.int64)
    packed <<= bits
    packed |= np.arange(len(code))
    packed.sort()
    order = (packed & ((1 << bits) - 1)).astype(np.int32)
    packed >>= bits
    return packed, order


def transform(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's transform: (preceding code of each sorted row, row of each; -1: the end of a string).

    ``code`` is over 0, ``after`` the row that follows each or -1. Ends sort first, in the order of their strings.
    """
    n = len(code)
    rank, step = code, after
    while True:
        top = int(rank.max(initial=0)) + 1
        follow = np.where(step >= 0, rank[step] + 1, 0)
        pair, order = in_order(rank.astype(np.int64) * (top + 1) + follow, (top + 1) ** 2)
        step = np.where(step >= 0, step[step], -1)
        if not (step >= 0).any():
            break
        new = np.zeros(n, bool)
        new[1:] = pair[1:] != pair[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32)
    before = np.zeros(n, np.int32)
    has = after >= 0
    before[after[has]] = code[has]
    return np.concatenate([code[~has], before[order]]), np.concatenate([np.full(int((~has).sum()), -1, np.int32), order])


def merge(tables: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement of transforms: (shard of each merged row, symbols it shares with the row before, ``depth`` at most)."""
    sizes = [len(t) for t in tables]
    n, top = sum(sizes), max(int(t.max(initial=0)) for t in tables)
    ends = np.concatenate([np.full(int((t == 0).sum()), s, np.int8) for s, t in enumerate(tables)])
    interleave = np.repeat(np.arange(len(tables), dtype=np.int8), sizes)
    block = np.zeros(n, np.int32)
    common = np.full(n, depth, np.int8)
    row_code = np.empty(n, np.int32)
    for k in range(depth):
        for s, t in enumerate(tables):
            row_code[interleave == s] = t
        code, order = in_order(row_code, top)
        origin = block[order]
        interleave = interleave[order]
        interleave[: len(ends)] = ends
        parts = np.ones(n, bool)
        parts[1:] = (code[1:] != code[:-1]) | (origin[1:] != origin[:-1])
        parts[: len(ends)] = True
        common[parts & (common == depth)] = k
        block = np.cumsum(parts, dtype=np.int32)
    return interleave, common


def symbol_hashes(data: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the ``q`` bytes from each place of the sorted ``at``, worked out ``HASH_BYTES`` at a time."""
    out = np.empty(len(at), np.uint64)
    for base in range(0, len(data), HASH_BYTES):
        lo, hi = np.searchsorted(at, (base, base + HASH_BYTES))
        here = at[lo:hi] - base
        out[lo:hi] = Rolling(data[base : base + HASH_BYTES + q - 1]).spans(here, here + q)
    return out


def repeated_starts(data: np.ndarray, sizes: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of ``length`` bytes at each byte of ``data`` occurs elsewhere in it; its strings of ``sizes`` bytes stand ``counts`` times each."""
    q, depth = symbols(length)
    n, number = len(data), len(sizes)
    out = np.zeros(n, bool)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(number, dtype=np.int32), sizes)
    left = np.repeat(ends.astype(np.int32), sizes) - np.arange(n, dtype=np.int32)
    at = np.flatnonzero(left >= q)
    order, new = numbered(symbol_hashes(data, at, q))
    if not len(order):
        return out
    first = np.flatnonzero(new)
    often = np.add.reduceat(counts[owner[at[order]]], first) > 1
    # symbols that stand once are no part of a repeated string: the others are numbered from 1
    symbol = np.zeros(n + length, np.int32)
    symbol[at[order]] = np.where(often, np.cumsum(often, dtype=np.int32), 0)[np.cumsum(new, dtype=np.int32) - 1]
    del order, new, first, at
    whole = left >= length
    for j in range(depth):
        whole &= symbol[j * q : j * q + n] > 0
    del left
    keep = np.zeros(n + length, bool)
    for j in range(depth):
        keep[j * q : j * q + n] |= whole
    rows = np.flatnonzero(keep[:n]).astype(np.int32)
    if not len(rows):
        return out
    row_code = symbol[rows]
    place = symbol  # the symbols are read: their room takes the numbers of the rows
    place.fill(-1)
    place[rows] = np.arange(len(rows), dtype=np.int32)
    row_owner = owner[rows]
    after = place[rows + q]
    after[(after >= 0) & (row_owner[after] != row_owner)] = -1
    del symbol, place, owner, keep
    # shards: runs of whole strings
    cuts = np.searchsorted(row_owner, np.linspace(0, number, SHARDS + 1).astype(int))
    tables, suffixes = [], []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi > lo:
            t, s = transform(row_code[lo:hi], np.where(after[lo:hi] >= 0, after[lo:hi] - lo, -1))
            tables.append(t)
            suffixes.append(np.where(s >= 0, s + lo, -1))
    del row_code, after
    interleave, common = merge(tables, depth)
    suffix = np.empty(len(interleave), np.int32)
    for k, s in enumerate(suffixes):
        suffix[interleave == k] = s
    del tables, suffixes, interleave
    weight = np.where(suffix >= 0, counts[row_owner[suffix]], 0)
    start = np.flatnonzero(common < depth)
    found = np.repeat(np.add.reduceat(weight, start) > 1, np.diff(np.append(start, len(common)))) & (suffix >= 0)
    out[rows[suffix[found]]] = True
    return out & whole


def groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Whole groups (rows of one _key, which stand together) with about ``size`` bytes of _string at most; a larger group is alone."""
    held: list[tuple] = []
    group: list[tuple] = []
    held_size = group_size = 0
    last = None

    def table() -> pa.Table:
        return pa.Table.from_batches([b.slice(lo, hi - lo) for b, lo, hi in held])

    for b in batches:
        key = b.column(0).to_numpy()
        total = np.append(0, np.cumsum(pc.binary_length(b.column(3)).to_numpy().astype(np.int64))).tolist()
        starts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if lo < hi and key[lo] != last:
                if held and held_size + group_size > size:
                    yield table()
                    held, held_size = [], 0
                if held and group and held[-1][0] is group[0][0] and held[-1][2] == group[0][1]:
                    held[-1] = (held[-1][0], held[-1][1], group[0][2])
                    group = group[1:]
                held += group
                held_size += group_size
                group, group_size, last = [], 0, key[lo]
            group.append((b, lo, hi))
            group_size += total[hi] - total[lo]
    if held and held_size + group_size > size:
        yield table()
        held = []
    held += group
    if held:
        yield table()


def joined(strings: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all strings, size of each)."""
    flat = strings.cast(pa.large_binary()).combine_chunks()
    at = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
    return np.frombuffer(flat.buffers()[2], np.uint8)[at[0] : at[-1]], np.diff(at)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true flags."""
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def repeated_spans(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """(_text_id, _size, _spans: sorted begin and end bytes of strings that start elsewhere too) of texts that have some."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    texts = with_text_id(docs, text_col).select("_text_id", "_size", "_bytes")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, whole in text_batches(batches, "_bytes"):
            ids, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
            for base, run in stretches(whole, length):
                text, left, last, key, content = contexts(run, length)
                one, count, more = collapsed(text, left + base, last + base + length, content)
                of = text[one]
                yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(sizes[of]), pa.array((left[one] + base).astype(np.int32)), pa.array((last[one] + base).astype(np.int32)), _long(key[one]), _long(content[one]), pa.array(count), pa.array(more, pa.list_(pa.int32()))], names=["_text_id", "_size", "_left", "_last", "_key", "_content", "_times", "_more"])
        release()

    rows = texts.mapInArrow(find, "_text_id long, _size int, _left int, _last int, _key long, _content long, _times long, _more array<int>")
    shared = rows.groupBy("_key").agg(F.sum("_times").alias("_n")).where("_n > 1").select("_key")
    met = stored(rows.join(shared, "_key"), "suffix-contexts")

    distinct = met.groupBy("_key", "_content").agg(F.sum("_times").alias("_count"), F.min(F.struct("_text_id", "_size", "_left", "_last")).alias("_at"))
    hot = distinct.groupBy("_key").agg(F.count(F.lit(1)).alias("_kinds")).where(F.col("_kinds") > HOT_CONTEXTS).select("_key", F.lit(True).alias("_hot"))
    wanted = distinct.join(hot, "_key", "left").select(F.col("_at._text_id").alias("_text_id"), F.col("_at._size").alias("_size"), F.struct(F.col("_at._left").alias("l"), F.col("_at._last").alias("r"), F.col("_key").alias("k"), F.col("_content").alias("c"), F.col("_count").alias("n"), F.coalesce("_hot", F.lit(False)).alias("h")).alias("_w"))
    wanted = wanted.groupBy("_text_id", "_size").agg(F.collect_list("_w").alias("_w"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, want in zip(b.column(0), b.column(1), strict=True):
                t, w = text.as_py(), want.values.flatten()
                left, last = np.array(w[0]), np.array(w[1])
                yield pa.RecordBatch.from_arrays([w[2], w[3], w[4], w[5], pa.array([t[x:y] for x, y in zip(left.tolist(), (last + length).tolist(), strict=True)], pa.binary())], names=["_key", "_content", "_count", "_hot", "_string"])

    one_each = texts.groupBy("_text_id", "_size").agg(F.first("_bytes").alias("_bytes"))
    strings = stored(one_each.join(wanted, ["_text_id", "_size"]).select("_bytes", "_w").mapInArrow(cut, "_key long, _content long, _count long, _hot boolean, _string binary"), "suffix-strings")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, BUCKET_BYTES):
            data, sizes = joined(t.column(3))
            a, b = runs(repeated_starts(data, sizes, t.column(2).to_numpy(), length))
            ends = np.cumsum(sizes)
            of = np.searchsorted(ends, a, side="right")  # no run goes on in the next string: the last bytes of each begin none
            base = (ends - sizes)[of]
            yield pa.RecordBatch.from_arrays([_long(t.column(0).to_numpy()[of]), _long(t.column(1).to_numpy()[of]), pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))], names=["_key", "_content", "a", "b"])
        release()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, content, count, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = np.arange(len(s) - length + 1)
                h = Rolling(np.frombuffer(s, np.uint8)).spans(at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array([content] * len(at), pa.int64()), pa.array([count] * len(at), pa.int64()), pa.array(at.astype(np.int32)), _long(h)], names=["_key", "_content", "_count", "_a", "_hash"])

    fields = ("_key", "_content", "_count", "_string")
    cold = strings.where("NOT _hot").select(*fields).repartition(n, "_key").sortWithinPartitions("_key", "_content").mapInArrow(search, "_key long, _content long, a int, b int")
    single = strings.where("_hot").select(*fields).mapInArrow(each, "_key long, _content long, _count long, _a int, _hash long")
    again = single.groupBy("_hash").agg(F.sum("_count").alias("_n")).where("_n > 1").select("_hash")
    warm = single.join(again, "_hash").select("_key", "_content", F.col("_a").alias("a"), F.col("_a").alias("b"))

    # a context that stands more than once in a text has _more, the bytes of all its places: the merge found it repeated whole
    found = met.join(cold.unionByName(warm), ["_key", "_content"])
    here = F.array(F.struct((F.col("_left") + F.col("a")).alias("a"), (F.col("_left") + F.col("b") + length).alias("b")))
    there = F.transform(F.sequence(F.lit(0), F.size("_more") - 2, F.lit(2)), lambda i: F.struct(F.get("_more", i).alias("a"), F.get("_more", i + 1).alias("b")))
    spans = found.select("_text_id", "_size", F.explode(F.when(F.col("_more").isNull(), here).otherwise(there)).alias("_s"))
    out = stored(spans.groupBy("_text_id", "_size").agg(F.sort_array(F.collect_set("_s")).alias("_spans")), "suffix-spans")
    discard(met, strings)
    return out


def with_text_id(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _bytes (null: empty), _text_id, a hash of them, and _size."""
    data = docs.withColumn("_bytes", F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    return data.withColumns({"_text_id": F.xxhash64("_bytes"), "_size": F.octet_length("_bytes")})


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _spans_of(value: pa.Scalar) -> list[tuple[int, int]]:
    if not value.is_valid:
        return []
    a, b = value.values.flatten()
    return united(list(zip(a.to_pylist(), b.to_pylist(), strict=True)))


def digests(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, value in zip(b.column(1), b.column(2), strict=True):
                data, spans = text.as_py(), _spans_of(value)
                rows.append((len(data), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept(data, spans)).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 3, pa.string()], strict=True))], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    src = with_text_id(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    joined = src.join(repeated_spans(docs, length, text_col), ["_text_id", "_size"], "left").select("_id", "_bytes", "_spans")
    return joined.mapInArrow(step, f"_id {src.schema['_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("_id", id_col)


def apply(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut from the text; halves of cut characters go too. Other columns are untouched."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if not x.is_valid else kept(x.as_py(), _spans_of(s)).decode("utf-8", "ignore") for x, s in zip(b.column(at).cast(pa.binary()), b.column(len(b.columns) - 1), strict=True)]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names, at = docs.columns, docs.columns.index(text_col)
    joined = with_text_id(docs, text_col).join(repeated_spans(docs, length, text_col), ["_text_id", "_size"], "left").select(*docs.columns, "_spans")
    return joined.mapInArrow(step, docs.schema)
