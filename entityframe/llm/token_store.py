"""Token-id output as directly addressable codes (DACs).

Ids are cut into 8-bit chunks. Level 0 holds the lowest chunk of every id, level k the
next chunk of those that have one; a continuation bitmap of each level tells which, and a
rank directory (ones before every 512th bit) finds the place in the next level, so any id
is read without decoding others, and the ids of a document are a run of each level. Blocks lie in ascending document order in a table of the
shared folder: Spark's committer makes rewritten tasks safe.

Defined results: null texts are empty (one end id); null document ids sort first; repeated
rows are written again; ties in the id keep one order, by the text's hash; an empty table
gives an empty one; other columns don't matter. One document is never split between blocks,
however long its text is.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, text_runs
from .common import release, stored

#: Ids in a block, beyond which it is closed; bits between entries of the rank directory.
BLOCK_IDS, STRIDE = 500_000, 512


def pack(ids: np.ndarray) -> bytes:
    """A block of ids as directly addressable codes."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    while True:
        more = rest >> 8
        bits = more != 0
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros(-(-len(packed) // (STRIDE // 8)) * (STRIDE // 8), np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded).reshape(-1, STRIDE // 8).sum(axis=1, dtype=np.int64)
        rank = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.empty(0, "<u4")
        levels.append((len(rest), (rest & 255).astype(np.uint8).tobytes(), packed.tobytes(), rank.tobytes()))
        rest = more[bits]
        if not len(rest):
            break
    head = b"DAC1" + struct.pack("<I", len(levels))
    return head + b"".join(struct.pack("<IIII", n, len(a), len(b), len(c)) + a + b + c for n, a, b, c in levels)


class Block:
    """Reads a packed block: any id alone, or all."""

    def __init__(self, blob: bytes):
        if blob[:4] != b"DAC1":
            raise ValueError("not a block of directly addressable codes")
        (count,) = struct.unpack_from("<I", blob, 4)
        at, self.levels = 8, []
        for _ in range(count):
            n, a, b, c = struct.unpack_from("<IIII", blob, at)
            at += 16
            chunk = np.frombuffer(blob, np.uint8, a, at)
            bits = np.frombuffer(blob, np.uint8, b, at + a)
            rank = np.frombuffer(blob, "<u4", c // 4, at + a + b)
            self.levels.append((n, chunk, bits, rank))
            at += a + b + c

    def __len__(self) -> int:
        return self.levels[0][0]

    def __getitem__(self, i: int) -> int:
        """One id, by rank in each level's bitmap."""
        value = shift = 0
        for _, chunk, bits, rank in self.levels:
            value |= int(chunk[i]) << shift
            shift += 8
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            lo = i // STRIDE * STRIDE
            between = np.unpackbits(bits[lo // 8 : i // 8 + 1], bitorder="little")[: i - lo]
            i = int(rank[i // STRIDE]) + int(between.sum())
        raise ValueError("a continuation leads past the last level")

    def span(self, lo: int, hi: int) -> np.ndarray:
        """The ids lo .. hi - 1. Those that go on are a run of the next level, found by rank."""
        out = where = None
        for k, (_, chunk, bits, rank) in enumerate(self.levels):
            part = chunk[lo:hi].astype(np.uint32) << np.uint32(8 * k)
            if out is None:
                out = part
            else:
                out[where] |= part
            base = lo // STRIDE * STRIDE
            flags = np.unpackbits(bits[base // 8 : -(-hi // 8)], bitorder="little")[: hi - base]
            on = np.flatnonzero(flags[lo - base :])
            if not len(on):
                return out
            where = on if where is None else where[on]
            lo = int(rank[base // STRIDE]) + int(np.count_nonzero(flags[: lo - base]))
            hi = lo + len(on)
        raise ValueError("a continuation leads past the last level")


_encoders: dict[str, Vocabulary] = {}


def library_encoder(path: str) -> Vocabulary:
    """The word table of :class:`Vocabulary`, with the tokenizers library as the encoder of words.

    The byte-level pre-tokenizer makes a word's ids independent of its neighbours, so the
    library is asked once for each word.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        (line,) = tok.encode("\n", add_special_tokens=False).ids

        def learn(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            words = [w.decode() for w in new]
            # a line break parts words as the pre-tokenizer does, so that one call encodes many; white space goes alone
            solid = [i for i, w in enumerate(words) if "\n" not in w and w.strip()]
            alone = sorted(set(range(len(words))) - set(solid))
            ids: list = [None] * len(words)
            if solid:
                joined = np.array(tok.encode_batch_fast(["\n".join(words[i] for i in solid)], add_special_tokens=False)[0].ids, np.uint32)
                parts = np.split(joined, np.flatnonzero(joined == line))
                if len(parts) != len(solid):
                    raise ValueError("the tokenizer doesn't part words at line breaks")
                for k, (i, p) in enumerate(zip(solid, parts, strict=True)):
                    ids[i] = p[1:] if k else p
            for i, e in zip(alone, tok.encode_batch_fast([words[i] for i in alone], add_special_tokens=False), strict=True):
                ids[i] = np.array(e.ids, np.uint32)
            return np.concatenate(ids), np.array(list(map(len, ids)), np.int64)

        _encoders[path] = Vocabulary(path, learn)
    return _encoders[path]


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Writes the blocks table and returns it: part, offset (ids before it in its part), ids of documents, their counts, the packed block."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_encoder(path)
        part, offset = TaskContext.get().partitionId(), 0
        docs_of: list[pa.Array] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal offset
            n = np.concatenate(counts)
            total = int(n.sum())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), values) for values in (pa.concat_arrays(docs_of), pa.array(n, pa.int64()))]
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([offset], pa.int64()), pa.array([total], pa.int64()), *lists, pa.array([pack(np.concatenate(ids))], pa.binary())],
                names=["part", "offset", "n_ids", "docs", "counts", "block"],
            )
            offset += total
            docs_of.clear(), counts.clear(), ids.clear()
            return out

        for b in batches:
            for first, texts in text_runs(b, 1):
                of_run, n = words.encode_run(texts)
                ended = np.insert(of_run, np.cumsum(n), np.uint32(end_id))
                docs_of.append(b.column(0).slice(first, len(texts)))
                counts.append(n + 1)
                ids.append(ended)
                if sum(map(len, ids)) >= BLOCK_IDS:
                    yield close()
        if counts:
            yield close()
        release()

    ordered = src.repartitionByRange(n, F.col("_id").asc_nulls_first(), F.xxhash64("_text")).sortWithinPartitions(F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
    return stored(ordered.mapInArrow(step, f"part int, offset long, n_ids long, docs array<{kind}>, counts array<long>, block binary"), "token-blocks")


def read(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the blocks.

    What reaches the driver is one count for each part of the table.
    """
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                part, offset, docs, counts, blob = (b.column(k)[row] for k in range(5))
                block = Block(blob.as_py())
                n = counts.values.to_numpy()
                ends = np.cumsum(n)
                crc = [zlib.crc32(block.span(lo, hi).astype("<u4").tobytes()) for lo, hi in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                first = base[part.as_py()] + offset.as_py()
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(first + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["_id", "start", "n_tokens", "ids_crc32"])

    src = blocks.select("part", "offset", "docs", "counts", "block")
    return src.mapInArrow(step, f"_id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("_id", id_col)
