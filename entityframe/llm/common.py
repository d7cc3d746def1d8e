"""Helpers shared by the operators: shared storage, batching, hashing of byte texts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step works on, and rows of an Arrow batch of a stored table: they bound a worker's memory.
STEP_BYTES, ARROW_ROWS = 500_000, 1_000
_M64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local folder is made and set if driver and executors are one
    process, as in tests; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="entityframe-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for the jobs that run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, arrow_rows: int = ARROW_ROWS) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends at replicated files.

    The write's shuffle files go as soon as it has ended; the table goes with :func:`discard`
    or, with all others of the application, with :func:`clear`.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(arrow_rows), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/entityframe-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of :func:`stored` tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._stored_path)


def clear(spark: SparkSession) -> None:
    """Deletes all stored tables of the application, those that results still to be read need among them."""
    _delete(spark, _own_dir(spark))


def crc32_of(column: str | object) -> object:
    """crc32 of an id as decimal text, unsigned; null ids count as empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def release() -> None:
    """Gives freed memory of a worker back to the system, at the end of a task."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: Iterable, size: int = STEP_BYTES) -> Iterator[tuple[int, list]]:
    """(first index, run of texts) with about ``size`` bytes in a run; one long text is a run of its own."""
    run, first, total = [], 0, 0
    for i, t in enumerate(texts):
        if run and total + len(t) > size:
            yield first, run
            run, first, total = [], i, 0
        run.append(t)
        total += len(t)
    if run:
        yield first, run


def pieces(text, gap: re.Pattern, size: int = STEP_BYTES) -> Iterator:
    """A text cut into pieces of about ``size`` at matches of ``gap``, which belong to the piece before."""
    at = 0
    while len(text) - at > size:
        found = gap.search(text, at + size)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def batch_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes; null counts as empty."""
    arr = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in arr.cast(pa.large_binary()).to_pylist()]


def text_batches(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about ``size`` text bytes, with their texts."""
    for b in batches:
        lengths = b.column(b.schema.get_field_index(column)).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(lengths.buffers()[1], np.int64, len(lengths) + 1, lengths.offset * 8)) if len(lengths) else np.empty(0, np.int64)
        lo, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > lo and total + n > size:
                part = b.slice(lo, i - lo)
                yield part, batch_texts(part, column)
                lo, total = i, 0
            total += n
        if lo < b.num_rows:
            part = b.slice(lo)
            yield part, batch_texts(part, column)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor), vectorised."""
    h = h.astype(np.uint64, copy=True)
    h += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & _M64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: The odd base of the rolling sums; bytes of a gram; masks of a gram's first bytes.
_BASE, GRAM = 0xD6E8FEB86659FD93, 8
_INVERSE = pow(_BASE, -1, 1 << 64)
MASKS = np.array([(1 << 8 * i) - 1 for i in range(GRAM + 1)], np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; those that a usual step needs are kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.empty(max(n + 1, 1 << 16), np.uint64)
        have[0] = 1
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if n <= 2 * STEP_BYTES:
            _powers[base] = have
    return have[: n + 1]


class Rolling:
    """Hashes of any spans of one byte array.

    Every place has the mixed value of its 8 bytes. Spans of 8 bytes or more are sums of these
    over their whole grams, by powers of a base modulo 2**64; shorter spans are their bytes; the
    length is mixed in. As the sums are of mixed grams and not of bytes, strings built to collide
    under polynomials modulo 2**64 don't.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        room = np.zeros(n + GRAM, np.uint8)
        room[:n] = data
        self.bytes8 = np.ndarray((n + 1,), "<u8", room, 0, (1,)).astype(np.uint64)
        self.grams = mix(self.bytes8, 7)
        self.sums = np.zeros(n + 2, np.uint64)
        np.cumsum(self.grams * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        value = (self.sums[np.maximum(end - (GRAM - 1), start)] - self.sums[start]) * self.back[start]
        short = np.flatnonzero(n < GRAM)
        if len(short):
            value[short] = self.bytes8[start[short]] & MASKS[n[short]]
        value += n.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        return mix(value)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _hash_words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
    solid = np.zeros(len(data) + 1, np.int8)
    solid[1:] = ~_SPACE[data]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, bounds), prepend=0)
    return Rolling(data).spans(start, end), counts


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, and the words' count in each text."""
    if len(texts) > 1 or len(texts[0]) <= 2 * STEP_BYTES:
        return _hash_words(texts, lower)
    found = np.concatenate([_hash_words([p], lower)[0] for p in pieces(texts[0], _GAP)])
    return found, np.array([len(found)])


def chained(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = max(len(words) - k + 1, 0)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[j : j + n])
    return h


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``k``-word shingles.

    A text with fewer words has its whole sequence as the one shingle; one without words has none.
    """
    out: list[np.ndarray] = []
    for _, run in slices(texts):
        words, counts = word_hashes(run)
        runs = chained(words, k)
        at = 0
        for c in counts.tolist():
            out.append(np.unique(runs[at : at + c - k + 1]) if c >= k else chained(words[at : at + c], c) if c else np.empty(0, np.uint64))
            at += c
    return out
