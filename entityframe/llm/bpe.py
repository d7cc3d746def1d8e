"""BPE encoding and decoding by batched numpy merge rounds.

Texts are split into words in numpy, by classes of their characters; words are told apart by
hashes, and only words that a bounded per-worker table lacks are encoded. Their symbols lie
in one flat array: each round looks up all neighbouring pairs by binary search in the sorted
pair keys, finds each word's pair of lowest rank and merges its occurrences, until no word
has a pair left. A very long word is merged rank by rank, each round looking up only the
pairs that the one before has made. Ids and decoded bytes are gathered by offsets.

Defined results: null texts are empty texts (no ids, empty decoded text); very long texts
and words are encoded whole; repeated rows give repeated results; an empty table gives an
empty one; other columns of the input don't matter. Words of more than eight bytes are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GRAM, MASKS, mix, release

#: Slots of a worker's word table, of which half are used; ids that it holds; places tried for a word.
SLOTS, POOL, PROBES = 1 << 20, 1 << 22, 16
#: Characters that one step splits; words learnt at once; symbols beyond which a word is merged alone; bytes beyond which one is hashed alone.
RUN, LEARN, LONG, LONG_BYTES = 500_000, 50_000, 400, 64
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: White space of Unicode; the libraries' own classes differ in control characters.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        every = "".join(map(chr, range(0x110000)))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{WHITE}]+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        _classes.append(table)
    return _classes[0]


def split_words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 of all texts, first byte of each word, words in each text), cut as the byte-level pre-tokenizer does.

    Words are runs of letters, of numbers or of others, with a space before them if there is one;
    runs of white space without the character that goes to the next word; and the endings of
    English contractions.
    """
    whole = "".join(texts)
    data = whole.encode()
    n = len(whole)
    if n == len(data):
        points = np.frombuffer(data, np.uint8)
    else:
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    bounds = np.cumsum([0, *map(len, texts)])
    if not n:
        return data, np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    kind = character_classes()[points]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    starts = first[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(starts)
    end = np.append(run[1:], n)
    of = kind[run]
    inner = ~first[end]  # runs that another one of their text follows
    # white space gives its last character to what follows: as part of the word, if it is a space
    after = end[(of == SPACE) & inner]
    starts[after - 1] = True
    starts[after[points[after - 1] == 0x20]] = False
    # an apostrophe alone that begins a word, and letters
    at = np.flatnonzero((of == OTHER) & (end - run == 1) & inner)
    at = at[(points[run[at]] == 0x27) & (of[np.minimum(at + 1, len(of) - 1)] == LETTER)]
    at = at[starts[run[at]]]
    p, stop = run[at], end[at + 1]
    a = points[p + 1]
    b = np.where(p + 2 < stop, points[np.minimum(p + 2, n - 1)], 0)
    size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
    size[(b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))] = 2
    p, stop, size = p[size > 0], stop[size > 0], size[size > 0]
    starts[p + 1] = False
    rest = p + 1 + size
    starts[rest[rest < stop]] = True
    word = np.flatnonzero(starts)
    counts = np.diff(np.searchsorted(word, bounds))
    if n != len(data):
        wide = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=wide[1:])
        word = wide[word]
    return data, word, counts


def word_keys(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A key of each word, never 0: made of its bytes, 8 at a time, and its length."""
    room = np.zeros(len(data) + GRAM, np.uint8)
    room[: len(data)] = np.frombuffer(data, np.uint8)
    grams = np.ndarray((len(data) + 1,), "<u8", room, 0, (1,)).astype(np.uint64)
    size = end - start
    key = mix((grams[start] & MASKS[np.minimum(size, GRAM)]) + size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    more, done = np.flatnonzero((size > GRAM) & (size <= LONG_BYTES)), GRAM
    while len(more):
        left = size[more] - done
        key[more] = mix(key[more] * np.uint64(0xD6E8FEB86659FD93) + (grams[start[more] + done] & MASKS[np.minimum(left, GRAM)]))
        more, done = more[left > GRAM], done + GRAM
    for i in np.flatnonzero(size > LONG_BYTES).tolist():
        key[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    key[key == 0] = 1
    return key


class WordTable:
    """Ids of words by their keys, in open addressing; emptied when it is half full."""

    def __init__(self):
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at, self.n = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool = np.empty(1 << 16, np.uint32)
        self.words = self.used = 0

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = (key & np.uint64(SLOTS - 1)).astype(np.int64)
        there = self.keys[slot]
        todo = np.flatnonzero((there != key) & (there != 0))
        for _ in range(PROBES):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
            there = self.keys[slot[todo]]
            todo = todo[(there != key[todo]) & (there != 0)]
        slot[self.keys[slot] != key] = -1
        return slot

    def room(self) -> None:
        """Empties a table that is too full."""
        if 2 * self.words > SLOTS or self.used > POOL:
            self.keys[:] = 0
            self.pool = np.empty(1 << 16, np.uint32)
            self.words = self.used = 0

    def add(self, key: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Takes in distinct new words; the places of their ids in the pool. A word without a free slot is not found later."""
        if self.used + len(ids) > len(self.pool):
            bigger = np.empty(2 * (self.used + len(ids)), np.uint32)
            bigger[: self.used] = self.pool[: self.used]
            self.pool = bigger
        self.pool[self.used : self.used + len(ids)] = ids
        place = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        slot, left = (key & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(key))
        for _ in range(PROBES):
            s = slot[left]
            free = self.keys[s] == 0
            s, new = s[free], left[free]
            self.keys[s] = key[new]  # of several words that want a slot one has it
            won = self.keys[s] == key[new]
            self.at[s[won]], self.n[s[won]] = place[new[won]], counts[new[won]]
            self.words += int(won.sum())
            placed = np.zeros(len(key), bool)
            placed[new[won]] = True
            left = left[~placed[left]]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        return place


def gathered(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs pool[at : at + n], one after the other."""
    total = int(n.sum())
    return pool[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(total)]


def byte_letters() -> dict[int, str]:
    """Fixed values of the format: the printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary of a public tokenizer file; ``learn`` gives (ids, ids in each) of words that the table lacks."""

    def __init__(self, path: str, learn: Callable | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        left, right, made = [], [], []
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), np.array(made, np.int64)[order]
        self.of_rank = np.argsort(order)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        top = max([*vocab.values(), *self.special.values()]) + 1
        token_bytes = [b""] * top
        for s, i in vocab.items():
            token_bytes[i] = bytes(back[c] for c in s) if s not in self.special else s.encode()
        for s, i in self.special.items():
            token_bytes[i] = s.encode()
        self.token_sizes = np.array(list(map(len, token_bytes)), np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_pool = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.splitter = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.learn = learn or self.merge_words
        self.table = WordTable()

    def _pairs(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the sorted pair keys, whether it is there)."""
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return at, self.keys[at] == pair

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """One long word's symbols merged rank by rank; after each, only the pairs that it made are looked up."""
        n = len(sym)
        sym, alive = sym.copy(), np.ones(n, bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        found: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look_up(pos: np.ndarray) -> None:
            pos = pos[after[pos] < n]
            at, hit = self._pairs(sym[pos] << 32 | sym[after[pos]])
            pos, rank = pos[hit], self.ranks[at[hit]]
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1)).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(rank)], strict=False):
                r = int(rank[lo])
                if r not in found:
                    found[r] = []
                    heappush(heap, r)
                found[r].append(pos[lo:hi])

        look_up(np.arange(n))
        while heap:
            r = heappop(heap)
            k = self.of_rank[r]
            a, b = divmod(int(self.keys[k]), 1 << 32)
            pos = np.unique(np.concatenate(found.pop(r)))
            nxt = np.minimum(after[pos], n - 1)
            pos = pos[alive[pos] & (after[pos] < n) & (sym[pos] == a) & (sym[nxt] == b)]
            if a == b and len(pos) > 1:  # every other one of a run of overlapping pairs, from the left
                pos = pos[_alternate(np.append(True, pos[1:] != after[pos[:-1]]))]
            gone = after[pos]
            sym[pos] = self.made[k]
            alive[gone] = False
            far = after[gone]
            after[pos] = far
            before[far[far < n]] = pos[far < n]
            prior = before[pos]
            look_up(np.unique(np.concatenate([pos, prior[prior >= 0]])))
        return sym[alive]

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, ids in each word)."""
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        if len(lengths) and lengths.max() > LONG:
            ends = np.cumsum(lengths)
            for i in np.flatnonzero(lengths > LONG).tolist():
                ids = self.merge_long(sym[ends[i] - lengths[i] : ends[i]])
                done_sym.append(ids)
                done_word.append(np.full(len(ids), i))
            short = lengths[word] <= LONG
            sym, word = sym[short], word[short]
        none = np.iinfo(np.int64).max
        while len(sym):
            at, hit = self._pairs(sym[:-1] << 32 | sym[1:])
            hit &= word[:-1] == word[1:]
            rank = np.where(hit, self.ranks[at], none)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(np.append(rank, none), starts)
            best_here = np.repeat(best, np.diff(np.append(starts, len(word))))
            chosen = np.flatnonzero((rank == best_here[:-1]) & hit)
            if len(chosen) > 1:
                chosen = chosen[_alternate(np.diff(chosen, prepend=-2) != 1)]
            sym = sym.copy()
            sym[chosen] = self.made[at[chosen]]
            keep = np.ones(len(sym), bool)
            keep[chosen + 1] = False
            finished = best_here == none
            done_sym.append(sym[finished])
            done_word.append(word[finished])
            keep &= ~finished
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.empty(0, np.int64), lengths
        ids, owner = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, start, words = split_words(texts)
        end = np.append(start[1:], len(data))[: len(start)]
        key = word_keys(data, start, end)
        self.table.room()
        slot = self.table.find(key)
        at, n = self.table.at[slot], self.table.n[slot]
        lacking = np.flatnonzero(slot < 0)
        if len(lacking):
            new, first, which = np.unique(key[lacking], return_index=True, return_inverse=True)
            first = lacking[first]
            spans = list(zip(start[first].tolist(), end[first].tolist(), strict=True))
            got = [self.learn([data[a:b] for a, b in spans[lo : lo + LEARN]]) for lo in range(0, len(spans), LEARN)]
            counts = np.concatenate([c for _, c in got])
            place = self.table.add(new, np.concatenate([i for i, _ in got]).astype(np.uint32), counts)
            at[lacking], n[lacking] = place[which], counts[which]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[np.cumsum(words)]
        return gathered(self.table.pool, at.astype(np.int64), n.astype(np.int64)), np.diff(ends, prepend=0)

    def encode_run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids in each text)."""
        marked = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        if not marked:
            return self._encode_plain(texts)
        parts, owner = [], []
        for i, t in enumerate(texts):
            cut = [p for p in self.splitter.split(t) if p] if i in marked else [t]
            parts += cut
            owner += [i] * len(cut)
        special = np.array([self.special.get(p, -1) for p in parts])
        ids, counts = self._encode_plain(["" if s >= 0 else p for p, s in zip(parts, special.tolist(), strict=True)])
        ends = np.cumsum(counts)
        ids = np.insert(ids, ends[special >= 0], special[special >= 0].astype(np.uint32))
        counts[special >= 0] = 1
        return ids, np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode_run(texts)
        return cut_bytes(ids.astype("<u4").tobytes(), 4 * counts)

    def decode_run(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of ids."""
        sizes = self.token_sizes[ids]
        raw = gathered(self.token_pool, self.token_starts[ids], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        return [b.decode("utf-8", "replace") for b in cut_bytes(raw, np.diff(ends, prepend=0))]

    def decode_ids(self, ids: bytes) -> str:
        return self.decode_run(np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]))[0]


def _alternate(begins: np.ndarray) -> np.ndarray:
    """Every other one of each run, the first one too; ``begins`` tells where runs begin."""
    place = np.arange(len(begins))
    return (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0


def cut_bytes(raw: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in a worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def text_runs(batch: pa.RecordBatch, at: int, size: int = RUN) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``size`` characters."""
    run, first, total = [], 0, 0
    for i, x in enumerate(batch.column(at)):
        t = x.as_py() or ""
        if run and total + len(t) > size:
            yield first, run
            run, first, total = [], i, 0
        run.append(t)
        total += len(t)
    if run:
        yield first, run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit) of every row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for first, texts in text_runs(b, 1):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(v.encode_texts(texts), pa.binary())], names=["_id", "ids"])
        release()

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(step, f"_id {src.schema['_id'].dataType.simpleString()}, ids binary").withColumnRenamed("_id", id_col)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) of every row of ids; null ids are none."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ids = [x or b"" for x in part.column(1).to_pylist()]
                texts = v.decode_run(np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["_id", "ids", "text"])

    src = coded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("ids"))
    return src.mapInArrow(step, f"_id {src.schema['_id'].dataType.simpleString()}, ids binary, text string").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text decoded from the ids) of every row: both directions in one worker."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for first, texts in text_runs(b, 1):
                ids, counts = v.encode_run(texts)
                raw = cut_bytes(ids.astype("<u4").tobytes(), 4 * counts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(raw, pa.binary()), pa.array(v.decode_run(ids, counts), pa.string())], names=["_id", "ids", "text"])
        release()

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(step, f"_id {src.schema['_id'].dataType.simpleString()}, ids binary, text string").withColumnRenamed("_id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`decode`'s rows."""
    return decoded.select(
        id_col,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
