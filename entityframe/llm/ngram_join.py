"""N-gram Jaccard join by filters under several global orders of the shingles.

If two sets are similar enough, they share a shingle among the first few of each, whatever
the global order, and from the first one on have enough left to share. The first order (estimated frequency, then a hash) deals documents to
buckets; a pair of a bucket goes on to verification only if it also shares a prefix
shingle under each of the other orders (other hashes within frequency classes, and a hash
alone). Frequencies come from a table of fixed size that counts every shingle of every
document: it sets the order only, so its errors cost time and not links.

Documents of equal sets are one class, known by a hash of its set, with one whole set.
Links are found without all pairs of a bucket: in a few rounds each bucket's members meet
one member, and linked classes become one component. Members of buckets that then hold
several components are dealt to buckets anew, under one more order, that of their shingles'
exact counts among these members: passages that many share go last, however full the table
of frequencies is. There pairs of different components are verified whole. The result is
components and not links: pairs within a component are left out, so most links of a group
of near copies are never found.
Components grow by label spreading with pointer jumping, each round written to the shared
folder.

Defined results: texts that are null or have no word are linked with nothing; texts of fewer
than ``k`` words have one shingle; repeated rows are linked, one id may have several texts;
ties don't exist; null ids stay null, and are nobody's component unless all ids of it are
null, but their texts link others; an empty table gives an empty one; other columns don't
matter. Sets are compared by 64-bit hashes of shingles, rows known by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, release, shingle_sets, stored, text_batches

#: Largest frequency table (2**27 cells of 2 bits: 32 MB as broadcast), and cells of one slice of it; text bytes for each cell.
MAX_CELL_BITS, SLICE_BITS, CELL_BYTES = 27, 16, 8
#: Orders beside the first; rounds of one-member meetings; members of a bucket that meet at once; shingles counted at once.
MORE_ORDERS, ROUNDS, SMALL, COUNTED = 2, 3, 8, 700_000
#: A word of the contract's alphabet.
WORD = r"[^\x20\x09-\x0D]"


def gaps_of(cells: np.ndarray) -> bytes:
    """Sorted cells of a slice as bytes: each a gap to the one before, 255 for 255 cells skipped."""
    gap = np.diff(cells, prepend=0)
    out = np.full(len(gap) + int((gap // 255).sum()), 255, np.uint8)
    out[np.cumsum(gap // 255 + 1) - 1] = gap % 255
    return out.tobytes()


def cells_of(gaps: bytes) -> np.ndarray:
    g = np.frombuffer(gaps, np.uint8)
    return np.cumsum(g, dtype=np.int64)[g < 255]


def frequency_table(docs: DataFrame, k: int, text_col: str = "text") -> np.ndarray:
    """Classes of the counts of the table's cells, four to a byte, over all shingles of all documents.

    The classes part once-met, twice-met, common and very common cells, relative to the mean count. The table grows
    with the texts up to 2**MAX_CELL_BITS cells.
    """
    total_bytes = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).collect()[0]["n"] or 0
    bits = min(MAX_CELL_BITS, max(SLICE_BITS, int(total_bytes // CELL_BYTES).bit_length()))
    mean = total_bytes / 7 / (1 << bits)
    limits = np.array([max(1, mean), max(2, 1.5 * mean), max(24, 4 * mean)])

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, 1 << SLICE_BITS))
        used = np.flatnonzero(np.diff(cuts))
        parts = [gaps_of(cells[cuts[i] : cuts[i + 1]] - (i << SLICE_BITS)) for i in used.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(parts, pa.binary())], names=["slice", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for _, texts in text_batches(batches, "_text"):
            found += shingle_sets(texts, k)
            n += sum(map(len, found[-len(texts) :]))
            if n >= COUNTED:
                yield packed(found)
                found, n = [], 0
        if n:
            yield packed(found)
        release()

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << SLICE_BITS, np.int64)
        for b in batches:
            for raw in b.column(1):
                out += np.bincount(cells_of(raw.as_py()), minlength=1 << SLICE_BITS)
        c = np.searchsorted(limits, out).astype(np.uint8).reshape(-1, 4)
        packed = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=["slice", "cells"])

    kinds = "slice int, cells binary"
    got = docs.select(F.col(text_col).cast("binary").alias("_text")).mapInArrow(count, kinds).groupBy("slice").applyInArrow(total, kinds)
    out = np.zeros(1 << (bits - 2), np.uint8)
    size = 1 << (SLICE_BITS - 2)
    for r in got.collect():
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["cells"], np.uint8)
    return out


def class_of(shingles: np.ndarray, table: np.ndarray) -> np.ndarray:
    cell = shingles >> np.uint64(63 - len(table).bit_length())
    return table[(cell >> np.uint64(2)).astype(np.int64)] >> (2 * (cell & np.uint64(3))).astype(np.uint8) & 3


def prefix(shingles: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first shingles of a set under an order, as many as a similar set cannot all lack."""
    n = len(shingles)
    p = n - (percent * n + 99) // 100 + 1
    place = mix(shingles, 11 + order)
    if order < MORE_ORDERS:  # the last order is a hash alone
        place = (class_of(shingles, classes).astype(np.uint64) << np.uint64(56)) | (place >> np.uint64(8))
    first = np.argpartition(place, p - 1)[:p] if p < n else np.arange(n)
    return shingles[first[np.argsort(place[first])]]


def set_key(shingles: np.ndarray) -> int:
    """A hash of the whole set."""
    return int(mix(np.array([shingles.sum(dtype=np.uint64) ^ np.uint64(len(shingles)), np.bitwise_xor.reduce(mix(shingles, 3))]), 5).sum(dtype=np.uint64).astype(np.int64))


def _fits(percent: int) -> Column:
    """Whether the sizes (_n, _rn) allow the similarity, and what is left of the sets from the common shingle on (_m, _rm).

    The second test holds at a linked pair's first common shingle, and the pair meets there too.
    """
    by_size = (F.col("_n") * 100 >= F.col("_rn") * percent) & (F.col("_rn") * 100 >= F.col("_n") * percent)
    return by_size & (F.least("_m", "_rm") * (100 + percent) >= (F.col("_n") + F.col("_rn")) * percent)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.uint64)
    flat = flat.view(np.int64) if kind == pa.int64() else (flat >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def connected(links: DataFrame) -> DataFrame:
    """(_node, _label: the least node of its component) of all nodes of the links (_a, _b)."""
    both = stored(links.select(F.col("_a").alias("_node"), F.col("_b").alias("_other")).union(links.select(F.col("_b").alias("_node"), F.col("_a").alias("_other"))).distinct(), "links")
    label = stored(both.groupBy("_node").agg(F.least("_node", F.min("_other")).alias("_label")), "labels")
    while True:
        other = label.select(F.col("_node").alias("_other"), F.col("_label").alias("_theirs"))
        near = both.join(other, "_other").groupBy("_node").agg(F.min("_theirs").alias("_near"))
        lower = label.join(near, "_node").select("_node", F.least("_label", "_near").alias("_mid"), F.col("_label").alias("_old"))
        jump = label.select(F.col("_node").alias("_mid"), F.col("_label").alias("_far"))
        nxt = stored(lower.join(jump, "_mid").select("_node", F.least("_mid", "_far").alias("_label"), "_old"), "labels")
        discard(label)
        label = nxt
        if nxt.where("_label < _old").isEmpty():
            discard(both)
            return nxt


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with _ra and _rb, two hashes of id and text: rows equal in both are one."""
    return docs.withColumns({"_ra": F.xxhash64(F.lit(1), id_col, text_col), "_rb": F.xxhash64(F.lit(2), text_col, id_col)})


def classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((_id, _n, _key) of every row, (_key, _first, _comp) of every class): the least row of the class, the component as one of its keys.

    ``_first`` is (no id, id, row key): rows without an id come last.
    """
    src = with_row_key(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")), "_id", "_text")
    kind = src.schema["_id"].dataType.simpleString()
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast(frequency_table(docs, k, text_col))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_batches(batches, "_text"):
            sets = shingle_sets(texts, k)
            keys = [set_key(s) if len(s) else None for s in sets]
            first = [prefix(s, broadcast.value, 0, percent) if len(s) else s for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), _lists(first, pa.int64())], names=["_id", "_ra", "_rb", "_n", "_key", "_prefix"])
        release()

    described = stored(src.mapInArrow(describe, f"_id {kind}, _ra long, _rb long, _n long, _key long, _prefix array<long>"), "join-sets")
    first = F.min(F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("i"), F.col("_ra").alias("a"), F.col("_rb").alias("b"))).alias("_first")
    with_prefix = stored(described.where("_key IS NOT NULL").groupBy("_key", "_n").agg(first, F.count(F.lit(1)).alias("_copies"), F.first("_prefix").alias("_prefix")), "join-classes")
    rows = stored(described.select("_id", "_n", "_key"), "join-rows")
    discard(described)
    kinds = with_prefix

    # buckets of the first order that hold two classes at least
    dealt = kinds.select("_key", "_n", "_copies", F.posexplode("_prefix").alias("_at", "_t"))
    often = dealt.groupBy("_t").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    shared = stored(dealt.join(often, "_t").select("_t", "_key", "_n", (F.col("_n") - F.col("_at")).alias("_m"), "_copies", F.col("_key").alias("_comp"), "_size"), "join-shared")
    kinds = stored(kinds.select("_key", "_first"), "join-classes")
    discard(with_prefix)
    used = [shared, kinds]

    # the other orders' prefixes (32 bits of each: more pairs may pass, none is lost) and the whole set of each class in buckets, once
    met = shared.select("_key").distinct().join(kinds, "_key").select(F.col("_first.a").alias("_ra"), F.col("_first.b").alias("_rb"), F.col("_key").alias("_wanted"))
    fetched = src.select("_ra", "_rb", "_text").join(met, ["_ra", "_rb"]).groupBy("_ra", "_rb").agg(F.first("_wanted").alias("_wanted"), F.first("_text").alias("_text"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_batches(batches, "_text"):
            sets = shingle_sets(texts, k)
            same = [i for i, (s, w) in enumerate(zip(sets, b.column(0).to_pylist(), strict=True)) if len(s) and set_key(s) == w]
            sets = [sets[i] for i in same]
            others = [_lists([prefix(s, broadcast.value, o, percent) for s in sets], pa.int32()) for o in range(1, MORE_ORDERS + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), *others, _lists(sets, pa.int64())], names=names)
        release()

    names = ["_key", *(f"_p{o}" for o in range(1, MORE_ORDERS + 1)), "_set"]
    table = ", ".join(["_key long", *(f"_p{o} array<int>" for o in range(1, MORE_ORDERS + 1)), "_set array<long>"])
    sets = stored(fetched.select("_wanted", "_text").mapInArrow(spread, table), "join-whole-sets")
    used.append(sets)

    def side(name: str, columns: list[str]) -> DataFrame:
        return sets.select(F.col("_key").alias(name), *(F.col(c).alias(name + c) for c in columns))

    orders = [f"_p{o}" for o in range(1, MORE_ORDERS + 1)]

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (_a, _b) that link, by the other orders' filters and then the whole sets."""
        likely = pairs.join(side("_a", orders), "_a").join(side("_b", orders), "_b")
        for o in orders:
            likely = likely.where(F.arrays_overlap("_a" + o, "_b" + o))
        likely = stored(likely.select("_a", "_b").distinct(), "join-candidates")
        used.append(likely)
        whole = likely.join(side("_a", ["_set"]), "_a").join(side("_b", ["_set"]), "_b")
        common = F.size(F.array_intersect("_a_set", "_b_set"))
        return whole.where(common * 100 >= (F.size("_a_set") + F.size("_b_set") - common) * percent).select("_a", "_b")

    all_links: list[DataFrame] = []

    def joined(buckets: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
        """The buckets after the components that the links (of classes) join have become one; whether any were joined."""
        all_links.append(stored(links, "join-links"))
        between = stored(component_links(all_links[-1], buckets), "join-components")
        used.append(between)
        if between.isEmpty():
            return buckets, False
        labels = connected(between)
        used.append(labels)
        new = labels.select(F.col("_node").alias("_comp"), F.col("_label"))
        moved = buckets.join(new, "_comp", "left").select("_t", "_key", "_n", "_m", "_copies", F.coalesce("_label", "_comp").alias("_comp"))
        after = stored(moved, "join-buckets")
        discard(buckets)
        return after, True

    def pairs_of(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs (_a, _b) of different components in a bucket whose sizes fit, with the components (_ca, _cb)."""
        r = right.select("_t", F.col("_key").alias("_rk"), F.col("_n").alias("_rn"), F.col("_m").alias("_rm"), F.col("_comp").alias("_rc"))
        both = left.join(r, "_t").where((F.col("_comp") != F.col("_rc")) & _fits(percent))
        up = F.col("_key") < F.col("_rk")
        return both.select(F.when(up, F.col("_key")).otherwise(F.col("_rk")).alias("_a"), F.when(up, F.col("_rk")).otherwise(F.col("_key")).alias("_b")).distinct()

    def component_links(links: DataFrame, buckets: DataFrame) -> DataFrame:
        of = buckets.select("_key", "_comp").distinct()
        a, b = (of.select(F.col("_key").alias(x), F.col("_comp").alias(x + "c")) for x in ("_a", "_b"))
        return links.join(a, "_a").join(b, "_b").where("_ac != _bc").select(F.col("_ac").alias("_a"), F.col("_bc").alias("_b")).distinct()

    # buckets of few members: all their pairs at once; larger ones start with the components that these links make
    small = shared.where(F.col("_size") <= SMALL)
    all_links.append(stored(verified(pairs_of(small, small)), "join-links"))
    large = shared.where(F.col("_size") > SMALL)
    labels = connected(all_links[0])
    used.append(labels)
    known = labels.select(F.col("_node").alias("_key"), F.col("_label"))
    buckets = stored(large.join(known, "_key", "left").select("_t", "_key", "_n", "_m", "_copies", F.coalesce("_label", "_comp").alias("_comp")), "join-buckets")
    for r in range(ROUNDS):
        open_ones = buckets.groupBy("_t").agg(F.max_by(F.struct("_key", "_n", "_m", "_comp"), F.struct(F.col("_copies") if r == 0 else F.lit(0), F.xxhash64(F.lit(r), "_key"))).alias("_one"), F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).where("_lo < _hi")
        member = open_ones.select("_t", "_one._key", "_one._n", "_one._m", "_one._comp")
        buckets, any_link = joined(buckets, verified(pairs_of(buckets, member)))
        if not any_link:
            break
    # what is left, members of buckets with several components, is dealt anew, under the order of exact counts among them
    left = buckets.groupBy("_t").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).where("_lo < _hi").select("_t")
    members = stored(buckets.join(left, "_t").groupBy("_key").agg(F.max("_n").alias("_n"), F.max("_comp").alias("_comp")), "join-members")
    used.append(members)
    if not members.isEmpty():
        spelled = sets.join(members.select("_key"), "_key").select("_key", F.explode("_set").alias("_t"))
        often = spelled.groupBy("_t").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
        ranked = spelled.join(often, "_t").groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_df", F.xxhash64("_t").alias("_h"), "_t"))).alias("_often"))
        # shingles that nobody else has come first; they only take up places of the prefix
        alone = F.col("_n") - F.size("_often")
        length = F.col("_n") - F.ceil(F.col("_n") * percent / 100) + 1
        first = members.join(ranked, "_key").select("_key", "_n", "_comp", alone.alias("_alone"), F.slice("_often", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int")).alias("_first"))
        exact = first.select("_key", "_n", "_comp", "_alone", F.posexplode("_first").alias("_at", "_o"))
        exact = stored(exact.select(F.col("_o._t").alias("_t"), "_key", "_n", (F.col("_n") - F.col("_alone") - F.col("_at")).alias("_m"), "_comp"), "join-exact")
        used.append(exact)
        # in each bucket, the members outside its largest component meet all
        sizes = exact.groupBy("_t", "_comp").agg(F.count(F.lit(1)).alias("_size")).groupBy("_t").agg(F.max_by("_comp", F.struct("_size", "_comp")).alias("_major"), F.count(F.lit(1)).alias("_comps")).where("_comps > 1")
        minor = exact.join(sizes, "_t").where("_comp != _major").select("_t", "_key", "_n", "_m", "_comp")
        all_links.append(stored(verified(pairs_of(minor, exact)), "join-links"))

    every = all_links[0]
    for links in all_links[1:]:
        every = every.unionByName(links)
    labels = connected(every)
    comp = labels.select(F.col("_node").alias("_key"), F.col("_label").alias("_comp"))
    found = stored(kinds.join(comp, "_key", "left").select("_key", "_first", F.coalesce("_comp", "_key").alias("_comp")), "join-found")
    discard(*used, *all_links, buckets, labels)
    return rows, found


def components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id: the least id that links reach) of every row; sets link at Jaccard ``percent`` / 100."""
    rows, found = classes(docs, k, percent, id_col, text_col)
    least = found.groupBy("_comp").agg(F.min("_first").alias("_least"))
    of_class = found.select("_key", "_comp").join(least, "_comp").select("_key", F.col("_least.i").alias("_component"))
    out = rows.join(of_class, "_key", "left")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("_component", "_id").alias("component_id"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of least id (rows without an id last), then of least row hash. Texts without a word stay.

    Rows equal in id and text are one, whatever their other columns hold.
    """
    _, found = classes(docs, k, percent, id_col, text_col)
    least = found.groupBy("_comp").agg(F.min("_first").alias("_least")).select(F.col("_least.a").alias("_ra"), F.col("_least.b").alias("_rb"))
    has_word = F.coalesce(F.col(text_col).cast("string").rlike(WORD), F.lit(False))
    # the key is taken of the same columns as in classes()
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), has_word.alias("_has_word"))
    one = with_row_key(keyed.where("_has_word"), "_id", "_text").select("_row", "_ra", "_rb").join(least, ["_ra", "_rb"]).groupBy("_ra", "_rb").agg(F.first("_row").alias("_row"))
    return one.select("_row.*").unionByName(keyed.where("NOT _has_word").select("_row.*"))
