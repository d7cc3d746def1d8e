"""Mixing, Ogg media and URL rules against brute force; hostile tables."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from entityframe.llm import common, media_ogg, mixing, url_rules
from entityframe.llm.queries import URL_RULES, op3_ogg_media

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_apportion_equals_highest_quotients():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        claims, most = [float(c) for c in rng.integers(0, 50, n)], rng.integers(0, 40, n).tolist()
        seats, got = int(rng.integers(0, 120)), [0] * n
        for _ in range(seats):
            free = [i for i in range(n) if claims[i] > 0 and got[i] < most[i]]
            if not free:
                break
            got[max(free, key=lambda i: (Fraction(claims[i]) / (2 * got[i] + 1), -i))] += 1
        assert mixing.apportion(claims, seats, most) == got


def test_targets_stop_at_twice_the_source():
    got = mixing.targets({"b": 100, "a": 10, None: 50, "c": 1000})
    assert got["a"] == 20 and all(got[s] <= 2 * n for s, n in {"b": 100, "a": 10, None: 50, "c": 1000}.items())
    assert sum(got.values()) == pytest.approx(1.5 * 1160)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def mix_rows(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 90))), ["s1", "s2", "z", None][int(i % 7 % 4)]) for i in range(1500)]
    return [*rows, (2000, None, "s1"), (2001, "", "empty"), (2002, "\u00a0x\t\x0by\x0c", "s2"), (None, "no id", "z"), (1, rows[1][1], "s2"), (1, rows[1][1], "s2"), (2003, "long " * 200_000, "z")]


def test_mix_meets_targets(spark, monkeypatch):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS _size", "2 AS _taken", "'x' AS _source").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    by_source, src_of = {}, {}
    for i, t, s in rows:
        by_source[s] = by_source.get(s, 0) + size(t)
        src_of[i] = s
    goal = mixing.targets(by_source)
    taken = dict.fromkeys(by_source, 0)
    for r in got:
        s = src_of[r._id]
        assert 0 <= r._taken <= 2 * r._size and r._source_size == by_source[s] and r._target == pytest.approx(goal[s])
        taken[s] += r._taken
    assert sorted(r._size for r in got) == sorted(size(t) for _, t, _ in rows)
    for s, n in taken.items():
        assert abs(n - goal[s]) <= 0.02 * goal[s] + mixing.BLOCK * mixing.SHARDS
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    whole = mixing.apply(df)
    assert whole.columns == df.columns and whole.count() > 0
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.apply(df.limit(0)).collect() == []


def test_mix_keeps_what_it_takes_of_few_documents(spark):
    """Most cells hold one document, whose share must not be rounded the same way in all."""
    df = spark.createDataFrame([(i, " ".join([f"w{i}"] * 96), s) for i in range(60) for s in ("a", "b", "c")], "doc_id long, text string, source string")
    kept = {r["source"]: r["count"] for r in mixing.apply(df).groupBy("source").count().collect()}
    for s, n in mixing.targets({s: 60 * 96 for s in "abc"}).items():
        assert abs(kept[s] - n / 96) <= 2, s


def slow_checksum(page):
    c = 0
    for b in page:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
    return c


def test_page_checksum_bit_by_bit():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 300):
        page = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert media_ogg.page_checksum(page) == slow_checksum(page)


def test_media_column_is_written(spark, monkeypatch):
    written = []
    stored = common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: written.append(stored(df, name)) or written[-1])
    got = op3_ogg_media(spark, "/root/testdata/sf0.001").collect()
    assert [t.columns for t in written] == [["doc_id", "n_bytes", "media"]]
    kept = {r.doc_id: r.media for r in written[0].collect()}
    assert {r.doc_id: r.media_bytes for r in got} == {i: len(m) for i, m in kept.items()}


@pytest.mark.parametrize("n", [64, 4096, 4160, 255 * 64, 8192, 300_032])
def test_ogg_round_trip_and_timestamps(n):
    payload = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    data = media_ogg.encode(payload)
    back, audio, streams = media_ogg.decode(data)
    assert back == payload and streams == 2
    stamps = media_ogg.timestamps(audio)
    assert stamps == [(i, min(n, i * media_ogg.PACKET) / media_ogg.RATE) for i in range(len(audio.packets))]
    for at in (0, 5, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            media_ogg.demux(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_lacing_of_packets_at_the_limits():
    packets = [b"h", b"", b"a" * 254, b"b" * 255, b"c" * 256, b"d" * 510, b"e" * 70_000, b"f" * (255 * 255), b"g" * (255 * 255 - 1), b"z"]
    pages = media_ogg.pages_of(9, packets, list(range(len(packets))))
    s = media_ogg.demux(b"".join(pages))[9]
    assert s.packets == packets and s.ended and all(len(p) <= 27 + 255 + 255 * 255 for p in pages)
    with pytest.raises(ValueError):
        media_ogg.demux(b"".join(pages[:2] + pages[3:]))
    with pytest.raises(ValueError):
        media_ogg.demux(b"".join(pages[:-1]))


def test_media_rows(spark):
    texts = [(1, "abc"), (2, None), (3, ""), (4, "é" * 32), (5, "x" * 2_000_000), (5, "abc"), (None, "abc")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes", "3 AS _id")
    got = media_ogg.read_media(media_ogg.write_media(df)).collect()
    assert len(got) == len(texts)
    left = {(i, len((t or "").encode())): (t or "").encode() for i, t in texts}
    for r in got:
        raw = left[r.doc_id, r.n_bytes]
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media_ogg.encode(payload)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert len({r.feature for r in got if r.n_bytes == 3}) == 1
    assert media_ogg.read_media(media_ogg.write_media(df.limit(0))).collect() == []


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = ["https://Example.COM/en/7x?q#f", "http://a.example.com/en/70", "x://com/en/", "x://notcom/en/", "x://com?en", "x://b.net/de/", "x://example.net/de/81", "x://example.net/de/7", "x://a.b.org/es/#z", "x://org", "x://", "://com/en/", "no scheme", "", None, "x://com/en", "a://b://com/en/", "x://é.com/en/ü", "x://.com/en/", "x://com./en/", "x://a..com/en/", "x://org/es/" + "y" * 200_000]


def test_url_verdicts(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "CHUNK", 7)
    rng = np.random.default_rng(4)
    part = ["com", "net", "example.com", "a.example.com", "org", "b.org", "a.b.org"]
    paths = ["", "/", "/en/", "/en/7", "/en/71", "/de/8", "/e", "/es/"]
    made = [f"h://{part[rng.integers(7)]}{paths[rng.integers(8)]}{rng.integers(100)}" for _ in range(400)] + ["h://hot.example.com/en/7"] * 300
    urls = URLS + made
    more = [(part[rng.integers(7)], paths[rng.integers(8)], ["allow", "block"][rng.integers(2)]) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS _key", "4 AS rule").repartition(3)
    for rules in (list(URL_RULES), more, more + more[:3]):
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, table).collect()}
        assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}


def test_url_empty_tables_and_nulls(spark):
    rules = spark.createDataFrame([("com", None, "block"), (None, "/", "block"), ("net", "/", None)], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "x://a.com/z"), (None, "x://net/"), (1, "x://a.com/z")], "page_id long, url string")
    got = sorted((r.page_id or 0, r.rule, r.verdict) for r in url_rules.judge(df, rules).collect())
    assert got == [(0, None, "allow"), (1, "com", "block"), (1, "com", "block")]
    assert url_rules.judge(df.limit(0), rules).collect() == []
    assert {r.verdict for r in url_rules.judge(df, rules.limit(0), default="block").collect()} == {"block"}
