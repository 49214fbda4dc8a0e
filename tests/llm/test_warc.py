"""Archives written and read in small splits, against plain chains and SQL."""

import glob
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from lodestone.llm import warc
from lodestone.session import overridden

SCHEMA = "page_id bigint, url string, html string, digest string, payload int, block int, file string"


def frame(spark, rows):
    """Pages with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, u, h, "d", 1, 2, "f") for i, u, h in rows], SCHEMA)


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = min((x for x in groups[body] if x is not None), default=None)
        again = len(body) >= 100 and i != first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


def plain_records(path):
    """Records of all files by following lengths from the start, in plain Python."""
    found = []
    for name in glob.glob(f"{path}/part-*"):
        raw, at = open(name, "rb").read(), 0
        while at < len(raw):
            assert raw.startswith(b"WARC/1.1\r\n", at)
            end = raw.index(b"\r\n\r\n", at)
            size = next(int(x.split(b":")[1]) for x in raw[at:end].split(b"\r\n") if x.lower().startswith(b"content-length"))
            found.append((name.rsplit("/", 1)[1], at, raw[end + 4:end + 4 + size].partition(b"\r\n\r\n")[2]))
            at = end + 4 + size
            assert raw[at:at + 4] == b"\r\n\r\n"
            at += 4
    return Counter(found)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nPage-ID: 99\r\nContent-Length: {}\r\n\r\n"
EDGES = [(1, "http://a/", None), (2, None, ""), (3, "http://b/ x\r\nWARC-Type: odd", "é" * 60), (4, "u", "é" * 60),
         (4, "u", "é" * 60), (3, "v", "é" * 60), (5, "u", "x" * 99), (6, "u", "x" * 99), (None, "u", "y" * 100),
         (7, "u", "y" * 100), (None, "u", "z" * 200), (None, "u", "z" * 200), (8, "", "\r\n\r\n" * 40),
         (9, "u", "WARC/1.1\r\n"), (10, "u", "WARC/1.1\r\n" * 200), (11, "u", FAKE.format(5) + "hello\r\n\r\n" * 30),
         (12, "u", "".join(FAKE.format(k) for k in range(60))), (13, "u", FAKE.format(10 ** 9)), (14, "u", FAKE.format(0)[:-2]),
         (15, "u", "long " * 4_000), (-16, "u", "long " * 4_000)]


@pytest.mark.parametrize("split", ["700", "100m"])
def test_round_trip(spark, split):
    rng = random.Random(3)
    rows = EDGES + [(100 + i, f"http://h/{i}", rng.choice(["copy " * 30, "other " * 40, f"page {i} " * 20, FAKE.format(i) * 3]))
                    for i in range(60)]
    with overridden(spark, "spark.sql.files.maxPartitionBytes", split):
        got = warc.round_trip(frame(spark, rows).repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


@pytest.mark.parametrize("split", ["900"])
def test_records_are_those_of_a_plain_chain(spark, tmp_path, split):
    path = f"{tmp_path}/archive"
    warc.write_archive(frame(spark, EDGES).coalesce(2), path)
    with overridden(spark, "spark.sql.files.maxPartitionBytes", split):
        got = [(r.file.rsplit("/", 1)[1], r.at, bytes(r.payload)) for r in warc.read_archive(spark, path).collect()]
        with pytest.MonkeyPatch.context() as m:
            m.setattr(warc, "BROADCAST_BYTES", 0)  # splits meet their pieces in a shuffle
            again = [(r.file.rsplit("/", 1)[1], r.at, bytes(r.payload)) for r in warc.read_archive(spark, path).collect()]
    assert Counter(got) == Counter(again) == plain_records(path)


def test_no_pages(spark, tmp_path):
    assert warc.round_trip(frame(spark, EDGES).limit(0)).collect() == []
    named = spark.createDataFrame([("b c\n", "u", "t" * 100), ("a", "u", "t" * 100), ("", "u", "s")], "page_id string, url string, html string")
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(named).collect()} \
        == {("a", "response", None), ("b c\n", "revisit", "a"), ("", "response", None)}


def test_broken_files(spark, tmp_path):
    good = FAKE.format(3) + "abc\r\n\r\n"
    (tmp_path / "cut").write_bytes((good + good + FAKE.format(50) + "short").encode())
    (tmp_path / "garbage").write_bytes(("x" + good).encode())
    (tmp_path / "empty").write_bytes(b"")
    found = warc.read_archive(spark, str(tmp_path)).collect()
    assert [(r.file.rsplit("/", 1)[1], r.at, bytes(r.payload)) for r in sorted(found, key=lambda r: r.at)] \
        == [("cut", 0, b"abc"), ("cut", len(good), b"abc")]


def test_pointer_jumping(spark):
    steps = [(f, a, a + 1, "x") for f in ("p", "q") for a in range(37) if (f, a) != ("q", 20)]
    steps += [("p", 100 + a, 5 + a, "x") for a in range(20)] + [("q", 50, -1, "x"), ("r", 3, 4, "x")]
    entries = spark.createDataFrame(steps, "file string, at bigint, leaves bigint, last string")
    got = {(r.file, r.at) for r in warc.reachable(entries).collect()}
    assert got == {("p", a) for a in range(37)} | {("q", a) for a in range(20)}


def test_every_query_without_sql_is_known():
    import __spark_entry__ as entry
    from lodestone.llm import queries
    without = {"op1_quality", "op2_personal_data", "op3_score_texts", "op4_fuzzy_lines", "op5_near_duplicates", "op6_language",
               "op8_repeated_passages", "op11_whiten"}
    assert set(queries.QUERIES) - set(entry.oracle_sql()) == without
