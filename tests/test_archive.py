import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemill.operators import archive as A
from tidemill.sources import objectstore

SCHEMA = "object_id bigint, bucket string, object_key string, size_bytes bigint, body binary, block string, entries int"


def line(rid, n=26, end=b"\n"):
    cells = [b"x"] * n
    if n > 14:
        cells[14] = rid
    return b"\t".join(cells) + end


@pytest.fixture
def objects(spark):
    big = b"".join(line(b"big%d" % i) for i in range(2000))
    bodies = [
        gzip.compress(b"#Version\n" + line(b"a") + line(b"b")),
        A.gzip_members(b"#Fields\r\n" + line(b"b", end=b"\r\n"), line(b"c")),
        b"  # comment\n\n \t\n" + line(b"d").rstrip(b"\n"),
        b"",
        None,
        gzip.compress(b"#Version\n" + line(b"a") + line(b"b")),  # the same bytes again
        big,
        line(b"short", n=5),
        b"\xef\xbb\xbf" + line(b"e", end=b"\r") + line(b"f", end=b"\r"),
        gzip.compress(line(b"g") * 50)[:-12],  # broken off
    ]
    rows = [(i + 1, "bkt", f"k{i}" if i != 5 else "k0", None if b is None else len(b), b, "clash", 7) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), bodies


def test_records_and_owners(spark, objects, tmp_path):
    df, _ = objects
    arc = A.pack_objects(df, str(tmp_path / "arc"), block_bytes=4096)
    owners = {r["request_id"]: r["object_id"] for r in A.record_owners(arc).collect()}
    assert {k: owners[k] for k in "abcdef"} == {"a": 1, "b": 1, "c": 2, "d": 3, "e": 9, "f": 9}
    assert owners["big7"] == 7 and "short" not in owners and owners["g"] == 10
    assert len(owners) == 2000 + 7


def test_bytes_come_back(spark, objects, tmp_path):
    df, bodies = objects
    arc = A.pack_objects(df, str(tmp_path / "arc"), block_bytes=4096)
    back = {r["object_id"]: r for r in A.archive_bodies(arc).collect()}
    assert len(back) == len(bodies)
    for i, b in enumerate(bodies):
        r = back[i + 1]
        if b is None:
            assert r["body"] is None and r["length"] is None and r["intact"] is None
        else:
            assert bytes(r["body"]) == b and r["intact"] and r["sha256"] == hashlib.sha256(b).hexdigest()


def test_lookup_and_index(spark, objects, tmp_path):
    df, bodies = objects
    arc = A.pack_objects(df, str(tmp_path / "arc"))
    got = A.archive_bodies(arc, spark.createDataFrame([("bkt", "k2"), ("bkt", "none")], "bucket string, object_key string")).collect()
    assert [bytes(r["body"]) for r in got] == [bodies[2]]
    index = A.archive_index(arc)
    assert index.count() == len(bodies) and "block" not in index.columns
    assert "block:" not in index._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_lookup_reads_the_index_first(spark, objects, tmp_path, monkeypatch):
    """No block is shuffled for keys in bounded number; beyond it the same rows come out of a join."""
    df, bodies = objects
    arc = A.pack_objects(df, str(tmp_path / "arc"), block_bytes=64)
    keys = spark.createDataFrame([("bkt", "k2"), ("bkt", "k1"), (None, None)], "bucket string, object_key string")
    found = A.archive_bodies(arc, keys)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "PushedFilters: [" in plan and "block_id" in plan.split("PushedFilters: [")[1]
    want = sorted((r["object_id"], bytes(r["body"] or b"")) for r in found.collect())
    assert len(want) >= 2
    monkeypatch.setattr(A, "FEW_BLOCKS", 0)
    monkeypatch.setattr(A, "SOME_ENTRIES", 0)
    assert sorted((r["object_id"], bytes(r["body"] or b"")) for r in A.archive_bodies(arc, keys).collect()) == want
    assert A.archive_bodies(arc, keys.where("bucket = 'none'")).count() == 0


def test_objects_of_a_directory_packed(spark, tmp_path):
    """Listed with their bytes, packed, and looked up again by key."""
    root = tmp_path / "in" / "logs"
    (root / "2031").mkdir(parents=True)
    bodies = {"a.gz": gzip.compress(b"one\n"), "2031/b.log": b"two\n", "2031/c.log": b""}
    for k, b in bodies.items():
        (root / k).write_bytes(b)
    listed = objectstore.list_objects(spark, str(root))
    assert {(r["object_key"], r["size_bytes"], r["etag"], bytes(r["body"])) for r in listed.collect()} == {(k, len(b), hashlib.md5(b).hexdigest(), b) for k, b in bodies.items() if b}
    assert {r["object_key"] for r in objectstore.list_objects(spark, str(root), pattern="*.log").select("object_key").collect()} == {"2031/b.log"}
    arc = A.pack_objects(listed, str(tmp_path / "arc"))
    (r,) = A.archive_bodies(arc, listed.where("object_key = '2031/b.log'").select("bucket", "object_key")).collect()
    assert bytes(r["body"]) == b"two\n" and r["intact"]


def test_blocks_are_bounded(spark, objects, tmp_path):
    df, bodies = objects
    arc = A.pack_objects(df, str(tmp_path / "arc"), block_bytes=1000)
    sizes = [r[0] for r in arc.select(F.length("block")).collect()]
    assert all(s <= 1000 or s == len(bodies[6]) for s in sizes)


def test_compacted_once(spark, objects, tmp_path):
    df, _ = objects
    arc = A.pack_objects(df, str(tmp_path / "arc"))
    out = A.compact_records(arc, str(tmp_path / "out"))
    assert out.count() == out.select("request_id").distinct().count() == 2007
    assert out.where("request_id = 'b'").first()["object_id"] == 1


def test_empty_table(spark, tmp_path):
    arc = A.pack_objects(spark.createDataFrame([], SCHEMA), str(tmp_path / "arc"))
    assert arc.count() == 0 and A.record_owners(arc).count() == 0 and A.archive_bodies(arc).count() == 0


def test_inflate_other_wrappings():
    import bz2
    import lzma

    assert A.inflate(bz2.compress(b"x\n")) == b"x\n" and A.inflate(lzma.compress(b"x\n")) == b"x\n"
    assert A.inflate(b"BZh not really") == b"BZh not really" and A.inflate(b"\x1f\x8bnonsense") == b""
    assert A.inflate(gzip.compress(b"a") + b"trail") == b"a"
