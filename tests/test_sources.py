import gzip
import io
import json
from dataclasses import dataclass
from typing import Optional

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemill import destinations as D
from tidemill import types as TT
from tidemill.functions import address, lists, value
from tidemill.functions import time as tm
from tidemill.operators import sinks as S
from tidemill.operators import sketches
from tidemill.sources import csv, jdbc, memory, objectstore, parquet, warc, weblog
from tidemill.sources import json as js
from tidemill.streaming import windows


@TT.record
class Game:
    a: str
    n: TT.U32
    when: Optional[TT.NaiveDateTime] = None
    total: Optional[TT.decimal_type(10, 2)] = TT.field(name="total (USD)", default=None)


def test_records_become_schemas():
    assert Game.schema.simpleString() == "struct<a:string,n:bigint,when:timestamp_ntz,total (USD):decimal(10,2)>"
    assert [f.nullable for f in Game.schema] == [False, False, True, True]

    @dataclass
    class Nested:
        xs: list[Optional[int]]
        m: dict[str, float]
        t: tuple[int, str]
        g: Game

    assert TT.schema_of(Nested).simpleString().startswith("struct<xs:array<bigint>,m:map<string,double>,t:struct<_1:bigint,_2:string>,g:struct<a:string")
    with pytest.raises(TypeError):
        TT.spark_type(object)


def test_parquet_strict_projected_repeated(spark, tmp_path):
    p = str(tmp_path / "x.parquet")
    spark.createDataFrame([(1, "a", 2.0), (2, None, None)], "i bigint, s string, d double").write.parquet(p)
    assert parquet.read_parquet(spark, [p] * 5).count() == 10
    assert parquet.read_parquet(spark, p, "d double, i bigint").columns == ["d", "i"]
    assert parquet.read_parquet(spark, p, TT.T.StructType([])).count() == 2
    for bad in ("z bigint", "i string"):
        with pytest.raises(ValueError, match="wanted: struct"):
            parquet.read_parquet(spark, p, bad)
    assert parquet.read_parquet(spark, p, "z bigint", strict=False).where("z IS NULL").count() == 2


def test_parquet_directory_rules(spark, tmp_path):
    root = tmp_path / "logs"
    for y in (2020, 2021):
        for m in (1, 2):
            spark.createDataFrame([(y * 100 + m,)], "v bigint").coalesce(1).write.parquet(str(root / f"year={y}/month={m}"))
    (root / "_tmp").mkdir()
    (root / "_tmp" / "part.parquet").write_bytes(b"junk")
    (root / "year=2020" / "x_$folder$").write_bytes(b"")
    assert sorted(parquet.read_parquet_directory(spark, str(root)).columns) == ["month", "v", "year"]
    flat = parquet.read_parquet_directory(spark, str(root / "year=2021"), partition_columns=False)
    assert flat.columns == ["v"] and flat.count() == 2
    some = parquet.read_parquet_directory(spark, str(root), keep=lambda p: "month=1" in p)
    assert sorted((r.v, r.year) for r in some.collect()) == [(202001, 2020), (202101, 2021)]
    assert parquet.read_parquet_directory(spark, str(root), "v bigint", keep=lambda p: False).count() == 0
    assert parquet.hidden("_SUCCESS") and parquet.hidden(".x.crc") and not parquet.hidden("_a=1")


@pytest.mark.parametrize("codec", D.CODECS)
def test_parquet_codecs(spark, tmp_path, codec):
    D.write_parquet(spark.range(10), str(tmp_path / codec), codec=codec)
    assert spark.read.parquet(str(tmp_path / codec)).count() == 10
    with pytest.raises(ValueError):
        D.write_parquet(spark.range(1), str(tmp_path / "b"), codec="brotli")


def test_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text('x,"a, b",1\ny,"say ""hi""",2\n')
    rows = csv.read_csv(spark, str(tmp_path / "g.csv"), "k string, t string, n bigint").collect()
    assert [(r.k, r.t, r.n) for r in rows] == [("x", "a, b", 1), ("y", 'say "hi"', 2)]
    assert dict(csv.read_csv(spark, str(tmp_path / "g.csv")).dtypes)["_c2"] == "int"
    (tmp_path / "bad.csv").write_text("x,1\ny\nz,q\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        csv.read_csv(spark, str(tmp_path / "bad.csv"), "k string, n bigint").collect()
    assert csv.read_csv(spark, str(tmp_path / "bad.csv"), "k string, n bigint", errors="drop").collect() == [("x", 1)]
    kept = csv.read_csv(spark, str(tmp_path / "bad.csv"), "k string, n bigint", errors="null").collect()
    assert len(kept) == 3 and sum(r["_corrupt_record"] is not None for r in kept) == 2
    D.write_csv(spark.createDataFrame([('q"x', 1)], "a string, b int"), str(tmp_path / "out"))
    assert csv.read_csv(spark, str(tmp_path / "out"), "a string, b int").first().a == 'q"x'


def test_json_lines_and_concatenated(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a":1,"b":"x"}\n{"a":2}\n')
    assert sorted(r.a for r in js.read_json(spark, str(tmp_path / "l.json"), "a bigint, b string").collect()) == [1, 2]
    (tmp_path / "c.json").write_text('{"a":1}{"a":2}\n {"a":3,\n"b":"é"}')
    got = js.read_json_concatenated(spark, [str(tmp_path / "c.json")] * 2, "a bigint, b string").collect()
    assert sorted(r.a for r in got) == [1, 1, 2, 2, 3, 3] and {r.b for r in got} == {None, "é"}
    assert js.read_json_concatenated(spark, str(tmp_path / "c.json")).count() == 3
    (tmp_path / "d.json").write_text('{"a":1,"a":2}')
    with pytest.raises(Exception, match="twice"):
        js.read_json_concatenated(spark, str(tmp_path / "d.json"), "a bigint").collect()
    assert js.read_json_concatenated(spark, str(tmp_path / "d.json"), "a bigint", unique_keys=False).first().a == 2
    (tmp_path / "e.json").write_text("")
    assert js.read_json_concatenated(spark, str(tmp_path / "e.json"), "a bigint").count() == 0
    D.write_json(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), str(tmp_path / "o"))
    assert json.loads(next((tmp_path / "o").glob("part-*")).read_text()) == {"a": 1, "b": None}


def log_line(**kw):
    cells = dict.fromkeys(weblog.FIELDS, "-") | {"date": "2031-02-28", "time": "00:02:12", "sc_bytes": "10", "cs_bytes": "5", "sc_status": "200", "time_taken": "0.0125", "cs_protocol": "https", "x_host_header": "h.test", "cs_uri_stem": "/p"} | kw
    return "\t".join(cells[f] for f in weblog.FIELDS)


def test_weblog(spark, tmp_path):
    lines = ["#Version: 1.0", " \t#Fields: x", "", log_line(cs_uri_query="a=1", ssl_protocol="TLS"), log_line(sc_status="000", time_taken="1")]
    (tmp_path / "x.gz").write_bytes(gzip.compress("\n".join(lines[:4]).encode() + b"\n") + gzip.compress(lines[4].encode() + b"\r\n"))
    a, b = sorted(weblog.read_weblog(spark, str(tmp_path / "x.gz")).collect(), key=lambda r: r.time_taken)
    assert a.url == "https://h.test/p?a=1" and a.status == 200 and a.time_taken == 13 and a.ssl_protocol_cipher.asDict() == {"protocol": "TLS", "cipher": "-"} and a.referer is None
    assert b.url == "https://h.test/p" and b.status is None and b.time_taken == 1000 and b.ssl_protocol_cipher is None and len(b) == 21
    bad = spark.createDataFrame([("only\tthree\tfields",), (log_line(sc_bytes="many"),), (log_line(),)], "value string")
    with pytest.raises(Exception, match="26 fields|CAST_INVALID"):
        weblog.parse_lines(bad).collect()
    assert weblog.parse_lines(bad, errors="drop").count() == 1


def record(kind, body, **h):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in ({"WARC_Type": kind, "Content_Length": len(body)} | h).items())
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def test_warc(spark, tmp_path):
    data = record("warcinfo", b"info") + record("request", b"GET") + record("response", b"page 1", WARC_Target_URI="http://a.test/", WARC_IP_Address="10.0.0.1") + record("metadata", b"m") + record("response", b"", WARC_Target_URI="<http://b.test/>")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "b.warc").write_bytes(data[:-8])
    got = sorted((r.url, r.ip, bytes(r.contents)) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert got[0] == ("http://a.test/", "10.0.0.1", b"page 1") and len(got) >= 3 and got[-1][0] == "http://b.test/"
    assert warc.read_warc(spark, str(tmp_path / "a.warc.gz"), largest=3).count() == 1
    assert warc.read_warc(spark, str(tmp_path)).rdd.getNumPartitions() == 2
    with pytest.raises(ValueError):
        list(warc.pages(io.BytesIO(b"nonsense\n")))


def test_jdbc_options():
    c = jdbc.Connect("db.test", "shop", "me", "secret", options={"ssl": "true"})
    o = jdbc.jdbc_options(c, jdbc.PgTable('we"ather', "public"), partition_column="id", bounds=(0, 9), partitions=3)
    assert o["url"] == "jdbc:postgresql://db.test:5432/shop?ssl=true" and o["dbtable"] == '"public"."we""ather"' and o["numPartitions"] == "3"
    assert jdbc.jdbc_options(c, jdbc.PgQuery("SELECT 1;"))["dbtable"] == "(SELECT 1) AS q" and "secret" not in repr(c)
    with pytest.raises(ValueError):
        jdbc.jdbc_options(c, jdbc.PgTable("t"), partition_column="id")


def test_object_store_options():
    o = objectstore.store_options("eu-1", objectstore.Credentials.access_key("k", "s"))
    assert o["fs.s3a.endpoint.region"] == "eu-1" and o["fs.s3a.access.key"] == "k" and "Simple" in o["fs.s3a.aws.credentials.provider"]
    assert "Anonymous" in objectstore.store_options(credentials=objectstore.Credentials.anonymous())["fs.s3a.aws.credentials.provider"]
    assert objectstore.store_path("b", "/k/x") == "s3a://b/k/x"


def test_memory(spark):
    from collections import deque

    for xs in ([1, 2, 3], (1, 2, 3), deque([1, 2, 3]), {1, 2, 3}, range(1, 4), iter([1, 2, 3])):
        assert memory.parallelize(spark, xs).agg(F.sum("value")).first()[0] == 6
    assert {tuple(r) for r in memory.parallelize(spark, {"a": 1}).collect()} == {("a", 1)}
    assert memory.parallelize(spark, None, "v bigint").count() == 0
    assert [r.value for r in memory.chars(spark, "añb").orderBy("pos").collect()] == ["a", "ñ", "b"]
    assert memory.parallelize(spark, [Game("x", 1)]).first()["total (USD)"] is None
    with pytest.raises(ValueError):
        memory.parallelize(spark, [])


def test_time_functions(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-02-29 01:17:03.5' AS n, TIMESTAMP'2024-07-01 12:00:00Z' AS z, 60L AS d, '2024-02-30' AS bad, '2024-01-02T03:04:05+02:00' AS iso")
    r = df.select(
        tm.truncate_minutes(F.col("n"), 15).cast("string").alias("q"), tm.truncate_minutes(F.col("n"), 60).cast("string").alias("h"), tm.ordinal(F.col("n")).alias("o"), tm.nanosecond(F.col("n")).alias("ns"),
        tm.from_days(F.col("d")).cast("string").alias("fd"), tm.from_ordinal(F.lit(2024), F.lit(60)).cast("string").alias("fo"), tm.from_ordinal(F.lit(2023), F.lit(366)).alias("fx"), tm.from_seconds(F.lit(61)).alias("fs"),
        tm.from_seconds(F.lit(86_400)).alias("fy"), tm.offset_seconds(F.col("z"), "Europe/Paris").alias("off"), tm.without_timezone(F.col("z"), "+05:00").cast("string").alias("wall"),
        tm.with_timezone(F.col("n"), "+01:00").cast("string").alias("inst"), tm.parse_date(F.col("bad")).alias("pd"), tm.parse_datetime(F.col("iso")).cast("string").alias("pt"), tm.truncate_time(F.lit(3_723_000_000_000), 15).alias("tt"),
    ).first()
    assert (r.q, r.h, r.o, r.ns, r.fd, r.fo, r.fx, r.fs, r.fy) == ("2024-02-29 01:15:00", "2024-02-29 01:00:00", 60, 500_000_000, "1970-03-02", "2024-02-29", None, 61_000_000_000, None)
    assert (r.off, r.wall, r.inst, r.pd, r.pt, r.tt) == (7200, "2024-07-01 17:00:00", "2024-02-29 00:17:03.5", None, "2024-01-02 01:04:05", 3_600_000_000_000)
    assert [tm.fixed_zone(h * 3600) for h in (5, 6, 7, 8, 9)] == ["+05:00", "+06:00", "+07:00", "+08:00", "+09:00"] and tm.fixed_zone(-5400) == "-01:30"
    with pytest.raises(ValueError):
        tm.truncate_minutes(F.col("n"), 7)


def test_addresses(spark):
    df = spark.createDataFrame([("http://A.test/p?q=1#f", "10.0.0.9"), ("nonsense", "2001:db8::1"), (None, "10.0.0.10"), ("ftp://x", "::"), ("x:y", "999.1.1.1")], "u string, ip string")
    assert [r[0] for r in df.select(address.url_part(F.col("u"), "host")).collect()][:3] == ["A.test", None, None]
    assert [r[0] for r in df.select(address.is_url(F.col("u"))).collect()][:4] == [True, False, None, True]
    ordered = [r.ip for r in df.select("ip", address.ip_sort_key(F.col("ip")).alias("k")).where("k IS NOT NULL").orderBy("k").collect()]
    assert ordered == ["10.0.0.9", "10.0.0.10", "::", "2001:db8::1"]


def test_dynamic_values_and_lists(spark):
    df = spark.createDataFrame([('{"a":5,"s":"x","t":"7"}',), ("[1]",), ("not json",), (None,)], "j string").select(value.parse(F.col("j")).alias("v"))
    got = df.select(value.try_get(F.col("v"), "i64", "$.a").alias("a"), value.try_get(F.col("v"), "i32", "$.s").alias("s"), value.is_kind(F.col("v"), "i64", "$.a").alias("ia"), value.is_kind(F.col("v"), "i64", "$.t").alias("it")).collect()
    assert [r.a for r in got] == [5, None, None, None] and got[0].s is None and got[0].ia is True and not got[0].it
    with pytest.raises(Exception, match="INVALID_VARIANT_CAST|CAST"):
        df.limit(1).select(value.get(F.col("v"), "i32", "$.s")).collect()
    xs = spark.createDataFrame([([1, 2],), ([],), (None,)], "x array<int>")
    got = xs.select(lists.length(F.col("x")).alias("n"), lists.is_empty(F.col("x")).alias("e"), lists.push(F.col("x"), F.lit(9)).alias("p"), lists.try_map(F.col("x"), lambda v: F.when(v > 1, v)).alias("t")).collect()
    assert [(r.n, r.e, r.p, r.t) for r in got] == [(2, False, [1, 2, 9], None), (0, True, [9], []), (None, None, None, None)]


def test_windows_on_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:10' AS ts, 'a' AS k UNION ALL SELECT TIMESTAMP'2024-01-01 00:59:00', 'a' UNION ALL SELECT TIMESTAMP'2024-01-01 02:00:00', 'b' UNION ALL SELECT NULL, 'c'").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(src))
    q = windows.tumbling(stream, "ts", "1 hour", ["k"], late="10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r["count"]) for r in spark.sql("SELECT * FROM w").collect()) == [("a", 2), ("b", 1)]
    batch = spark.read.parquet(str(src))
    assert windows.sliding(batch, "ts", "1 hour", "30 minutes", ["k"]).count() == 5
    assert windows.session(batch, "ts", "10 minutes", ["k"]).count() == 3


def test_archives_of_a_crawl_and_globs(spark, tmp_path):
    page = record("response", b"page", WARC_Target_URI="http://a.test/")
    at = tmp_path / "crawl-data" / "CC-TEST-1" / "segments"
    at.mkdir(parents=True)
    for i in range(3):
        (at / f"{i}.warc.gz").write_bytes(gzip.compress(page) + gzip.compress(page))
    paths = [f"crawl-data/CC-TEST-1/segments/{i}.warc.gz" for i in (0, 2)]
    (tmp_path / "crawl-data" / "CC-TEST-1" / "warc.paths.gz").write_bytes(gzip.compress("\n".join(paths).encode()))
    assert warc.read_crawl(spark, "CC-TEST-1", str(tmp_path)).count() == 4
    assert warc.read_warc(spark, str(at / "[01].warc.gz")).count() == 4
    assert warc.read_warc(spark, f"file://{at}").count() == 6
    with pytest.raises(Exception, match="FileNotFound"):
        warc.read_warc(spark, str(tmp_path / "none")).count()


def test_zones_do_not_depend_on_the_session(spark):
    own = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 12:00:00.25' AS t UNION ALL SELECT TIMESTAMP_NTZ'1969-07-20 20:17:40' UNION ALL SELECT null")
    try:
        for zone in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = df.select(F.unix_micros(tm.with_timezone(F.col("t"), "+02:00")).alias("i"), tm.nanosecond(F.col("t")).alias("n"), F.unix_micros(tm.with_timezone(F.col("t"), "Europe/Paris")).alias("p")).collect()
            assert [tuple(r) for r in got] == [(1704103200250000, 250000000, 1704106800250000), (-14182940000000 - 7200000000, 0, -14182940000000 - 3600000000), (None, None, None)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", own)


def test_nested_parquet_shapes(spark, tmp_path):
    """Nested lists and maps, null and empty at every level, and structures of one field, written by another library."""
    lists = pa.table({"a": pa.array([[[["x", None], []], None], [], None], pa.list_(pa.list_(pa.list_(pa.string())))), "b": pa.array([1, 2, 3], pa.int32())})
    maps = pa.table({"a": pa.array([[("k", [(1, True), (2, None)])], [("k", None)], [], None], pa.map_(pa.string(), pa.map_(pa.int32(), pa.bool_())))})
    deep = pa.struct([("A", pa.int32()), ("b", pa.list_(pa.struct([("e", pa.int32()), ("f", pa.string())]))), ("one", pa.struct([("x", pa.int32())]))])
    structs = pa.table({"s": pa.array([{"A": 1, "b": [{"e": None, "f": "u"}, None], "one": {"x": None}}, {"A": None, "b": None, "one": None}, None], deep)})
    for name, t in (("lists", lists), ("maps", maps), ("structs", structs)):
        pq.write_table(t, tmp_path / f"{name}.parquet")
    read = lambda n: parquet.read_parquet(spark, str(tmp_path / f"{n}.parquet"))
    assert [tuple(r) for r in read("lists").collect()] == [([[["x", None], []], None], 1), ([], 2), (None, 3)]
    assert [r[0] for r in read("maps").collect()] == [{"k": {1: True, 2: None}}, {"k": None}, {}, None]
    got = [r[0] for r in read("structs").collect()]
    assert got[0]["A"] == 1 and got[0]["b"][0]["f"] == "u" and got[0]["b"][1] is None and got[0]["one"]["x"] is None and got[1]["one"] is None and got[2] is None
    only = read("structs").select("s.b.f")
    assert [r[0] for r in only.collect()] == [["u", None], None, None]
    assert "struct<s:struct<b:array<struct<f:string>>>>" in only._jdf.queryExecution().executedPlan().toString().replace(" ", "")


def test_sketches_built_merged_and_estimated(spark):
    """Top lists and distinct counts of parts put together equal those of the whole, within their error."""
    df = spark.range(30_000).selectExpr("id % 3 AS part", "if(id % 5 = 0, 'hot', concat('x', id % 900)) AS v")
    hll = sketches.HyperLogLog(0.02)
    merged = df.groupBy("part").agg(hll.build(F.col("v")).alias("s")).agg(hll.estimate(hll.merge(F.col("s"))).alias("e")).first()["e"]
    assert abs(merged - 721) <= 721 * 0.1
    assert S.MostFrequent("v", 1, exact=True).run(df) == [("hot", 6_000)]
    assert S.MostFrequent("v", 1).run(df)[0][0] == "hot"
