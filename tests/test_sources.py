"""Sources on small files made here."""

import gzip
import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from emberlens.functions import text as T
from emberlens.operators import compare as C
from emberlens.operators import threads as TD
from emberlens.sources import hprof, lines, server_log, snapshots, thread_dump
from emberlens.streaming.flows import deduplicated, stream_episodes, stream_timeline


def as_lines(spark, text, file="f"):
    return spark.createDataFrame([(file, i + 1, x) for i, x in enumerate(text.split("\n"))], "file string, line_no long, line string")


def test_lines_and_records_go_on_in_the_next_file(spark, tmp_path):
    (tmp_path / "b.log").write_text("2024-01-01 00:00:02.000 INFO [t1] A:1 first\n   more\n")
    (tmp_path / "a.log").write_text("   tail of first\n2024-01-01 00:00:03.000 ERROR [t1] B:2 second\r\n\tat x.Y.z(Y.java:1)\nCaused by: java.lang.Error: no\n\nlast words 7")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.log").write_text("no time here")
    d = lines.read_lines(spark, str(tmp_path))
    assert d.count() == 9 and d.agg(F.max("line_no")).first()[0] == 6
    order = [r.file.rsplit("/", 1)[1] for r in lines.file_order(d).orderBy("file_rank").collect()]
    assert order == ["b.log", "a.log", "c.log"]
    r = lines.read_records(d).orderBy("o1", "o2").collect()
    assert [(x.call_site, x.n_continuations) for x in r] == [("A:1", 2), ("B:2", 2), ("", 0), ("last words ?", 0), ("no time here", 0)]
    assert r[1].has_stack and r[1].level == "ERROR" and r[1].thread_id == "t1" and not r[0].has_stack


def test_pipe_layout(spark):
    text = "junk\n2024-01-01 10:00:00.123 | INFO | exec-1 | com.a.B:12 | hello | there\n  and more\n2024-01-01 10:00:01.000 | WARN | exec-2 | com.a.C:3 | x"
    d = as_lines(spark, text)
    got = lines.read_profile(d).orderBy("o2").collect()
    assert [(r.thread_id, r.call_site, r.level, r.message) for r in got] == [("exec-1", "com.a.B:12", "INFO", "hello | there"), ("exec-2", "com.a.C:3", "WARN", "x")]
    assert lines.match_rate(d).first().asDict() == {"matched": 2, "malformed": 1, "rate": 2 / 3}
    assert lines.detect_format(d.where("line like '%|%'")) == {"fields": 5, "timestamp": "yyyy-MM-dd HH:mm:ss.SSS"}
    assert lines.detect_format(as_lines(spark, "a\nb")) is None


def test_server_log_events(spark):
    text = """2024-03-01T10:00:00.500+01:00 ERROR [http-1] com.acme.Shop requestId=req-9 failed
java.lang.IllegalStateException: broken
\tat com.acme.Shop.pay(Shop.java:42)
Caused by: java.lang.OutOfMemoryError: Java heap space
2024-03-01 10:00:02 WARN [http-2] com.acme.Cart slow
{"@timestamp": "2024-03-01T09:00:05Z", "level": "info", "thread_name": "main", "logger_name": "com.acme.Boot", "message": "Started Shop in 3.2 seconds", "traceId": "t-1"}"""
    a, b, c = server_log.events(as_lines(spark, text)).orderBy("id").collect()
    assert (a.level, a.thread, a.request_id, a.exception, a.end_line) == ("ERROR", "http-1", "req-9", "java.lang.OutOfMemoryError", 4)
    assert str(a.ts) == "2024-03-01 09:00:00.500000" and [(f.class_name, f.line) for f in a.frames] == [("com.acme.Shop", 42)]
    assert [(m.kind, m.detail) for m in a.markers] == [("oom", "Java heap space")]
    assert b.ts is None and b.raw_timestamp == "2024-03-01 10:00:02" and b.level == "WARN"
    assert (c.level, c.thread, c.logger, c.trace_id, c.format) == ("INFO", "main", "com.acme.Boot", "t-1", "json")
    assert [(m.kind, m.detail) for m in c.markers] == [("server_start", "Shop")]
    assert server_log.events(as_lines(spark, text), "+02:00").where("id = 5").first().ts is not None


DUMP = '''"main" #1 prio=5 os_prio=0 cpu=234.56ms elapsed=10.30s tid=0x00007f01 nid=0x1 runnable  [0x01]
   java.lang.Thread.State: RUNNABLE
\tat java.net.SocketInputStream.socketRead0(java.base@17/Native Method)
\tat com.acme.Main.run(Main.java:10)
\t- locked <0x0000000a> (a java.lang.Object)

"worker-1" #12 daemon prio=5 tid=0x00007f02 nid=0x2 waiting for monitor entry
   java.lang.Thread.State: BLOCKED (on object monitor)
\tat com.acme.Pool.take(Pool.java:5)
\t- waiting to lock <0x0000000a> (a java.lang.Object)
\t- locked <0x0000000b> (a java.lang.Object)
   Locked ownable synchronizers:
\t- <0x0000000c> (a java.util.concurrent.locks.ReentrantLock$FairSync)

Found one Java-level deadlock:
=============================
"worker-1":
  waiting to lock monitor 0x01 (object 0x0000000a, a java.lang.Object),
  which is held by "main"'''


def test_thread_dump(spark):
    d = as_lines(spark, DUMP)
    main, w = thread_dump.threads(d).orderBy("id").collect()
    assert (main.name, main.state, main.cpu_ms, main.elapsed_s, main.daemon, main.held) == ("main", "RUNNABLE", 234.56, 10.3, False, ["0x0000000a"])
    assert main.stack == ["java.net.SocketInputStream.socketRead0", "com.acme.Main.run"]
    assert (w.state, w.state_detail, w.waits_for, w.daemon, w.held) == ("BLOCKED", "on object monitor", "0x0000000a", True, ["0x0000000b", "0x0000000c"])
    assert [(r.waiter, r.holder) for r in TD.blocked_by(thread_dump.threads(d)).collect()] == [("worker-1", "main")]
    assert [(r.waiter, r.holder) for r in thread_dump.reported_deadlocks(d).collect()] == [("worker-1", "main")]


def build_hprof(id_size=8):
    """Two classes, an instance of each with a reference, an object array, a primitive array, two roots."""
    i = lambda x: x.to_bytes(id_size, "big")
    rec = lambda tag, body: bytes([tag]) + struct.pack(">II", 0, len(body)) + body
    names = {1: "com/acme/Base", 2: "com/acme/Node", 3: "next", 4: "size", 5: "data", 6: "HEAD"}
    out = b"JAVA PROFILE 1.0.2\0" + struct.pack(">IQ", id_size, 0)
    out += b"".join(rec(0x01, i(k) + v.encode()) for k, v in names.items())
    for serial, (cid, name) in enumerate(((0xF000000000000100 % (1 << 8 * id_size), 1), (0x200, 2))):
        out += rec(0x02, struct.pack(">I", serial) + i(cid) + struct.pack(">I", 0) + i(name))
    base, node = 0xF000000000000100 % (1 << 8 * id_size), 0x200

    def cls(cid, sup, statics, fields):
        b = b"\x20" + i(cid) + struct.pack(">I", 0) + i(sup) + i(0x50) + i(0) * 4 + struct.pack(">I", 0) + struct.pack(">HH", 0, len(statics))
        for n, ref in statics:
            b += i(n) + b"\x02" + i(ref)
        return b + struct.pack(">H", len(fields)) + b"".join(i(n) + bytes([k]) for n, k in fields)

    heap = cls(base, 0, [(6, 0x301)], [(4, 10)]) + cls(node, base, [], [(3, 2), (5, 2)])
    heap += b"\x21" + i(0x301) + struct.pack(">I", 0) + i(node) + struct.pack(">I", 2 * id_size + 4) + i(0x302) + i(0x401) + struct.pack(">I", 7)
    heap += b"\x22" + i(0x302) + struct.pack(">II", 0, 3) + i(node) + i(0x301) + i(0) + i(0x401)
    heap += b"\x23" + i(0x401) + struct.pack(">II", 0, 4) + b"\x08" + b"abcd"
    heap += b"\x08" + i(0x301) + struct.pack(">II", 1, 0) + b"\x01" + i(0x302) + i(0x999)
    return out + rec(0x1C, heap) + rec(0x2C, b"")


def test_hprof(spark, tmp_path):
    for size in (4, 8):
        (tmp_path / f"h{size}.hprof").write_bytes(build_hprof(size))
    assert hprof.heap_format(build_hprof()[:100]) == "hprof" and hprof.heap_format(b"\x1f\x8b") == "gzip"
    t = {k: v.where("dump like '%h8%'") for k, v in hprof.tables_of(hprof.read_dumps(spark, str(tmp_path))).items()}
    o = {r.oid: (r.class_id, r.kind, r.shallow, r.length) for r in t["objects"].collect()}
    assert o["0x301"] == ("0x200", "instance", 24, 0) and o["0x302"] == ("0x200", "object_array", 32, 3) and o["0x401"] == ("prim:byte[]", "primitive:8", 24, 4)
    e = {(r.src, r.field): (r.dst, r.strength) for r in t["edges"].collect()}
    assert e[("0x301", "com.acme.Node.next")] == ("0x302", "strong") and e[("0x302", "[2]")] == ("0x401", "strong") and ("0x302", "[1]") not in e
    assert e[("0xf000000000000100", "static:HEAD")] == ("0x301", "strong") and e[("0x200", "<superclass>")][0] == "0xf000000000000100"
    assert {(r.node, r.kind) for r in t["roots"].collect()} == {("0x301", "thread"), ("0x302", "jni_global")}
    assert t["array_hashes"].first().digest == hashlib.sha256(b"abcd").hexdigest()


def test_snapshot_sections(spark, tmp_path):
    doc = {"meta": {"engine": "postgres", "db_size_bytes": 5}, "connections": {"current": 3, "max_limit": 9}, "indexes": [{"table": "public.t", "name": "i", "definition": "CREATE INDEX i ON public.t USING btree (a, lower_b)", "size_bytes": 1}], "settings": [{"name": "x", "value": "1", "unit": None}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    s = snapshots.read_snapshot(spark, str(tmp_path))
    assert s["indexes"].first().columns == ["a", "lower_b"] and s["connections"].first().max_limit == 9 and s["queries"].count() == 0
    (tmp_path / "d.sql").write_text("-- CREATE TABLE no\nCREATE TABLE a (x int); create unique index if not exists b on a(x);\nCREATE OR REPLACE FUNCTION f() ...")
    assert {(r.kind, r.name) for r in snapshots.read_ddl(spark, str(tmp_path / "d.sql")).collect()} == {("table", "a"), ("index", "b"), ("function", "f")}


def test_source_symbols(spark, tmp_path):
    (tmp_path / "A.java").write_text('package com.acme;\nimport com.other.Util;\n/* class No {} */ public class A {\n  private static Util u = new Util("class X");\n  public void run(int a) { }\n}')
    (tmp_path / "B.kt").write_text("package com.acme\nclass B { fun go(x: Int) {} }")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "C.java").write_text("class C {}")
    src = snapshots.read_sources(spark, str(tmp_path))
    sym = snapshots.symbols(src)
    assert {(r.kind, r.name) for r in sym.collect()} == {("type", "A"), ("method", "run"), ("type", "B"), ("method", "go")}
    classes = spark.createDataFrame([("com.other.Util",), ("com.acme.B",)], "class_name string")
    assert [(r.class_name, r.kind) for r in snapshots.references(src, classes).where("class_name = 'com.other.Util'").collect()] == [("com.other.Util", "new")]
    assert [r.class_name for r in snapshots.lookup(sym, classes).collect()] == ["com.acme.B"]


def test_flows_compare(spark):
    text = "\n".join(f"2024-01-01 00:00:0{k}.000 INFO S:{k} ref={r} orderTotal={t}" for r, t in (("g-1", 5), ("b-2", 6)) for k in (1, 2, 3) if (r, k) != ("b-2", 2)) + "\n2024-01-01 00:00:09.000 ERROR S:9 ref=b-2 broke\n  at x.Y.z(Y.java:1)\nother"
    steps = C.flow_steps(as_lines(spark, text), "g-1", "b-2", follow_links=False)
    got = C.compare_flows(steps, "g-1", "b-2").orderBy("idx").collect()
    assert [(r.kind, r.key) for r in got] == [("SAME", "S:1"), ("ONLY_IN_GOOD", "S:2"), ("SAME", "S:3"), ("ONLY_IN_BAD", "S:9")]
    assert [(f.key, f.kind) for f in got[0].fields] == [("orderTotal", "VALUE_DIFFERS")]
    assert [r.key for r in C.errors_only_in_bad(steps).collect()] == ["S:9"]


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "x", "INFO"), ("a", "2024-01-01 06:00:00", "y", "ERROR"), ("a", "2024-01-03 00:00:00", "x", "INFO"), ("b", "2024-01-10 00:00:00", "x", "WARN"), ("b", "2024-01-10 00:00:00", "x", "WARN")]
    d = spark.createDataFrame(rows, "flow_key string, ts string, call_site string, level string").withColumn("ts", F.col("ts").cast("timestamp"))
    d.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    for name, f in (("eps", stream_episodes(source)), ("tl", stream_timeline(source)), ("dd", deduplicated(source, ["flow_key", "ts"]))):
        q = f.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert {(r.flow_key, r.n_records, r.has_error) for r in spark.table("eps").collect()} == {("a", 2, True), ("a", 1, False)}
    assert spark.table("tl").where("errors = 1").count() == 1 and spark.table("dd").count() == 4


def test_server_log_headers_of_other_layouts(spark):
    text = "\n".join(
        [
            "no header yet",
            "2024-01-01 10:00:00 worker started",
            "at nowhere",
            "WARN: low on space",
            "2026-01-02T03:04:05.1+02:00 ERROR [com.acme.Shop] (exec-7) traceId=t9 failed",
            "Caused by: java.io.IOException: ERROR 2024-01-01 10:00:00",
            '{"time": "2026-01-02T03:04:05Z", "level": "warning", "correlationId": "c1", "message": "late", "exception": "java.lang.OutOfMemoryError: Java heap space\\n\\tat a.B.c(B.java:3)"}',
            "{not json} INFO kept",
            '{"other": 1}',
            "INFO long",
            *["x"] * 300,
        ]
    )
    got = {r.id: r for r in server_log.events(as_lines(spark, text)).collect()}
    assert sorted(got) == [1, 2, 4, 5, 7, 8, 9, 10, 266]
    assert (got[1].format, got[1].level, got[2].level, got[2].raw_timestamp, got[2].end_line) == ("unrecognized", "UNKNOWN", "UNKNOWN", "2024-01-01 10:00:00", 3)
    assert (got[4].level, got[4].raw_timestamp, got[4].thread) == ("WARN", None, None)
    assert (got[5].thread, got[5].logger, got[5].trace_id, got[5].exception, got[5].end_line) == ("exec-7", "com.acme.Shop", "t9", "java.io.IOException", 6)
    assert (got[7].level, got[7].request_id, got[7].message, got[7].exception, got[7].format) == ("WARN", "c1", "late", "java.lang.OutOfMemoryError", "json")
    assert [m.kind for m in got[7].markers] == ["oom"] and got[7].frames[0].line == 3 and got[7].excerpt.startswith("late\n")
    assert (got[8].format, got[8].level, got[9].format, got[9].level, got[9].message) == ("text", "INFO", "json", "UNKNOWN", "")
    assert got[10].truncated and got[10].end_line == 265 and got[266].format == "unrecognized" and not got[266].truncated


def test_pause_stands_behind_the_sizes(spark):
    rows = [("[1234ms][info][gc] GC(3) Pause Young (Normal) 10M->5M(20M) 2.500ms", 2.5), ("1.2: [GC (x) 33M->5M(128M), 0.0072 secs]", 7.2), ("[5ms] GC(1) Pause Mark Start 0.012ms", 5.0), ("[77ms] 1M->1M(2M)", None)]
    d = spark.createDataFrame(rows, "line string, want double")
    assert all(r.p == r.want or abs(r.p - r.want) < 1e-9 for r in d.select(T.gc_fields(F.col("line")).pause_ms.alias("p"), "want").collect())


def test_starting_lines_are_found_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 7)
    rows = [(f, i, "s" if i % k == 0 else "") for f, k in (("a", 5), ("b", 60)) for i in range(1, 51)]
    d = spark.createDataFrame(rows, "file string, line_no long, line string")
    got = {(r.file, r.line_no): (r.at, r.n) for r in lines.running(lines.running(d, F.col("line") == "s", "at"), F.col("line") == "s", "n", count=True).collect()}
    assert got == {(f, i): ((i // k * k, i // k)) for f, k in (("a", 5), ("b", 60)) for i in range(1, 51)}


def test_compressed_dumps_are_expanded_under_a_budget(spark, tmp_path):
    data = build_hprof(8)
    (tmp_path / "plain.hprof").write_bytes(data)
    (tmp_path / "two.hprof.gz").write_bytes(gzip.compress(data[:50]) + gzip.compress(data[50:]))
    rows = hprof.read_dumps(spark, str(tmp_path)).groupBy("dump").count().collect()
    assert len(rows) == 2 and rows[0]["count"] == rows[1]["count"]
    assert hprof.native(gzip.compress(data), len(data)) == data
    for bad, why in ((gzip.compress(data), "expands"), (gzip.compress(data)[:-9], "ends early"), (b"\x7fELF", "system_dump")):
        with pytest.raises(ValueError, match=why):
            hprof.native(bad, len(data) - 1 if why == "expands" else len(data))


def dumps_rows(d):
    return sorted(map(tuple, d.drop("dump").collect()), key=repr)


def test_dumps_in_ranges_give_the_same_rows(spark, tmp_path):
    for size in (4, 8):
        (tmp_path / f"h{size}.hprof").write_bytes(build_hprof(size))
    (tmp_path / "h8.hprof.gz").write_bytes(gzip.compress(build_hprof(8)))
    whole = hprof.read_dumps(spark, str(tmp_path))
    cut = hprof.read_dumps(spark, str(tmp_path), range_bytes=40)
    assert dumps_rows(cut) == dumps_rows(whole)
    assert {r.dump for r in cut.select("dump").distinct().collect()} == {r.dump for r in whole.select("dump").distinct().collect()}
    files = spark.createDataFrame([(f"file:{tmp_path}/h8.hprof", len(build_hprof(8)))], "path string, length long")
    rows, left = hprof.read_ranges(spark, files, 40)
    assert rows.rdd.getNumPartitions() > 3 and not left
    assert hprof.read_ranges(spark, files.selectExpr("replace(path, 'file:', 'nosuch://') AS path", "length"), 40)[1] == [f"nosuch://{tmp_path}/h8.hprof"]


def test_records_behind_their_segment_are_errors():
    data = build_hprof(8)
    read = lambda at, n: data[at : at + n]
    start = next(r for r in hprof.record_heads(read, len(data), 1 << 20) if r[0] == "range")
    for cut in (3, 11, 60):
        with pytest.raises(ValueError, match="segment"):
            list(hprof.Range(read, start[1], start[2] - cut, 8).rows(hprof.Layout()))
    with pytest.raises(ValueError, match="file"):
        list(hprof.record_heads(read, len(data) - 20, 1 << 20))


def test_dumps_over_two_gigabytes(spark, tmp_path):
    """A sparse file: an array of 2.2 GB between two instances."""
    i = lambda x: x.to_bytes(8, "big")
    small = build_hprof(8)
    n = 2_200_000_000
    array = b"\x23" + i(0x777) + struct.pack(">II", 0, n) + b"\x08"
    behind = b"\x21" + i(0x778) + struct.pack(">I", 0) + i(0x200) + struct.pack(">I", 20) + i(0x777) + i(0) + struct.pack(">I", 1)
    with open(tmp_path / "big.hprof", "wb") as f:
        f.write(small[: -9])
        f.write(b"\x1c" + struct.pack(">II", 0, len(array) + n + len(behind)) + array)
        f.seek(n, 1)
        f.write(behind + small[-9:])
    t = hprof.tables_of(hprof.read_dumps(spark, str(tmp_path)))
    o = {r.oid: (r.kind, r.shallow, r.length) for r in t["objects"].collect()}
    assert o["0x777"] == ("primitive:8", 2_200_000_016, n) and o["0x778"][0] == "instance" and len(o) == 7
    assert ("0x778", "0x777", "com.acme.Node.next") in {(r.src, r.dst, r.field) for r in t["edges"].collect()}


def test_pairs_are_those_of_the_plain_patterns(spark):
    rng = random.Random(7)
    text = ["".join(rng.choices('abAB_1.9"={}:;, []$|\t', k=rng.randint(0, 60))) for _ in range(4_000)]
    d = spark.createDataFrame([(x,) for x in text], "t string")
    plain = r'(?U)"?([A-Za-z_][A-Za-z0-9_.]*)"?\s*[=:]\s*' + T.VALUE
    site = r"(?U)\b([A-Za-z_][A-Za-z0-9_.$]*):(\d{1,6})\b"
    both = [(F.regexp_extract_all("t", F.lit(p), F.lit(g)), F.regexp_extract_all("t", F.lit(q), F.lit(g))) for p, q in ((plain, T.KV), (site, T.CALL_SITE)) for g in (0, 1, 2)]
    for a, b in both:
        assert d.where(F.size(a) > 0).count() > 20 and d.where(a != b).count() == 0
    assert d.where(~T.call_site(F.col("t")).eqNullSafe(T.found(F.col("t"), site))).count() == 0
    eq = lambda k: r"(?U)(\b[A-Za-z_][A-Za-z0-9_.]*" + k + T.VALUE
    assert d.where(F.regexp_replace("t", eq(r"\s*=\s*)"), "$1?") != F.regexp_replace("t", eq(r"+\s*+=\s*+)"), "$1?")).count() == 0
    ends = lambda k: k.endswith("b")
    whole, kept = F.map_filter(T.payload(F.col("t")), lambda k, _: ends(k)), T.payload(F.col("t"), ends)
    assert d.where(F.to_json(whole) != F.to_json(kept)).count() == 0 and d.where(F.size(kept) > 0).count() > 20


def test_only_errors_get_a_key_where_errors_are_asked_for(spark):
    steps = C.flow_steps(as_lines(spark, "2024-01-01 00:00:01.000 INFO ref=g-1\n2024-01-01 00:00:02.000 ERROR ref=b-2"), "g-1", "b-2", follow_links=False)
    plan = steps.where("is_error").select("key")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Window [", 1)
    assert "TRACE|DEBUG" in above and "TRACE|DEBUG" not in below


def test_lines_that_begin_events_are_those_with_a_header(spark):
    rng = random.Random(8)
    parts = ["2024-03-01T10:00:00.5Z ", "2024-03-01 10:00:00,123 ", "ERROR ", "WARNING", "[http-1] ", "(main) ", "com.acme.Shop: ", "  at a.B.c(D.java:1)", "Caused by: ", '{"level": "INFO"}', "{", "x" * 150, "x" * 500, " "]
    text = ["".join(rng.choices(parts, k=rng.randint(0, 5))) for _ in range(1_000)]
    d = spark.createDataFrame([(x,) for x in text], "t string")
    h = server_log.header(F.col("t"))
    assert 0 < d.where(h.isNotNull()).count() < 1_000 and d.where(h.isNotNull() != server_log.begins(F.col("t"))).count() == 0


def test_headers_are_read_once_an_event(spark):
    """From its first line, of which a JSON object counts as its message."""
    text = json.dumps({"level": "info", "message": "m" * 40_000}) + "\n" + "y" * 33_000
    e = server_log.events(as_lines(spark, text))
    r = e.collect()
    assert [(x.level, x.end_line, x.omitted_chars, x.format) for x in r] == [("INFO", 2, 232 + 40_000 + 1 + 32_768 - 32_768, "json")]
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "thread_name" not in plan[plan.rindex("Aggregate [file") :]
