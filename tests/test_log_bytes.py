"""Byte ranges, digests and counts of what server logs lose."""

import gzip
import hashlib

import pytest
from pyspark.errors import PySparkException

from emberlens.sources import files, lines, server_log

TEXT = "über 2024-03-01T10:00:00Z INFO [a] com.acme.Shop - eins\r\n\tat com.acme.A.b(A.java:1)\n\n2024-03-01T10:00:01Z WARN [b] com.acme.Cart: zwölf \U0001f600\n2024-03-01T10:00:02Z ERROR drei"


def test_places_give_back_the_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(TEXT.encode())
    (tmp_path / "b.log").write_bytes(b"\xef\xbb\xbf" + TEXT.encode() + b"\n")
    (tmp_path / "c.log").write_bytes(b"\xff\xfe broken \xff\nnext\n")
    (tmp_path / "d.log.gz").write_bytes(gzip.compress(TEXT.encode() + b"\n"))
    (tmp_path / "e.log").write_bytes(b"")
    got = lines.read_lines(spark, str(tmp_path), with_bytes=True).orderBy("file", "line_no").collect()
    for name in "abcd":
        own = [r for r in got if f"/{name}.log" in r.file]
        data = (tmp_path / f"{name}.log").read_bytes() if name != "d" else TEXT.encode() + b"\n"
        body = data.removeprefix(b"\xef\xbb\xbf")
        pieces = [data[r.byte_start : r.byte_end] for r in own]
        assert b"".join(pieces) == body and pieces == body.splitlines(keepends=True)
        assert [r.line_no for r in own] == list(range(1, len(own) + 1))
    assert not [r for r in got if "/e.log" in r.file]


def test_small_splits(spark, tmp_path):
    data = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000)).encode()
    (tmp_path / "a.log").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        d = lines.read_lines(spark, str(tmp_path), with_bytes=True)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1
        got = d.orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [data[r.byte_start : r.byte_end] for r in got] == data.splitlines(keepends=True)


def test_events_carry_their_bytes_and_what_they_lost(spark, tmp_path):
    frames = "\n".join(f"\tat com.acme.A.m{i}(A.java:{i})" for i in range(server_log.MAX_FRAMES + 7))
    marks = "\n".join(f"Undeploying context [/a{i}]" for i in range(server_log.MAX_MARKERS + 2))
    first = f"2024-03-01 10:00:00 ERROR [a] com.acme.Shop: gone\n{frames}\n{marks}\n"
    second = "2024-03-01T10:00:01Z INFO [a] com.acme.Shop: " + "y" * (server_log.LINE_CHARS + 10) + "\n"
    third = "2024-03-01T10:00:02Z INFO [a] com.acme.Shop: a � b �\n"
    data = (first + second + third).encode()
    (tmp_path / "a.log").write_bytes(data)
    e = server_log.events(lines.read_lines(spark, str(tmp_path), with_bytes=True))
    a, b, c = e.orderBy("id").collect()
    assert [data[r.byte_start : r.byte_end].decode() for r in (a, b, c)] == [first, second, third]
    assert (a.omitted_frames, a.omitted_markers, len(a.frames), len(a.markers), a.truncated) == (7, 2, server_log.MAX_FRAMES, server_log.MAX_MARKERS, True)
    assert (b.oversized_lines, b.truncated, b.omitted_chars) == (1, True, server_log.LINE_CHARS - server_log.MAX_CHARS) and len(b.excerpt) == server_log.MAX_CHARS
    assert (c.replacement_characters, c.truncated) == (2, False)
    s = server_log.accounts(e).first().asDict()
    assert s.pop("file").endswith("a.log")
    assert s == {"bytes": len(data), "lines": data.count(b"\n"), "events": 3, "truncated_events": 2, "unrecognized_events": 0, "unaligned_timestamps": 1, "oversized_lines": 1, "omitted_frames": 7, "omitted_markers": 2, "omitted_chars": server_log.LINE_CHARS - server_log.MAX_CHARS, "replacement_characters": 2}


def test_digests_of_files(spark, tmp_path):
    data = {"a/x y.log": b"1", "empty.log": b"", "b.log": b"z" * 1000, "c.log": bytes(range(256)) * 40_000}
    folder = str(tmp_path / "out")
    assert files.write_files(spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "name string, data binary"), folder) == 4
    got = {r.path.split("/out/")[1]: (r.length, r.sha256) for r in files.file_digests(spark, folder).collect()}
    assert {k.replace("%20", " "): v for k, v in got.items()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in data.items() if v}
    with pytest.raises(PySparkException):
        files.write_files(spark.createDataFrame([(None, None)], "name string, data binary"), folder)
