"""Heap dumps in HPROF format as tables of objects, edges, roots, classes and array hashes.

Dumps of up to RANGE_BYTES are read by one task each. Larger ones are cut into ranges: one task a dump goes
over the heads of its records, skipping what they hold, then each range is a task that reads the file in
windows, first for class layouts, which are broadcast (their number is that of loaded classes, not of
objects), then for everything. So a dump of any size is read in bounded memory by as many tasks as it has
ranges. Compressed dumps can't be entered in the middle, and files in stores that only Spark opens can't be
entered by tasks; both are read whole, up to what a binary value holds. Ids become hex text, since they may
exceed a signed long.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.session import ship_package, write_table
from emberlens.sources.files import WINDOW, opened

# fixed values: element widths by type, bytes behind the id of each kind of root, array type names
WIDTH = {4: 1, 5: 2, 6: 4, 7: 8, 8: 1, 9: 2, 10: 4, 11: 8}
ROOT_EXTRA = {0xFF: 0, 0x01: None, 0x02: 8, 0x03: 8, 0x04: 4, 0x05: 0, 0x06: 4, 0x07: 0, 0x08: 8}
ROOT_KIND = {0xFF: "unknown", 0x01: "jni_global", 0x02: "jni_local", 0x03: "java_frame", 0x04: "native_stack", 0x05: "sticky_class", 0x06: "thread_block", 0x07: "monitor", 0x08: "thread"}
PRIMITIVE = {4: "boolean", 5: "char", 6: "float", 7: "double", 8: "byte", 9: "short", 10: "int", 11: "long"}
REFERENT = "java.lang.ref.Reference.referent"
SCHEMA = "dump string, table string, a string, b string, c string, d string, n long, m long"


# fixed values: how files of each kind begin
ELF_AND_OTHERS = (b"\x7fELF", b"\xfe\xed\xfa\xcf", b"\xcf\xfa\xed\xfe", b"MDMP")
EXPANDED_BYTES = 2 << 30


def heap_format(head: bytes) -> str:
    """What kind of dump a file begins like."""
    head = head[:512]
    if head.startswith(b"JAVA PROFILE 1.0."):
        return "hprof"
    if head.startswith(b"\x1f\x8b"):
        return "gzip"
    if b"portable heap dump" in head[:40]:
        return "phd"
    if head.startswith(ELF_AND_OTHERS):
        return "system_dump"
    if b"0SECTION" in head or b"1TISIGINFO" in head:
        return "javacore"
    return "classic" if b"// Version:" in head or b"// JVM version:" in head else "unknown"


def heap_formats(files: DataFrame) -> DataFrame:
    """path, format of files (path, content): what ``heap_format`` says of their heads, as columns; a null content
    is unknown."""
    # as one character a byte
    head = F.decode(F.substring("content", 1, 512), "ISO-8859-1")
    begins = lambda *xs: reduce(lambda a, b: a | b, [head.startswith(x.decode("latin-1")) for x in xs])
    kind = F.when(begins(b"JAVA PROFILE 1.0."), "hprof").when(begins(b"\x1f\x8b"), "gzip").when(F.substring(head, 1, 40).contains("portable heap dump"), "phd").when(begins(*ELF_AND_OTHERS), "system_dump")
    kind = kind.when(head.contains("0SECTION") | head.contains("1TISIGINFO"), "javacore").when(head.contains("// Version:") | head.contains("// JVM version:"), "classic")
    return files.select("path", F.coalesce(kind, F.lit("unknown")).alias("format"))


def native(data: bytes, most: int = EXPANDED_BYTES) -> bytes:
    """The bytes of an HPROF dump, expanded if they are compressed, up to a budget; other kinds are refused."""
    kind = heap_format(data)
    if kind == "gzip":
        out, at, more = [], 0, data
        while more:  # a file may have several members
            d = zlib.decompressobj(31)
            part = d.decompress(more, most - at + 1)
            at += len(part)
            if at > most:
                raise ValueError(f"the dump expands to more than {most} bytes")
            out.append(part)
            if not d.eof:
                raise ValueError("the compressed dump ends early")
            more = d.unused_data
        data = b"".join(out)
        kind = heap_format(data)
    if kind != "hprof":
        raise ValueError(f"{kind} isn't a heap dump that is read here")
    return data


class Dump:
    """One dump, walked record by record."""

    def __init__(self, data: bytes):
        end = data.index(b"\0")
        self.data, (self.id_size,) = data, struct.unpack_from(">I", data, end + 1)
        if self.id_size not in (4, 8):
            raise ValueError(f"ids of {self.id_size} bytes")
        self.start = end + 13
        self.names: dict[int, str] = {}
        self.class_name: dict[int, str] = {}
        self.layout: dict[int, tuple[int, list[tuple[str, int]]]] = {}

    def _id(self, at: int) -> int:
        return int.from_bytes(self.data[at : at + self.id_size], "big")

    def _records(self) -> Iterator[tuple[int, int, int]]:
        at, n = self.start, len(self.data)
        while at + 9 <= n:
            tag, (length,) = self.data[at], struct.unpack_from(">I", self.data, at + 5)
            if at + 9 + length > n:
                raise ValueError("a record ends behind the file")
            yield tag, at + 9, length
            at += 9 + length

    def _value(self, at: int, kind: int) -> tuple[int | None, int]:
        if kind == 2:
            return self._id(at), at + self.id_size
        return None, at + WIDTH[kind]

    def _class(self, at: int) -> tuple[dict, int]:
        d, i = self.data, self.id_size
        c = {"id": self._id(at), "super": self._id(at + i + 4), "loader": self._id(at + 2 * i + 4), "statics": [], "fields": []}
        at += 7 * i + 8
        (n,) = struct.unpack_from(">H", d, at)
        at += 2
        for _ in range(n):
            _, at = self._value(at + 3, d[at + 2])
        (n,) = struct.unpack_from(">H", d, at)
        at += 2
        for _ in range(n):
            name = self.names.get(self._id(at), "?")
            kind = d[at + i]
            ref, at = self._value(at + i + 1, kind)
            if kind == 2 and ref:
                c["statics"].append((name, ref))
        (n,) = struct.unpack_from(">H", d, at)
        at += 2
        for _ in range(n):
            c["fields"].append((self.names.get(self._id(at), "?"), d[at + i]))
            at += i + 1
        return c, at

    def _heap(self, classes_only: bool) -> Iterator[tuple]:
        d, i = self.data, self.id_size
        for tag, at, length in self._records():
            if tag not in (0x0C, 0x1C):
                continue
            end = at + length
            while at < end:
                sub = d[at]
                at += 1
                if sub in ROOT_EXTRA:
                    if not classes_only:
                        yield "root", self._id(at), ROOT_KIND[sub]
                    extra = ROOT_EXTRA[sub]
                    at += i + (i if extra is None else extra)  # a global reference carries a second id
                elif sub == 0x20:
                    c, at = self._class(at)
                    yield "class", c
                elif sub == 0x21:
                    oid, cls = self._id(at), self._id(at + i + 4)
                    (n,) = struct.unpack_from(">I", d, at + 2 * i + 4)
                    if not classes_only:
                        yield "instance", oid, cls, at + 2 * i + 8, n
                    at += 2 * i + 8 + n
                elif sub == 0x22:
                    oid = self._id(at)
                    (n,) = struct.unpack_from(">I", d, at + i + 4)
                    if not classes_only:
                        yield "objects", oid, self._id(at + i + 8), at + 2 * i + 8, n
                    at += 2 * i + 8 + n * i
                elif sub == 0x23:
                    oid = self._id(at)
                    (n,) = struct.unpack_from(">I", d, at + i + 4)
                    kind = d[at + i + 8]
                    if not classes_only:
                        yield "prims", oid, kind, at + i + 9, n
                    at += i + 9 + n * WIDTH[kind]
                else:
                    raise ValueError(f"unknown heap record {sub:#x}")

    def rows(self) -> Iterator[tuple]:
        """(table, a, b, c, d, n, m) of all tables, classes before what needs their layouts."""
        d, i = self.data, self.id_size
        oop = 4
        for tag, at, length in self._records():
            if tag == 0x01:
                self.names[self._id(at)] = d[at + i : at + length].decode("utf-8", "replace")
            elif tag == 0x02:
                self.class_name[self._id(at + 4)] = self.names.get(self._id(at + 8 + i), "?").replace("/", ".")
        for _, c in self._heap(True):
            name = self.class_name.get(c["id"], "?")
            self.layout[c["id"]] = (c["super"], [(f"{name}.{f}", kind) for f, kind in c["fields"]])
            yield "class", hex(c["id"]), name, hex(c["super"]) if c["super"] else None, hex(c["loader"]), 0, 0
            yield "object", hex(c["id"]), hex(c["id"]), "class", None, 0, 0
            for f, ref in c["statics"]:
                yield "edge", hex(c["id"]), hex(ref), f"static:{f}", "strong", 0, 0
            for f, ref in (("<superclass>", c["super"]), ("<classloader>", c["loader"])):
                if ref:
                    yield "edge", hex(c["id"]), hex(ref), f, "strong", 0, 0
        align = lambda n: (n + 7) // 8 * 8
        head, array_head = (12, 16) if i == 8 else (8, 12)
        for what, *r in self._heap(False):
            if what == "root":
                yield "root", hex(r[0]), r[1], None, None, 0, 0
            elif what == "instance":
                oid, cls, at, n = r
                refs, c, p = 0, cls, at
                yield "edge", hex(oid), hex(cls), "<class>", "strong", 0, 0
                while c in self.layout:
                    up, fields = self.layout[c]
                    for f, kind in fields:
                        ref, p = self._value(p, kind)
                        refs += kind == 2
                        if ref:
                            yield "edge", hex(oid), hex(ref), f, "weak" if f == REFERENT else "strong", 0, 0
                    c = up
                yield "object", hex(oid), hex(cls), "instance", None, align(head + n - (i - oop) * refs), 0
            elif what == "objects":
                oid, cls, at, n = r
                yield "object", hex(oid), hex(cls), "object_array", None, align(array_head + n * oop), n
                for k in range(n):
                    if ref := self._id(at + k * i):
                        yield "edge", hex(oid), hex(ref), f"[{k}]", "strong", 0, 0
            elif what == "prims":
                oid, kind, at, n = r
                yield "object", hex(oid), f"prim:{PRIMITIVE[kind]}[]", f"primitive:{kind}", None, align(array_head + n * WIDTH[kind]), n
                yield "hash", hex(oid), hashlib.sha256(d[at : at + n * WIDTH[kind]]).hexdigest(), None, None, kind, n


def _walk(expanded_bytes: int):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                held: list[tuple] = []
                for row in Dump(native(data.as_py(), expanded_bytes)).rows():
                    held.append((path, *row))
                    if len(held) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return run


# ---- ranges of large dumps

#: Bytes of a dump from which on it is read in ranges, about so many bytes a task.
RANGE_BYTES = 16 << 20
HEADS = "path string, kind string, a bigint, b bigint, id_size int, text string"
CLASSES = "path string, cid bigint, super bigint, statics array<bigint>, fields array<struct<name: bigint, kind: int>>"


@dataclass
class Layout:
    """What a range needs of its dump's classes; ids are unsigned."""

    names: dict[int, str] = field(default_factory=dict)
    class_name: dict[int, str] = field(default_factory=dict)
    fields: dict[int, tuple[int, list[tuple[str, int]]]] = field(default_factory=dict)
    flat: dict[int, tuple[int, list[tuple[int, str, str]]]] = field(default_factory=dict)

    def references(self, cls: int, id_size: int) -> tuple[int, list[tuple[int, str, str]]]:
        """How many fields of instances hold references, and their offsets, names and strengths."""
        got = self.flat.get(cls)
        if got is None:
            at, out, c, seen = 0, [], cls, set()
            while c in self.fields and c not in seen:
                seen.add(c)
                up, own = self.fields[c]
                for f, kind in own:
                    if kind == 2:
                        out.append((at, f, "weak" if f == REFERENT else "strong"))
                    at += id_size if kind == 2 else WIDTH[kind]
                c = up
            got = self.flat[cls] = (len(out), out)
        return got


class Range:
    """Heap records between two offsets of a dump, read in windows."""

    def __init__(self, read: Callable[[int, int], bytes], start: int, end: int, id_size: int):
        self.read, self.at, self.end, self.i = read, start, end, id_size
        self.id = struct.Struct(">Q" if id_size == 8 else ">I").unpack_from
        self.buf, self.base = b"", start

    def hold(self, n: int) -> int:
        """Have n bytes from here on in the buffer; where they begin in it."""
        if self.at + n > self.end:
            raise ValueError("a heap record ends behind its segment")
        p = self.at - self.base
        if p < 0 or p + n > len(self.buf):
            self.buf, self.base = self.read(self.at, min(max(n, WINDOW), self.end - self.at)), self.at
            return 0
        return p

    def pieces(self, at: int, n: int) -> Iterator[bytes]:
        """n bytes from an offset on, at most a window at a time."""
        p = at - self.base
        if 0 <= p and p + n <= len(self.buf):
            yield self.buf[p : p + n]
            return
        for k in range(0, n, WINDOW):
            yield self.read(at + k, min(WINDOW, n - k))

    def _class(self) -> tuple[int, int, int, list[tuple[int, int]], list[tuple[int, int]], int]:
        """id, super, loader, references of statics (name, value), fields (name, kind), length."""
        want, i = 1 << 16, self.i
        while True:
            p = self.hold(min(want, self.end - self.at))
            d, at = self.buf, p + 1
            try:
                (cid,), (up,), (loader,) = self.id(d, at), self.id(d, at + i + 4), self.id(d, at + 2 * i + 4)
                at += 7 * i + 8
                (n,) = struct.unpack_from(">H", d, at)
                at += 2
                for _ in range(n):
                    at += 3 + (i if d[at + 2] == 2 else WIDTH[d[at + 2]])
                (n,) = struct.unpack_from(">H", d, at)
                at += 2
                statics = []
                for _ in range(n):
                    (name,), kind = self.id(d, at), d[at + i]
                    if kind == 2 and (ref := self.id(d, at + i + 1)[0]):
                        statics.append((name, ref))
                    at += i + 1 + (i if kind == 2 else WIDTH[kind])
                (n,) = struct.unpack_from(">H", d, at)
                at += 2
                fields = []
                for _ in range(n):
                    fields.append((self.id(d, at)[0], d[at + i]))
                    at += i + 1
                return cid, up, loader, statics, fields, at - p
            except (struct.error, IndexError):
                if want >= self.end - self.at:
                    raise ValueError("a class record ends behind its segment") from None
                want *= 8

    def records(self) -> Iterator[tuple]:
        """(kind, offset behind it, ...) of each record; what arrays and instances hold isn't read yet."""
        i = self.i
        while self.at < self.end:
            p = self.hold(1)
            sub = self.buf[p]
            if sub in ROOT_EXTRA:
                p = self.hold(1 + i)
                extra = ROOT_EXTRA[sub]
                out = "root", self.at + 1 + i + (i if extra is None else extra), self.id(self.buf, p + 1)[0], ROOT_KIND[sub]
            elif sub == 0x20:
                *c, n = self._class()
                out = "class", self.at + n, *c
            elif sub == 0x21:
                p = self.hold(9 + 2 * i)
                (n,) = struct.unpack_from(">I", self.buf, p + 5 + 2 * i)
                out = "instance", self.at + 9 + 2 * i + n, self.id(self.buf, p + 1)[0], self.id(self.buf, p + 5 + i)[0], n
            elif sub == 0x22:
                p = self.hold(9 + 2 * i)
                (n,) = struct.unpack_from(">I", self.buf, p + 5 + i)
                out = "objects", self.at + 9 + 2 * i + n * i, self.id(self.buf, p + 1)[0], self.id(self.buf, p + 9 + i)[0], n
            elif sub == 0x23:
                p = self.hold(10 + i)
                (n,) = struct.unpack_from(">I", self.buf, p + 5 + i)
                kind = self.buf[p + 9 + i]
                out = "prims", self.at + 10 + i + n * WIDTH[kind], self.id(self.buf, p + 1)[0], kind, n
            else:
                raise ValueError(f"unknown heap record {sub:#x}")
            if out[1] > self.end:
                raise ValueError("a heap record ends behind its segment")
            yield out
            self.at = out[1]

    def rows(self, of: Layout) -> Iterator[tuple]:
        """The rows of all records, as ``Dump.rows`` has them."""
        i, oop = self.i, 4
        head, array_head = (12, 16) if i == 8 else (8, 12)
        align = lambda n: (n + 7) // 8 * 8
        for what, end, oid, *r in self.records():
            me = hex(oid)
            if what == "instance":
                cls, n = r
                n_refs, refs = of.references(cls, i)
                yield "edge", me, hex(cls), "<class>", "strong", 0, 0
                if refs:
                    p = self.hold(end - self.at) + end - self.at - n
                    for at, f, strength in refs:
                        if ref := self.id(self.buf, p + at)[0]:
                            yield "edge", me, hex(ref), f, strength, 0, 0
                yield "object", me, hex(cls), "instance", None, align(head + n - (i - oop) * n_refs), 0
            elif what == "objects":
                cls, n = r
                yield "object", me, hex(cls), "object_array", None, align(array_head + n * oop), n
                k = 0
                for piece in self.pieces(end - n * i, n * i):
                    for (ref,) in struct.iter_unpack(">Q" if i == 8 else ">I", piece):
                        if ref:
                            yield "edge", me, hex(ref), f"[{k}]", "strong", 0, 0
                        k += 1
            elif what == "prims":
                kind, n = r
                digest = hashlib.sha256()
                for piece in self.pieces(end - n * WIDTH[kind], n * WIDTH[kind]):
                    digest.update(piece)
                yield "object", me, f"prim:{PRIMITIVE[kind]}[]", f"primitive:{kind}", None, align(array_head + n * WIDTH[kind]), n
                yield "hash", me, digest.hexdigest(), None, None, kind, n
            elif what == "root":
                yield "root", me, r[0], None, None, 0, 0
            else:
                up, loader, statics, _ = r
                yield "class", me, of.class_name.get(oid, "?"), hex(up) if up else None, hex(loader), 0, 0
                yield "object", me, me, "class", None, 0, 0
                for name, ref in statics:
                    yield "edge", me, hex(ref), f"static:{of.names.get(name, '?')}", "strong", 0, 0
                for f, ref in (("<superclass>", up), ("<classloader>", loader)):
                    if ref:
                        yield "edge", me, hex(ref), f, "strong", 0, 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _unsigned(x: int) -> int:
    return x & 0xFFFFFFFFFFFFFFFF


def record_heads(read: Callable[[int, int], bytes], size: int, range_bytes: int) -> Iterator[tuple]:
    """(kind, a, b, id_size, text): names and loaded classes of a dump, and ranges of whole heap records."""
    head = read(0, min(64, size))
    end = head.index(b"\0")
    (i,) = struct.unpack_from(">I", head, end + 1)
    if i not in (4, 8):
        raise ValueError(f"ids of {i} bytes")
    as_id, at, buf, base = struct.Struct(">Q" if i == 8 else ">I").unpack_from, end + 13, b"", 0
    start = stop = None

    def cut() -> Iterator[tuple]:
        if start is not None:
            yield "range", start, stop, i, None

    while at + 9 <= size:
        p = at - base
        if p < 0 or p + 9 + 64 > len(buf):
            buf, base, p = read(at, min(1 << 16, size - at)), at, 0
        tag, (length,) = buf[p], struct.unpack_from(">I", buf, p + 5)
        if at + 9 + length > size:
            raise ValueError("a record ends behind the file")
        if tag in (0x0C, 0x1C):
            # ranges end where records do; a segment is a range of its own as heads of others lie between
            if length > range_bytes:
                r = Range(read, at + 9, at + 9 + length, i)
                start = at + 9
                for _, stop, *_ in r.records():
                    if stop - start >= range_bytes:
                        yield from cut()
                        start = stop
                if start < at + 9 + length:
                    stop = at + 9 + length
                    yield from cut()
            else:
                start, stop = at + 9, at + 9 + length
                yield from cut()
        elif tag == 0x01:
            text = read(at + 9, length) if p + 9 + length > len(buf) else buf[p + 9 : p + 9 + length]
            yield "name", _signed(as_id(text, 0)[0]), None, i, text[i:].decode("utf-8", "replace")
        elif tag == 0x02:
            text = read(at + 9, length) if p + 9 + length > len(buf) else buf[p + 9 : p + 9 + length]
            yield "load", _signed(as_id(text, 4)[0]), _signed(as_id(text, 8 + i)[0]), i, None
        at += 9 + length


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()), "array<struct<name: bigint, kind: int>>": pa.list_(pa.struct([("name", pa.int64()), ("kind", pa.int32())]))}
    names, types = zip(*[f.split(" ", 1) for f in schema.replace(", kind: int>", ";kind: int>").split(", ")])
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t.replace(";", ", ")]) for c, t in zip(zip(*held, strict=True), types, strict=True)], list(names))

    for row in rows:
        held.append(row)
        if len(held) == 20_000:
            yield out()
            held = []
    if held:
        yield out()


def _heads(range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                read = opened(path)
                if read is None or heap_format(read(0, min(512, size))) != "hprof":
                    yield from _batches(iter([(path, "whole", None, None, None, None)]), HEADS)
                else:
                    yield from _batches(((path, *row) for row in record_heads(read, size, range_bytes)), HEADS)

    return run


def _ranges(b: pa.RecordBatch) -> Iterator[tuple[str, Range]]:
    for r in b.to_pylist():
        yield r["path"], Range(opened(r["path"]), r["a"], r["b"], r["id_size"])


def _class_layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, r in _ranges(b):
            rows = ((path, _signed(c[0]), _signed(c[1]), [_signed(n) for n, _ in c[3]], [{"name": _signed(n), "kind": k} for n, k in c[4]]) for what, _, *c in r.records() if what == "class")
            yield from _batches(rows, CLASSES)


def _objects(layouts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, r in _ranges(b):
                yield from _batches(((path, *row) for row in r.rows(layouts.value.get(path) or Layout())), SCHEMA)

    return run


def read_ranges(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, list[str]]:
    """SCHEMA of the dumps (path, length) that can be read in ranges, a task for each, and the paths of the others."""
    n_files = max(1, files.count())
    heads = write_table(files.select("path", "length").repartition(n_files).mapInArrow(_heads(range_bytes), HEADS), "hprof-heads")
    whole = [r.path for r in heads.where("kind = 'whole'").select("path").collect()]
    ranges = heads.where("kind = 'range'").select("path", "a", "b", "id_size")
    some = ranges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("b") - F.col("a")), F.lit(0)).alias("size")).first()
    # dumps of small segments have several of them in a task
    n = max(1, min(some.n, max(-(-some.size // range_bytes), spark.sparkContext.defaultParallelism)))
    classes = write_table(ranges.repartition(n).mapInArrow(_class_layouts, CLASSES), "hprof-classes")
    loads = heads.where("kind = 'load'").select("path", F.col("a").alias("cid"), F.col("b").alias("name"))
    used = classes.select("path", F.explode(F.concat("statics", F.transform("fields", lambda f: f["name"]))).alias("a")).unionByName(loads.select("path", F.col("name").alias("a"))).distinct()
    names = heads.where("kind = 'name'").select("path", "a", "text").join(used, ["path", "a"], "left_semi")
    of: dict[str, Layout] = {}
    mine = lambda r: of.setdefault(r.path, Layout())
    for r in names.toLocalIterator():
        mine(r).names[_unsigned(r.a)] = r.text
    for r in loads.toLocalIterator():
        mine(r).class_name[_unsigned(r.cid)] = mine(r).names.get(_unsigned(r.name), "?").replace("/", ".")
    for r in classes.toLocalIterator():
        name = mine(r).class_name.get(_unsigned(r.cid), "?")
        mine(r).fields[_unsigned(r.cid)] = (_unsigned(r.super), [(f"{name}.{mine(r).names.get(_unsigned(f['name']), '?')}", f["kind"]) for f in r.fields])
    return ranges.repartition(n).mapInArrow(_objects(spark.sparkContext.broadcast(of)), SCHEMA), whole


def read_dumps(spark: SparkSession, path: str, expanded_bytes: int = EXPANDED_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All rows of all dumps below a path, compressed ones included; tables_of splits them."""
    ship_package(spark)
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = d.where(F.col("length") > range_bytes).select("path", "length")
    if large.isEmpty():
        return d.select("path", "content").mapInArrow(_walk(expanded_bytes), SCHEMA)
    rows, whole = read_ranges(spark, large, range_bytes)
    rest = d.where((F.col("length") <= range_bytes) | F.col("path").isin(whole)).select("path", "content")
    return rows.unionByName(rest.mapInArrow(_walk(expanded_bytes), SCHEMA))


def tables_of(rows: DataFrame) -> dict[str, DataFrame]:
    """objects, classes, edges, roots and array_hashes in the shape that heap operators take."""
    t = lambda name: rows.where(F.col("table") == name)
    c = lambda **k: [F.col(v).alias(n) for n, v in k.items()]
    classes = t("class").select(*c(dump="dump", cid="a", name="b", super="c", loader="d"))
    prims = t("object").where(F.col("b").startswith("prim:")).select("dump", F.col("b").alias("cid"), F.substring("b", 6, 40).alias("name"), F.lit(None).cast("string").alias("super"), F.lit("0x0").alias("loader")).distinct()
    return {
        "objects": t("object").select(*c(dump="dump", oid="a", class_id="b", kind="c", shallow="n", length="m")),
        "classes": classes.unionByName(prims),
        "edges": t("edge").select(*c(dump="dump", src="a", dst="b", field="c", strength="d")),
        "roots": t("root").select(*c(dump="dump", node="a", kind="b")),
        "array_hashes": t("hash").select(*c(dump="dump", oid="a", digest="b", etype="n")),
    }
