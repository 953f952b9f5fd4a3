"""Product quantisation of vectors, codebooks by Lloyd's rounds under Hamerly's bounds, in integers.

Components become floor(scale * x); a vector is cut into ``parts`` equal runs, and every part position
has a codebook of its own. Between rounds each part of each vector keeps the entry it was assigned, one
upper bound of its distance to that entry and one lower bound of its distance to the second nearest.
After a round the upper bound grows by the way its entry went, the lower one shrinks by the longest way
of any other entry. As long as the upper bound stays strictly below the lower one, or below half the way
from its entry to the nearest other, no other entry can be as near, so nothing is computed. Else the
upper bound is made exact, and only if it fails again all entries are scanned, in integers, ties to the
lower index. Bounds are rounded outwards, so that floating point never decides anything.

A round is one pass of tasks over the table of vectors and bounds, which is written to the shared folder
and read by the next round; the table before it is deleted. Tasks also write what their parts that moved
add to and take from sums of entries; those are added up by Spark and give the driver one number (in
pieces of 32 bits, so that they stay exact) for each component of the codebooks, however many vectors
there are. Rounds end early when nothing moved, as all further ones would then repeat.

Defined results: vectors that are null or hold null or non-finite components take no part; null ids come
last in the order that picks the first entries, rows that share an id are ordered by their components;
fewer vectors than entries make smaller codebooks; vectors whose length isn't a multiple of ``parts`` or
of unequal length, empty and very long ones included, are padded with zeros to the longest; rows that
repeat are coded each; components of any magnitude are exact, and errors that a long can't hold are given
as the largest long; null labels are one label; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlens.llm.lookup import look_up
from emberlens.session import delete_path, ship_package, table_path, write_table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Outward rounding of bounds, far above the errors of a few operations on doubles.
SLACK = 1e-12
LIMB = 32
LONG = 2**63


def _root(d2: int, up: bool) -> float:
    """The square root of a whole number, rounded outwards."""
    try:
        return math.sqrt(d2) * (1 + SLACK if up else 1 - SLACK)
    except OverflowError:
        r = math.isqrt(d2)
    try:
        return float(r + 1) * (1 + SLACK) if up else float(r) * (1 - SLACK)
    except OverflowError:
        return math.inf if up else 1e308


def _roots(d2: np.ndarray, up: bool) -> np.ndarray:
    if d2.dtype == object:
        return np.array([_root(x, up) for x in d2.ravel()], dtype=float).reshape(d2.shape)
    return np.sqrt(d2.astype(float)) * (1 + SLACK if up else 1 - SLACK)


@dataclass
class Codebooks:
    """entries: whole numbers [part, entry, component], of Python where longs can't hold distances."""

    entries: np.ndarray
    went: np.ndarray | None = None  # [part, entry] upper bounds of the last way of each entry

    def __post_init__(self) -> None:
        parts, k, dims = self.entries.shape
        e = self.entries.astype(object)
        self.reach = max((abs(int(x)) for x in e.ravel()), default=0)
        apart = np.full((parts, k), math.inf)
        for p in range(parts):
            for a in range(k):
                for b in range(a):
                    far = _root(int(((e[p, a] - e[p, b]) ** 2).sum()), False) / 2
                    apart[p, a], apart[p, b] = min(apart[p, a], far), min(apart[p, b], far)
        self.half = apart  # lower bounds of half the way to the nearest other entry
        if self.went is not None and k > 1:
            order = np.sort(self.went, axis=1)
            top, second = order[:, -1:], order[:, -2:-1]
            first = np.arange(k)[None, :] == self.went.argmax(axis=1)[:, None]
            self.others_went = np.where(first, second, top)  # the longest way of any other entry
        elif self.went is not None:
            self.others_went = np.zeros_like(self.went)

    def moved_to(self, entries: np.ndarray) -> Codebooks:
        way = [[_root(int(((entries[p, a].astype(object) - self.entries[p, a].astype(object)) ** 2).sum()), True) for a in range(entries.shape[1])] for p in range(entries.shape[0])]
        return Codebooks(entries, np.array(way))

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def whole_parts(v: pa.Array, width: int, scale: int, parts: int, reach: int) -> np.ndarray:
    """floor(scale * x) [vector, part, component] of lists of doubles, padded; longs if distances to entries
    of at most ``reach`` fit them, else Python's integers."""
    lists = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    n = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    x = np.zeros((len(n), width))
    rows = np.repeat(np.arange(len(n)), n)
    x[rows, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    top = float(np.abs(flat).max(initial=0))
    if top < 2**52 and width // parts * (top * scale + 1 + reach) ** 2 < 2.0**62:
        whole = np.floor(x * scale).astype(np.int64)
    else:
        # a double of 2**53 or more is whole; smaller ones times the scale stay exact
        whole = np.array([int(c) * scale if abs(c) >= 2**53 else math.floor(c * scale) for c in x.ravel().tolist()], dtype=object).reshape(x.shape)
    return whole.reshape(len(n), parts, width // parts)


def assign(x: np.ndarray, books: Codebooks, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """own, upper, lower [vector, part] for these codebooks and the number of full scans. Without own: all are scanned."""
    n, parts, _ = x.shape
    entries = books.entries.astype(x.dtype)
    at_part = np.broadcast_to(np.arange(parts), (n, parts))
    if own is None:
        own, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))
        scan = np.ones((n, parts), bool)
    else:
        own, upper, lower = own.copy(), upper.copy(), lower.copy()
        if books.went is not None:
            upper = (upper + books.went[at_part, own]) * (1 + SLACK)
            less = books.others_went[at_part, own]
            lower = np.where(np.isinf(lower), lower, lower - less - (np.abs(lower) + less) * SLACK)
        bound = np.maximum(lower, books.half[at_part, own])
        scan = ~(upper < bound)
        i, p = np.nonzero(scan)
        upper[i, p] = _roots(((x[i, p] - entries[p, own[i, p]]) ** 2).sum(-1), True)
        scan[i, p] = ~(upper[i, p] < bound[i, p])
    for p in range(parts):
        i = np.flatnonzero(scan[:, p])
        if not len(i):
            continue
        d2 = ((x[i, p][:, None, :] - entries[p][None, :, :]) ** 2).sum(-1)
        best = d2.argmin(axis=1)  # the first of equals
        own[i, p], upper[i, p] = best, _roots(d2[np.arange(len(i)), best], True)
        lower[i, p] = _roots(np.sort(d2, axis=1)[:, 1], False) if d2.shape[1] > 1 else math.inf
    return own, upper, lower, int(scan.sum())


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, m = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m), pa.int32()), pa.array(x.ravel(), kind))


def _read(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts)


_STATE = "vec_id bigint, label string, v array<double>, own array<int>, upper array<double>, lower array<double>, slot int, limb int, part bigint"


def _round(books: Codebooks, width: int, scale: int, first: bool):
    """Assigns every part; vectors and bounds go on, and after them rows (slot, limb, part) of what the task's
    parts that moved change in counts and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, dims = books.entries.shape
        change = np.zeros((parts, k, dims + 1), dtype=object)
        schema = None
        for b in batches:
            if not b.num_rows:
                continue
            x = whole_parts(b.column("v"), width, scale, parts, books.reach)
            old = None if first else _read(b.column("own"), parts)
            own, upper, lower, _ = assign(x, books, old, *((None, None) if first else (_read(b.column(c), parts) for c in ("upper", "lower"))))
            for p in range(parts):
                moved = np.arange(len(own)) if first else np.flatnonzero(own[:, p] != old[:, p])
                for sign, to in ((1, own), (-1, old)):
                    if to is not None and len(moved):
                        entry = to[moved, p].astype(np.int64)
                        sums = np.zeros((k, dims), dtype=x.dtype)
                        np.add.at(sums, entry, x[moved, p])
                        change[p, :, :dims] += sign * sums.astype(object)
                        change[p, :, dims] += sign * np.bincount(entry, minlength=k).astype(object)
            n = len(own)
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64())]
            out = pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), _lists(own, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64()), *none], [c.split()[0] for c in _STATE.split(", ")])
            schema = out.schema
            yield out
        if schema is None:
            return
        rows = []
        for slot, value in enumerate(change.ravel()):
            sign, rest, limb = (-1 if value < 0 else 1), abs(int(value)), 0
            while rest:
                rows.append((slot, limb, sign * (rest & (1 << LIMB) - 1)))
                rest, limb = rest >> LIMB, limb + 1
        held = [pa.nulls(len(rows), f.type) for f in schema][:6]
        yield pa.RecordBatch.from_arrays([*held, *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]], schema=schema)

    return run


def _coded(books: Codebooks, width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = books.entries.shape[0]
        for b in batches:
            if not b.num_rows:
                continue
            x = whole_parts(b.column("v"), width, scale, parts, books.reach)
            own, *_ = assign(x, books, *(_read(b.column(c), parts) for c in ("own", "upper", "lower")))
            entries = books.entries.astype(x.dtype)
            error = sum(((x[:, p] - entries[p, own[:, p]]) ** 2).sum(-1).astype(object) for p in range(parts))
            codes = ["".join(f"{int(c):02x}" for c in row) for row in own]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array([min(int(e), LONG - 1) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every vector and the codebooks (None without any vector); at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits: 1 to 256 entries")
    spark = vectors.sparkSession
    ship_package(spark)
    fine = F.forall(F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.where(F.col(vec_col).isNotNull()).where(F.coalesce(fine, F.lit(False)))
    kept = kept.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(F.col(vec_col), lambda c: c.cast("double")).alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), None
    width = max(1, -(-longest // parts)) * parts
    seeds = kept.orderBy(F.col("vec_id").isNull(), "vec_id", "v").limit(entries).select("v").collect()
    start = whole_parts(pa.array([r.v for r in seeds], pa.list_(pa.float64())), width, scale, parts, LONG)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)).astype(object))
    totals = np.zeros((parts, len(seeds), width // parts + 1), dtype=object)

    state, path = kept, None
    for r in range(rounds):
        new = table_path(spark, f"codes-{r}")
        state.mapInArrow(_round(books, width, scale, r == 0), _STATE).write.parquet(new)
        if path:
            delete_path(spark, path)
        path = new
        table = spark.read.schema(_STATE).parquet(path)
        changes = table.where("slot is not null").groupBy("slot", "limb").agg(F.sum("part").alias("part")).collect()
        state = table.where("slot is null").select("vec_id", "label", "v", "own", "upper", "lower")
        flat = totals.ravel()
        for c in changes:
            flat[c.slot] += c.part << (LIMB * c.limb)
        totals = flat.reshape(totals.shape)
        counts, sums = totals[:, :, -1:], totals[:, :, :-1]
        books = books.moved_to(np.where(counts > 0, sums // np.where(counts > 0, counts, 1), books.entries))
        if not changes:
            break  # nothing moved: all further rounds repeat this one
    return state.mapInArrow(_coded(books, width, scale), "vec_id bigint, label string, code string, error bigint"), books


def coded_with_labels(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **options: int) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels), codebooks_sha256."""
    codes, books = compress(vectors, id_col=id_col, vec_col=vec_col, label_col=label_col, **options)
    digest = books.digest() if books else ""
    if books:
        codes = write_table(codes, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONG - 1).cast("decimal(38,0)")).cast("bigint")
    labels = codes.groupBy("label").agg(total.alias("label_error"))
    out = look_up(codes, labels, ["label"], how="left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
