"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Components are turned into integers, floor(scale * x). A block of the index holds its postings in
segments of descending quantised impact: segment s has the components whose magnitude lies in
[2**s, 2**(s + 1)), in the dimensions that have any, and the norm of what each vector holds in the
segments after it. Scores accumulate a segment at a time for a block of queries. After each segment
the components still to come bound every score from both sides (Cauchy-Schwarz). Accumulation stops
only when that proves all but a few vectors out of the top k, or when no segment is left; the possible
members are then rescored exactly, in integers as wide as they need. Each tile gives its own k best,
and those meet in a final ranking.

The stated query set meets all rows in tiles of at most INDEX_BLOCK rows and QUERY_BLOCK queries: n
rows and m queries are copied m / QUERY_BLOCK and n / INDEX_BLOCK times. Rows and queries are dealt by
a hash, so tiles are even whatever the vectors; rows that repeat are one row with a count.

Defined results: vectors that are null or hold null or non-finite components, and rows with null id
take no part; a row that repeats, id and vector, is as many candidates as there are of it, and asks as
often, its own row alone left out; rows that share an id with other vectors are rows of their own;
vectors of unequal length, very long ones included, are padded with zeros; ties go to the smaller id; a
score that a long can't hold takes part with its exact value and is given as the nearest long; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.session import ship_package

INDEX_BLOCK, QUERY_BLOCK = 16_384, 8_192
#: Queries that are scored together, and the share of their scores that may be left to rescore for
#: accumulation to stop.
TOGETHER, RESCORE = 512, 0.03
#: Largest magnitude up to which sums of products are bounded in floating point.
BOUNDED = 1e150
LONG = 2**63


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id, v, key, copies: each different row with its number of copies; v as whole doubles, which hold
    floor(scale * x) at any magnitude, key a hash of id and v."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double") * F.lit(float(scale)))
    fine = F.forall(F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    # doubles of 2**53 or more are whole already, and beyond the reach of floor
    whole = F.transform(x, lambda c: F.when(F.abs(c) < float(2**53), F.floor(c).cast("double")).otherwise(c))
    d = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(F.coalesce(fine, F.lit(False)))
    d = d.select(F.col(id_col).cast("bigint").alias("id"), whole.alias("v")).groupBy("id", "v").agg(F.count("*").alias("copies"))
    return d.withColumn("key", F.xxhash64("id", "v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    if len(ends) and (ends == dims).all():
        return flat.reshape(len(ends), dims)
    out = np.zeros((len(ends), dims))
    rows = np.repeat(np.arange(len(ends)), ends)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole doubles as integers of any size."""
    return np.array([int(c) for c in x.ravel()], dtype=object).reshape(x.shape)


class ImpactIndex:
    """The postings of one block of vectors, rows in order of their ids."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, copies: np.ndarray, x: np.ndarray):
        order = np.lexsort((keys, ids))
        self.ids, self.keys, self.copies, self.x = ids[order], keys[order], copies[order], x[order]
        self.by_key = np.argsort(self.keys, kind="stable")
        size = np.abs(self.x)
        self.top = float(size.max(initial=0))
        norm = np.maximum(size.max(axis=1, initial=0), 1.0)  # sums of squares stay in range
        level = np.where(size >= 1, np.frexp(size)[1], 0)
        self.segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # dimensions, values, norm of the rest
        for s in np.unique(level[level > 0])[::-1]:
            held, rest = level == s, np.where(level < s, self.x, 0) / norm[:, None]
            dims = np.flatnonzero(held.any(axis=0))
            self.segments.append((dims, np.where(held, self.x, 0)[:, dims], np.sqrt((rest**2).sum(1)) * norm))

    def exact(self, at: np.ndarray, w: np.ndarray, most: float) -> np.ndarray:
        """Inner products of the vectors at places with one query."""
        if most < 2**53:
            return (self.x[at] @ w).astype(np.int64)
        if most < LONG:
            return self.x[at].astype(np.int64) @ w.astype(np.int64)
        return _whole(self.x[at]) @ _whole(w) if len(at) else np.empty(0, dtype=object)

    def search(self, keys: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query positions, places, scores) of the k best of each query, its own row among them only if
        there are copies of it; scores are Python's integers where longs can't hold them."""
        n, m = len(self.ids), len(keys)
        most = self.top * float(np.abs(w).max(initial=0)) * max(1, self.x.shape[1])
        at = np.minimum(np.searchsorted(self.keys, keys, sorter=self.by_key), n - 1)
        mine = self.by_key[at]
        own = self.keys[mine] == keys
        own &= self.copies[mine] == 1
        own_q, own_i = np.flatnonzero(own), mine[own]
        possible = np.ones((m, n), dtype=bool)
        want = min(k, n)
        if most < BOUNDED and want:
            kind = np.float32 if most < 2**24 else np.float64
            error = 0.0 if most < 2**53 else most * 1e-14 * self.x.shape[1]
            acc, norm_w = np.zeros((m, n), dtype=kind), np.sqrt((w**2).sum(1))
            for dims, values, rest in self.segments:
                acc += w[:, dims].astype(kind) @ values.T.astype(kind)
                slack = norm_w[:, None] * rest[None, :] * (1 + 1e-9) + (error + 1e-6)
                low = acc - slack
                low[own_q, own_i] = -np.inf
                bar = np.partition(low, n - want, axis=1)[:, n - want]
                possible = acc + slack >= bar[:, None]
                if possible.mean() <= RESCORE:
                    break
        possible[own_q, own_i] = False
        out_q, out_i, out_s = [np.empty(0, int)], [np.empty(0, int)], []
        for q in range(m):
            at = np.flatnonzero(possible[q])
            score = self.exact(at, w[q], most)
            pick = np.argsort(-score, kind="stable")[:k]  # ties stay in order of ids
            out_q.append(np.full(len(pick), q)), out_i.append(at[pick]), out_s.append(score[pick])
        return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s or [np.empty(0, int)])


def _search(k: int):
    def one(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(tables))
        is_query = t["query"].to_numpy(zero_copy_only=False).astype(bool)
        if not is_query.any() or is_query.all():
            return
        ids, keys, copies = (t[c].to_numpy() for c in ("id", "key", "copies"))
        v = _matrix(t["v"], int(max(t["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0), 1)))
        index = ImpactIndex(ids[~is_query], keys[~is_query], copies[~is_query], v[~is_query])
        asked = np.flatnonzero(is_query)
        for i in range(0, len(asked), TOGETHER):
            part = asked[i : i + TOGETHER]
            q, at, score = index.search(keys[part], v[part], k)
            of = part[q]
            held = index.copies[at] - (index.keys[at] == keys[of])
            near = score if score.dtype != object else np.array([min(max(s, -LONG), LONG - 1) for s in score], dtype=np.int64)
            columns = [ids[of], keys[of], copies[of], index.ids[at], held, near]
            beyond = pa.array([_beyond(s) for s in score] if score.dtype == object else ["b"] * len(score), pa.string())
            yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int64)) for c in columns], beyond], ["query_id", "key", "askers", "vec_id", "copies", "score", "beyond"])

    return one


def _beyond(s: int) -> str:
    """Orders scores that a long can't hold among those with the same nearest long."""
    if -LONG <= s < LONG:
        return "b"
    digits = str(abs(s))
    return f"c{len(digits):04d}{digits}" if s > 0 else f"a{9999 - len(digits):04d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on ``id`` that picks the queries."""
    ship_package(vectors.sparkSession)
    d = integer_vectors(vectors, id_col, vec_col, scale)
    n, m = vectors.select(F.col(id_col).cast("bigint").alias("id")).agg(F.count("id"), F.count_if(is_query)).first()
    n_index, n_query = max(1, -(-n // index_block)), max(1, -(-m // query_block))
    # few tiles are cut smaller, so that all cores have some
    n_query = max(n_query, min(-(-3 * vectors.sparkSession.sparkContext.defaultParallelism // n_index), -(-m // TOGETHER), 64))
    at_index, at_query = F.pmod(F.xxhash64("key", F.lit(1)), n_index).cast("int"), F.pmod(F.xxhash64("key", F.lit(2)), n_query).cast("int")
    rows = d.select("id", "key", "copies", "v", F.lit(False).alias("query"), at_index.alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"))
    asked = d.where(is_query).select("id", "key", "copies", "v", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))).alias("ib"), at_query.alias("qb"))
    found = rows.unionByName(asked).groupBy("ib", "qb").applyInArrow(_search(k), "query_id bigint, key bigint, askers bigint, vec_id bigint, copies bigint, score bigint, beyond string")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    asks = ranked.withColumn("ask", F.when(F.col("askers") > 1, F.sequence(F.lit(1), "askers")).otherwise(F.array(F.lit(1).cast("bigint"))))
    return asks.select("query_id", "rank", "vec_id", "score", F.explode("ask").alias("ask")).drop("ask")
