"""Shards along a Hilbert curve through the metadata of documents, native.

Each dimension is quantised to cells of about equal numbers of rows: values are counted, and a value's cell
is its share of the rows before it, nulls last. Cells of all dimensions give a place on a Hilbert curve
(Skilling's transform, in column expressions), rows are sorted by it in ranges, numbered, and cut into runs.
Neighbours on the curve are neighbours in every dimension, so that a shard's files hold a small box of
each and readers skip most of them; ``shard_boxes`` gives the boxes and ``shards_meeting`` those that a
predicate needs.

Law ``rows``: counts of shards are at most one apart, whatever the sizes or the groups of equal texts, which
a third of all rows may be; rows in one cell are ordered by size, checksum and id, so that equal texts with
equal metadata follow one another and are parted only where runs are cut.

Defined results: a null text has no bytes, hence size 1 and checksum 0; null metadata are values of their own,
last; null ids come last among ties; rows that repeat are placed each; texts of any length are read whole; more
shards than rows leave shards empty; an empty table gives an empty result; other columns are ignored or, by
``write_shards``, carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.llm.lookup import look_up
from emberlens.operators.quantiles import numbered
from emberlens.session import cut_lineage, write_table

SHARDS, BITS, DIMENSIONS = 8, 10, ("lang", "source", "n_chars")


def depth_cells(values: DataFrame, bits: int = BITS) -> DataFrame:
    """value, cell in 0 to 2**bits - 1: the share of rows with smaller values. values: (value, n), one row for each value."""
    s = cut_lineage(values.orderBy(F.col("value").isNull(), "value").withColumn("_at", F.monotonically_increasing_id()))
    s = s.withColumn("_part", F.shiftright("_at", 33))
    sums = s.groupBy("_part").agg(F.sum("n").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    ahead = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"), F.sum("_sum").over(Window.partitionBy(F.lit(1))).alias("_all"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("_own", own).join(F.broadcast(ahead), "_part")
    share = (F.col("_own") + F.col("_ahead")).cast("decimal(20,0)") * F.lit(1 << bits)
    return s.withColumn("_x", share.cast("decimal(38,0)")).select("value", F.expr("cast(_x div _all as int)").alias("cell"))


def hilbert_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of a point whose coordinates are below 2**bits."""
    n = len(cells)
    if n * bits > 62:
        raise ValueError("the curve's index must fit a long")
    at = lambda x, i: F.element_at(x, i + F.lit(1))
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, s: Column) -> Column:
        # a set bit inverts the lower bits of the first coordinate; a clear one swaps them with those of coordinate i
        low = s["q"] - 1
        swap = at(x, F.lit(0)).bitwiseXOR(at(x, s["i"])).bitwiseAND(low)
        hit = at(x, s["i"]).bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda e, j: e.bitwiseXOR(F.when(hit, F.when(j == 0, low).otherwise(0)).otherwise(F.when((j == 0) | (j == s["i"]), F.when(s["i"] == 0, 0).otherwise(swap)).otherwise(0))))

    x = F.aggregate(steps, F.array(*[c.cast("int") for c in cells]), undo)
    # Gray code: each coordinate meets all before it, then the parity of the last one's bits
    gray = F.transform(x, lambda e, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, c: a.bitwiseXOR(c)))
    last = lambda g: F.element_at(g, n)
    turn = lambda g: F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0), lambda t, q: F.when(last(g).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    turned = F.transform(F.array(gray), lambda g: F.transform(g, lambda e: e.bitwiseXOR(turn(g))))
    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    woven = F.transform(turned, lambda g: F.aggregate(order, F.lit(0).cast("bigint"), lambda h, o: h * 2 + F.call_function("getbit", at(g, o["i"]), o["b"])))
    return woven[0]


def curve_order(docs: DataFrame, dims: Sequence[str] = DIMENSIONS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, cells, curve, place (from 1) of every row, with the columns of ``carry`` in ``row``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(0)
    d = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[F.col(c).alias(f"_d{i}") for i, c in enumerate(dims)], held.alias("row"))
    d = write_table(d, "curve")
    for i in range(len(dims)):
        cells = depth_cells(d.groupBy(F.col(f"_d{i}").alias("value")).agg(F.count("*").alias("n")), bits)
        d = look_up(d, cells.select(F.col("value").alias(f"_d{i}"), F.col("cell").alias(f"_c{i}")), [f"_d{i}"])
    cells = [F.col(f"_c{i}") for i in range(len(dims))]
    d = d.select("doc_id", "size", "text_crc32", "row", F.array(*cells).alias("cells"), hilbert_index(cells, bits).alias("curve"), F.monotonically_increasing_id().alias("_tie"))
    return numbered(d, ["curve", "size", "text_crc32", F.col("doc_id").isNull(), "doc_id", "_tie"], "place").drop("_tie")


def cut_runs(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """placed with shard and slot: runs of places whose lengths are at most one apart."""
    n = placed.count()
    at = F.col("place").cast("bigint") - 1
    shard = F.expr(f"(cast(place as bigint) - 1) * {shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", at - first)


def shard_documents(docs: DataFrame, shards: int = SHARDS, dims: Sequence[str] = DIMENSIONS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of every row."""
    d = cut_runs(curve_order(docs, dims, bits, id_col, text_col), shards)
    return d.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dims: Sequence[str] = DIMENSIONS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all columns of docs as Parquet below ``path``, one folder for each shard, rows in curve order, and
    returns ``shard_boxes`` of it."""
    placed = cut_runs(curve_order(docs, dims, bits, id_col, text_col, carry=docs.columns), shards)
    rows = placed.select("shard", "slot", "row.*") if not {"shard", "slot"} & {c.lower() for c in docs.columns} else placed.select("shard", "slot", "row")
    files = rows.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
    files.write.partitionBy("shard").parquet(path)
    return shard_boxes(docs.sparkSession.read.parquet(path), dims)


def shard_boxes(shards: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """shard, n_rows, and for each dimension its least and largest value and its number of nulls in the shard."""
    of = (lambda c: F.col(f"row.{c}")) if "row" in shards.columns else F.col
    return shards.groupBy("shard").agg(F.count("*").alias("n_rows"), *[f(of(c)).alias(f"{name}_{c}") for c in dims for name, f in (("min", F.min), ("max", F.max), ("nulls", lambda x: F.count_if(x.isNull())))])


def shards_meeting(boxes: DataFrame, ranges: Mapping[str, tuple[Any, Any]]) -> DataFrame:
    """The boxes that may hold rows with every dimension within its range, both ends included."""
    for c, (low, high) in ranges.items():
        boxes = boxes.where((F.col(f"max_{c}") >= F.lit(low)) & (F.col(f"min_{c}") <= F.lit(high)))
    return boxes
