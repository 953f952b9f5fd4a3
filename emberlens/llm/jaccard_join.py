"""N-gram Jaccard join by prefix filters under several global orders.

Each text is its set of distinct word shingles. Under any one order of all shingles, two sets whose
Jaccard similarity reaches t share a shingle within their prefixes of n - ceil(t * n) + 1. The
first order, frequent shingles last, deals the prefixes out by shingle and finds pairs, with the
positional bound on what can still overlap. The pairs must then meet in the prefixes under the
other orders as well, before the sets themselves are compared.

Copies collapse to one representative set. Groups of near copies aren't expanded into all pairs:
each set first meets the hub of its shingle groups, the member with fewest rare shingles; only
pairs between different components of what that links are then searched, all of them, so no link
between different components is missed and the components are exact.

Which shingles are frequent is counted over all different sets by 24-bit prints in buckets; at most
MAX_FREQUENT enter the order, which holds for any such list, right or wrong.

Pairs are verified on the sets of 64-bit shingle hashes, and copies are sets whose sizes and two
64-bit sums agree; texts aren't compared. Two different shingles fall together with probability
2**-64, so a pair of sets of n shingles is misjudged with probability n**2 / 2**64 at most (1e-9 for
100,000 words), and two different sets are taken for copies with some 2**-128. The hashes have no
secret key: texts made to collide are outside of that bound.

Defined results: texts that are null or without words have an empty set, are linked with nothing
and are a component of their own; texts of fewer words than a shingle are one shingle; rows that
share an id are one vertex and are answered each; rows with null id are answered with a null
component and take no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlens.llm.components import components
from emberlens.llm.shingles import chunks_of, distinct, hash_shingles, mix
from emberlens.session import cut_lineage, delete_path, ship_package, table_path, write_table

WIDTH, PERCENT = 4, 85
FREQUENT, MAX_FREQUENT = 64, 1 << 20
#: Ids up to which a list of them is broadcast, 8 bytes each; beyond it is shuffled.
BROADCAST_IDS = 1_000_000
ORDERS = (11, 12, 13)
#: Documents with one shingle from which on its entries are dealt out by salts; entries of one text that
#: are joined at one key; members that are compared with one copy of their hub.
SPLIT, PIECE, BLOCK = 100_000, 4_096, 256
#: Prints that a task sorts at once, and the largest gap but one of two neighbours in 16 bits.
PRINTS_HELD, GAP = 400_000, 65_535
ROLE = ("id", "hub", "block", "own")

Batches = Iterator[pa.RecordBatch]


def _sets(b: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of a batch."""
    for first, raw, bounds in chunks_of(b.column("text")):
        h, at = hash_shingles(raw, bounds, width)
        for i in range(len(bounds) - 1):
            yield first + i, distinct(h[at[i] : at[i + 1]])


def _longs(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)
    return pa.array(flat.astype(kind, copy=False))


def _lists(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _longs(parts, kind))


def _outline(width: int) -> Callable:
    """id, number of shingles and two hashes of the set."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            n, k1, k2 = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
            for i, s in _sets(b, width):
                n[i] = len(s)
                k1[i], k2[i] = (int(mix(s, seed).sum(dtype=np.uint64).view(np.int64)) for seed in (3, 4)) if len(s) else (0, 0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.array(k1), pa.array(k2)], ["id", "n", "k1", "k2"])

    return run


def _print_of(h: np.ndarray, bits: int) -> np.ndarray:
    """Bucket (the upper bits) and 24-bit print of shingles, as one number."""
    return mix(h, 7) >> np.uint64(40 - bits)


def _prints(width: int, bits: int) -> Callable:
    """Sorted prints of a task's documents, by bucket, as 16-bit gaps; a gap of GAP or more begins with that
    many of GAP, which add up but end no gap."""

    def run(batches: Batches) -> Batches:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            p = np.sort(np.concatenate(held))
            edges = np.searchsorted(p, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(24))
            low = (p & np.uint64(0xFFFFFF)).astype(np.int32)
            gaps = np.diff(low, prepend=np.int32(0))
            full = np.flatnonzero(np.diff(edges))
            gaps[edges[full]] = low[edges[full]]
            ends = np.cumsum(gaps // GAP + 1)
            units = np.full(ends[-1], GAP, dtype="<u2")
            units[ends - 1] = gaps % GAP
            cut = np.concatenate([[0], ends])[edges]
            blobs = [units[cut[k] : cut[k + 1]].tobytes() for k in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "prints"])

        for b in batches:
            for _, s in _sets(b, width):
                held.append(_print_of(s, bits))
                size += len(s)
                if size > PRINTS_HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _tally(least: int) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        parts = []
        for blob in t["prints"]:
            units = np.frombuffer(blob.as_buffer(), dtype="<u2")
            parts.append(np.cumsum(units, dtype=np.uint32)[units != GAP])
        p, n = np.unique(np.concatenate(parts), return_counts=True)
        p = p[n >= least].astype(np.int64) + (t["bucket"][0].as_py() << 24)
        return pa.table({"print": pa.array(p), "n": pa.array(n[n >= least])})

    return run


def frequent_prints(texts: DataFrame, width: int, bits: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted prints of the shingles in at least ``least`` documents, the ``most`` most frequent, and
    their numbers of documents."""
    d = texts.select("text").mapInArrow(_prints(width, bits), "bucket int, prints binary")
    n = d.groupBy("bucket").applyInArrow(_tally(least), "print bigint, n bigint")
    top = n.orderBy(F.desc("n"), "print").limit(most).toArrow()
    p, n = top["print"].to_numpy().astype(np.uint64), np.minimum(top["n"].to_numpy(), 2**31 - 1).astype(np.int32)
    order = np.argsort(p)
    return p[order], n[order]


def _prefix(s: np.ndarray, frequent: np.ndarray, percent: int, seed: int) -> np.ndarray:
    """The prefix of a set under an order, in that order; ``frequent`` says which members come last."""
    n = len(s)
    p = n - -(-percent * n // 100) + 1
    key = (mix(s, seed) >> np.uint64(1)) | (frequent.astype(np.uint64) << np.uint64(63))
    if p < n:
        at = np.argpartition(key, p - 1)[:p]
        return s[at[np.argsort(key[at])]]
    return s[np.argsort(key)]


def _documents_with(s: np.ndarray, counts: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    """The number of documents with each frequent shingle of a set, 0 for all others."""
    prints, n = counts
    if not len(prints):
        return np.zeros(len(s), dtype=np.int32)
    p = _print_of(s, bits)
    at = np.searchsorted(prints, p)
    at[at == len(prints)] = 0
    return np.where(prints[at] == p, n[at], 0)


def _entries(width: int, percent: int, bits: int, counts, split: int) -> Callable:
    """A row for each member of each prefix under the first order: shingle, salt, id, set size, position.

    The entries of a shingle that more than ``split`` documents have are dealt to as many salts as it
    has that number of documents; all others have the salt -1.
    """

    def run(batches: Batches) -> Batches:
        for b in batches:
            ids, tokens, salts, doc, size, pos = b.column("id").to_numpy(), [], [], [], [], []
            for i, s in _sets(b, width):
                if not len(s):
                    continue
                k = _documents_with(s, counts.value, bits)
                p = _prefix(s, k > 0, percent, ORDERS[0])
                salt = np.full(len(p), -1, dtype=np.int32)
                if k.max(initial=0) > split:
                    ways = _documents_with(p, counts.value, bits).astype(np.int64) // split + 1
                    draw = int(mix(ids[i : i + 1].view(np.uint64), 5)[0] >> np.uint64(1))
                    salt = np.where(ways > 1, draw % ways, -1).astype(np.int32)
                tokens.append(p), salts.append(salt), doc.append(np.full(len(p), ids[i]))
                size.append(np.full(len(p), len(s), dtype=np.int32)), pos.append(np.arange(len(p), dtype=np.int32))
            if tokens:
                columns = [pa.array(np.concatenate(x)) for x in (salts, doc, size, pos)]
                yield pa.RecordBatch.from_arrays([_longs(tokens), *columns], ["token", "salt", "id", "n", "pos"])

    return run


def _near(n, pos, m, at, percent: int):
    """Size and positional bounds of two entries at one shingle; for arrays and columns alike."""
    rest, other = n - pos, m - at
    whole = (n + m) * percent
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (rest * (100 + percent) >= whole) & (other * (100 + percent) >= whole)


def _meetings(percent: int) -> Callable:
    """Of entries sorted by shingle, salt, position and id those whose shingle has more than one, each
    with the hub of its group, which comes first, where the two can link. A salted group keeps a group
    of one as well, and its hub names itself. All that is kept from batch to batch is the hub."""

    def run(batches: Batches) -> Batches:
        hub, unsent = None, False
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in ("token", "salt", "id", "n", "pos")]
            if hub is not None:
                cols = [np.concatenate([[x], c]).astype(c.dtype) for x, c in zip(hub, cols, strict=True)]
            token, salt, ids, n, pos = cols
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(token)))
            first = np.repeat(starts, sizes)
            kept = np.repeat(sizes > 1, sizes) | (salt >= 0)
            linked = _near(n.astype(np.int64), pos, n[first].astype(np.int64), pos[first], percent) & (ids != ids[first])
            linked |= new & (salt >= 0)
            send = kept.copy()
            if hub is not None:
                send[0] &= unsent
            hub, unsent = tuple(c[starts[-1]] for c in cols), not kept[-1]
            if send.any():
                hubs = pa.array(ids[first][send], mask=~linked[send])
                yield pa.RecordBatch.from_arrays([*[pa.array(c[send]) for c in (token, ids, n, pos)], hubs], ["token", "id", "n", "pos", "hub"])

    return run


def _once(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch without rows that repeat the row before, by id and text, and where each row's text is."""
    if b.num_rows < 2:
        return b, np.zeros(b.num_rows, dtype=np.int64)
    same = pc.and_(*[pc.equal(b.column(c).slice(1), b.column(c).slice(0, b.num_rows - 1)) for c in ("id", "text")])
    fresh = np.append(True, ~same.to_numpy(zero_copy_only=False))
    return b.filter(pa.array(fresh)), np.cumsum(fresh) - 1


def _dealt(width: int, lists_of: Callable[[np.ndarray], list[np.ndarray]], kind) -> Callable:
    """The rows of a batch with lists made of each text's set in place of the text."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            texts, at = _once(b)
            lists = [lists_of(s) for _, s in _sets(texts, width)]
            columns = [_lists(list(x), kind).take(pa.array(at)) for x in zip(*lists, strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ROLE], *columns], [*ROLE, *[f"l{k}" for k in range(len(columns))]])

    return run


def _members_of(hub: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values are in the sorted array hub."""
    if not len(hub):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(hub, values)
    at[at == len(hub)] = 0
    return hub[at] == values


def _against_hub(n_lists: int, agree: Callable) -> Callable:
    """Pairs (id, hub) of rows sorted by hub and block, the hub's own rows first, that agree. The hub's
    lists, one for each of its different texts, are kept from batch to batch."""

    def run(batches: Batches) -> Batches:
        key, hubs = None, []
        for b in batches:
            if not b.num_rows:
                continue
            hub, block, own, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("hub", "block", "own", "id"))
            lists = []
            for k in range(n_lists):
                c = b.column(f"l{k}")
                ends = np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                flat = c.flatten().to_numpy(zero_copy_only=False)
                lists.append((flat.view(np.uint64) if flat.dtype == np.int64 else flat, ends))
            starts = np.flatnonzero(np.append(True, (hub[1:] != hub[:-1]) | (block[1:] != block[:-1])))
            found, of = [], []
            for i, j in zip(starts, np.append(starts[1:], len(hub)), strict=True):
                if key != (hub[i], block[i]):
                    key, hubs = (hub[i], block[i]), []
                k = i + int(own[i:j].sum())
                for r in range(i, k):
                    mine = [np.sort(flat[ends[r] : ends[r + 1]]) for flat, ends in lists]
                    if not any(all(np.array_equal(x, y) for x, y in zip(mine, h, strict=True)) for h in hubs):
                        hubs.append(mine)
                if k < j:
                    fits = np.zeros(j - k, dtype=bool)
                    for h in hubs:
                        shared = [np.bincount(np.repeat(np.arange(j - k), np.diff(ends[k : j + 1])), _members_of(x, flat[ends[k] : ends[j]]), j - k) for x, (flat, ends) in zip(h, lists, strict=True)]
                        fits |= agree(shared, len(h[0]), np.diff(lists[0][1][k : j + 1]))
                    found.append(ids[k:j][fits]), of.append(np.full(int(fits.sum()), hub[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(of))], ["id", "hub"])

    return run


class JaccardJoin:
    """The join of one table of texts (id, text)."""

    def __init__(self, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT, frequent: int = FREQUENT, max_frequent: int = MAX_FREQUENT, broadcast_ids: int = BROADCAST_IDS, split: int = SPLIT, piece: int = PIECE):
        ship_package(texts.sparkSession)
        self.texts, self.width, self.percent, self.broadcast_ids = texts, width, percent, broadcast_ids
        self.frequent, self.max_frequent, self.split, self.piece = frequent, max_frequent, split, piece
        self.bits = max(8, min(18, (4 * texts.rdd.getNumPartitions() - 1).bit_length()))

    def _small(self, d: DataFrame) -> DataFrame:
        """d, which is stored, to be broadcast if its rows are few enough."""
        return F.broadcast(d) if d.count() <= self.broadcast_ids else d

    def _agreeing(self, pairs: DataFrame, lists_of: Callable, n_lists: int, kind, agree: Callable) -> DataFrame:
        """Those of the pairs (id, hub) whose lists agree.

        The lists of members go to their hub's, in blocks of BLOCK members, each with a copy of the
        hub's, so that no hub is a hot key.
        """
        blocks = cut_lineage(pairs.groupBy("hub").agg(F.floor(F.count("*") / BLOCK).cast("int").alias("last")))
        large = self._small(cut_lineage(blocks.where("last > 0")))
        members = pairs.join(large, "hub", "left").withColumn("last", F.coalesce("last", F.lit(0)))
        members = members.select("id", "hub", F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int").alias("block"), F.lit(False).alias("own"))
        hubs = blocks.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), "last")).alias("block"), F.lit(True).alias("own"))
        roles = cut_lineage(members.unionByName(hubs))
        sent = self.candidates.join(self._small(roles), "id").select(*ROLE, "text")
        item = "bigint" if kind is np.int64 else "int"
        schema = "id bigint, hub bigint, block int, own boolean, " + ", ".join(f"l{k} array<{item}>" for k in range(n_lists))
        sent = sent.mapInArrow(_dealt(self.width, lists_of, kind), schema)
        sent = sent.repartition("hub", "block").sortWithinPartitions("hub", "block", F.desc("own"))
        return cut_lineage(sent.mapInArrow(_against_hub(n_lists, agree), "id bigint, hub bigint").distinct())

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (id, hub) that meet under all other orders and whose sets are similar."""
        counts, bits, percent = self.counts, self.bits, self.percent

        def prefixes(s: np.ndarray) -> list[np.ndarray]:
            often = _documents_with(s, counts.value, bits) > 0
            return [_prefix(s, often, percent, seed) if len(s) else s for seed in ORDERS[1:]]

        met = self._agreeing(cut_lineage(pairs), prefixes, len(ORDERS) - 1, np.int32, lambda shared, n, m: np.logical_and.reduce([x > 0 for x in shared]))
        return self._agreeing(met, lambda s: [s], 1, np.int64, lambda shared, n, m: shared[0] * 100 >= (n + m - shared[0]) * percent)

    def links(self) -> DataFrame:
        """Links (u, v) between ids that generate all components; also sets ``rows`` (id, n, rep)."""
        spark = self.texts.sparkSession
        outline = cut_lineage(self.texts.mapInArrow(_outline(self.width), "id bigint, n bigint, k1 bigint, k2 bigint"))
        known = outline.where("id is not null and n > 0")
        reps = cut_lineage(known.groupBy("k1", "k2").agg(F.min("id").alias("rep")))
        self.rows = cut_lineage(outline.join(reps, ["k1", "k2"], "left").select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("rep")).alias("rep")))
        known = self.rows.where("rep is not null")
        many = known.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u <> v").select("id")
        shared = cut_lineage(known.join(self._small(cut_lineage(many)), "id").select(F.col("id").alias("u"), F.col("rep").alias("v")))

        rest = cut_lineage(known.groupBy("id").agg(F.count_if(F.col("id") == F.col("rep")).alias("own")).where("own = 0").select("id"))
        some = self.texts.join(self._small(rest), "id", "left_anti").where("id is not null and text is not null")
        counts = frequent_prints(some, self.width, self.bits, self.frequent, self.max_frequent)
        self.counts = spark.sparkContext.broadcast(counts)
        entries = some.mapInArrow(_entries(self.width, self.percent, self.bits, self.counts, self.split), "token bigint, salt int, id bigint, n int, pos int")
        dealt = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "pos", "id")
        stored = table_path(spark, "meetings")
        dealt.mapInArrow(_meetings(self.percent), "token bigint, id bigint, n int, pos int, hub bigint").write.parquet(stored)
        g = spark.read.parquet(stored)

        ids = cut_lineage(g.select("id").distinct())
        # too many to be broadcast, they are looked up once, so that all texts cross a shuffle once at most
        self.candidates = some if ids.count() <= self.broadcast_ids else write_table(some.join(ids, "id", "left_semi"), "candidates")

        met = g.where("hub <> id").select("id", "hub")
        if counts[1].max(initial=0) > self.split:
            met = met.unionByName(self._between_salts(g.where("hub = id")))
        met = met.groupBy("id", "hub").agg(F.count("*").alias("k"))
        first = self._confirmed(met.groupBy("id").agg(F.max_by("hub", F.struct("k", -F.col("hub"))).alias("hub")))
        found = first.select(F.col("id").alias("u"), F.col("hub").alias("v")).unionByName(shared)
        second = self._confirmed(self._across(g.drop("hub"), components(found)))
        delete_path(spark, stored)
        return found.unionByName(second.select(F.col("id").alias("u"), F.col("hub").alias("v")))

    def _between_salts(self, hubs: DataFrame) -> DataFrame:
        """Each salt's hub meets the first of its shingle's hubs."""
        top = hubs.groupBy("token").agg(F.min(F.struct("pos", "id", "n")).alias("h")).select("token", F.col("h.pos").alias("at"), F.col("h.id").alias("hub"), F.col("h.n").alias("m"))
        return hubs.drop("hub").join(top, "token").where((F.col("id") != F.col("hub")) & _near(*[F.col(c).cast("bigint") for c in ("n", "pos", "m", "at")], self.percent)).select("id", "hub")

    def _with_component(self, g: DataFrame, parts: DataFrame) -> DataFrame:
        """Entries with the component of their id. Beyond what is broadcast they are joined in pieces of
        each prefix, so that a long text is no hot key."""
        parts = parts.withColumnRenamed("node", "id")
        if parts.count() <= self.broadcast_ids:
            g = g.join(F.broadcast(parts), "id", "left")
        else:
            piece = F.floor(F.col("pos") / self.piece).cast("int")
            last = g.groupBy("id").agg(F.max(piece).alias("last"))
            parts = parts.join(last, "id").select("id", "component", F.explode(F.sequence(F.lit(0), "last")).alias("piece"))
            g = g.withColumn("piece", piece).join(parts, ["id", "piece"], "left").drop("piece")
        return g.withColumn("component", F.coalesce("component", "id"))

    def _across(self, g: DataFrame, parts: DataFrame) -> DataFrame:
        """All pairs (id, hub) of different components that meet under the first order.

        In each shingle group the members outside of its largest component meet the others; a member
        too far back for the smallest set of the group meets nobody.
        """
        g = self._with_component(g, parts)
        mixed = g.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
        g = cut_lineage(g.join(mixed, "token", "left_semi").select("token", "id", "n", "pos", "component"))
        sizes = g.groupBy("token", "component").agg(F.count("*").alias("k"), F.min("n").alias("n"))
        tokens = sizes.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.min("n").alias("least"))
        g = g.join(tokens, "token").where((F.col("n") - F.col("pos")).cast("bigint") * (100 + self.percent) >= (F.col("n") + F.col("least")).cast("bigint") * self.percent)
        few = g.where("component <> main")
        one_way = (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
        near = _near(*[F.col(c).cast("bigint") for c in ("x.n", "x.pos", "y.n", "y.pos")], self.percent)
        met = few.alias("x").join(g.alias("y"), "token").where((F.col("x.component") != F.col("y.component")) & one_way & near)
        return met.select(F.greatest("x.id", "y.id").alias("id"), F.least("x.id", "y.id").alias("hub")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id, n_shingles, component_id of every row."""
    join = JaccardJoin(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), **how)
    parts = components(join.links()).withColumnRenamed("node", "rep")
    answered = join.rows.join(parts, "rep", "left")
    return answered.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, **how) -> DataFrame:
    """The documents of which one stays of each component, that with the smallest id; of rows that
    repeat an id one stays. Rows with null id stay."""
    parts = cut_lineage(jaccard_components(docs, id_col, text_col, **how).where(F.col(id_col).isNotNull()))
    gone = cut_lineage(parts.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    kept = docs.join(F.broadcast(gone) if gone.count() <= broadcast_ids else gone, id_col, "left_anti").select(docs.columns)
    again = parts.groupBy(id_col).agg(F.count("*").alias("k")).where("k > 1").select(id_col)
    if again.isEmpty():
        return kept
    once = kept.join(again, id_col, "left_semi").dropDuplicates([id_col])
    return kept.join(again, id_col, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
