"""Jaccard self-join of the documents' word n-gram sets: an exact size-aware heavy-light join.

Every text becomes the set of its hashed word n-grams; equal sets are one set from there on. Two sets of sizes a and b
with a Jaccard of at least t share o >= ceil(t max(a, b)) n-grams. Nothing is approximated: every step keeps all pairs
that can reach t.

1. Which n-grams does more than one document have? Tasks send sorted fingerprints of their n-grams, as compressed
   differences (about two bytes each), to the task of a range of hashes, which writes those that occur again, with
   the logarithm of their frequency, as a sorted array in the shared folder. A set's shared n-grams are looked up in the
   mapped arrays; a set of which less than the share t is shared with anything has no partner and leaves.
2. The others' shared n-grams are ordered by frequency, rare ones first, then by hash. A set of s shared n-grams can only
   meet a partner in its first s - o + 1 of them, and with c of its n-grams in its first s - o + c. Light sets (at most x in
   the former) enumerate all subsets of c n-grams (SUBSET) and meet in equal ones; heavy sets scan the inverted lists of
   their n-grams and meet all sets there, light ones too. The boundary x is the one of least cost: subsets to enumerate
   (each SUBSET_COST entries' worth) against list entries to scan, counted by size over all sets.
3. What is scanned isn't emitted as pairs. All sets of a list belong to its head, the least of its heavy sets (of its
   light ones for a subset), found by an aggregate; a head's sets make one tile, however many lists they have in common,
   and a tile that another one holds whole is dropped. A tile that is too large is cut into blocks, and each two blocks
   are a tile. In a tile the inverted lists of all shared n-grams give the exact overlaps; a pair counts in the tile of the
   least head that both its sets have. Tiles return a number of links and a root for each set: rows in proportion to the
   sets, whatever the number of pairs.

There is no cap on partners, candidates or list lengths. Every row is a query.

Defined results: linked() has one row for each non-null doc_id: its class (the least doc_id that it is connected to by
links; itself if it has none) and its links, the other documents with a Jaccard of t or more. Null and empty texts and
texts without words have no links; a text of fewer than n words is one n-gram; a doc_id with several texts is connected
through each of them and has the links of each (its own other texts count like those of others); rows that repeat a doc_id and its text count once; ties have no
influence; an empty table gives an empty result. Only doc_id and text are read, so that other columns can have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lingmill.llm.arrays import mapped, put
from lingmill.llm.common import new_path, removed, small, trim, unused, written
from lingmill.llm.textvec import codepoints, lowered, mix, ngram_hashes, slices, words

N = 3
THRESHOLD = 0.5
SUBSET = 2
#: What enumerating, sending and meeting in one subset costs, in entries of inverted lists that are scanned.
SUBSET_COST = 1000
SHARD_GRAMS = 1 << 22
FLUSH_GRAMS = 1 << 21
TILE_BYTES = 8 << 20


def _required(sizes: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * sizes - 1e-9))


def sets_of(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of every row that has words."""
    for at, part in slices(column):
        cp, starts = codepoints(lowered(part))
        grams, bounds = ngram_hashes(*words(cp, starts), n)
        for i in range(len(part)):
            lo, hi = bounds[i], bounds[i + 1]
            if hi > lo:
                u = np.sort(grams[lo:hi])
                if hi - lo > 1:
                    fresh = np.empty(len(u), bool)
                    fresh[0] = True
                    np.not_equal(u[1:], u[:-1], out=fresh[1:])
                    u = u[fresh]
                yield at + i, u


def set_id(u: np.ndarray) -> np.int64:
    total = np.array([u.sum(dtype=np.uint64) + np.uint64(len(u))], np.uint64)
    other = np.array([mix(u).sum(dtype=np.uint64)], np.uint64)
    return mix(mix(total) + other).view(np.int64)[0]


# ---- which n-grams are shared ----------------------------------------------------------------------------------------


class Ranges:
    """Fingerprints are the first `bits` of a hash; each shard has a range of them."""

    def __init__(self, grams: int, shard_grams: int = SHARD_GRAMS):
        self.bits = min(60, max(32, int(grams).bit_length() + 7))
        self.shards = max(1, -(-grams // shard_grams))
        self.span = -(-(1 << self.bits) // self.shards)
        while self.span >= 1 << 32:  # places within a shard have 32 bits
            self.shards *= 2
            self.span = -(-(1 << self.bits) // self.shards)

    def of(self, grams: np.ndarray) -> np.ndarray:
        return grams >> np.uint64(64 - self.bits)

    def parts(self, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(shard, first, end) of sorted fingerprints."""
        at = 0
        while at < len(prints):
            shard = int(prints[at]) // self.span
            end = at + int(np.searchsorted(prints[at:], np.uint64((shard + 1) * self.span)))
            yield shard, at, end
            at = end

    def places(self, prints: np.ndarray, shard: int) -> np.ndarray:
        return (prints - np.uint64(shard * self.span)).astype(np.uint32)


def _blob(places: np.ndarray, counts: np.ndarray) -> bytes:
    planes = np.diff(places, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
    return zstd.ZstdCompressor(level=1).compress(np.int64(len(places)).tobytes() + np.ascontiguousarray(planes).tobytes() + counts.astype(np.uint8).tobytes())


def _of_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstd.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    planes = np.frombuffer(raw, np.uint8, 4 * n, 8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32), np.frombuffer(raw, np.uint8, n, 8 + 4 * n)


def shared_grams(texts: DataFrame, n: int, ranges: Ranges, path: str, flush_grams: int = FLUSH_GRAMS) -> list[str | None]:
    """Writes what more than one row has; the name of each shard's file. Copies count too, so that sets with a copy have all n-grams shared."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            every = ranges.of(np.concatenate(held))
            held.clear()
            size = 0
            every.sort()
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            counts, every = np.minimum(np.diff(first, append=len(every)), 255), every[first]
            rows = [(shard, _blob(ranges.places(every[lo:hi], shard), counts[lo:hi])) for shard, lo, hi in ranges.parts(every)]
            del every, counts, first
            trim()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])

        for batch in batches:
            for _, u in sets_of(batch.column(0), n):
                held.append(u)
                size += len(u)
                if size > flush_grams:
                    yield flush()
        if size:
            yield flush()

    def merged(t: pa.Table) -> pa.Table:
        parts = [_of_blob(b.as_py()) for b in t["blob"]]
        places, counts = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
        del parts
        order = np.argsort(places, kind="stable")
        places, counts = places[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        total, places = np.add.reduceat(counts, first), places[first]
        again = total > 1
        name = put(path, {"shared": {"places": places[again], "codes": np.minimum(np.log2(total[again]), 15).astype(np.uint8)}})
        out = pa.table({"shard": t["shard"].slice(0, 1), "name": pa.array([name])})
        del order, places, counts, first, total, again
        trim()
        return out

    blobs = texts.mapInArrow(prints, "shard long, blob binary")
    found = dict(map(tuple, blobs.groupBy("shard").applyInArrow(merged, "shard long, name string").collect()))
    return [found.get(i) for i in range(ranges.shards)]


class Shared:
    """How often n-grams occur: 0 for once, else the rounded-down logarithm of the number."""

    def __init__(self, path: str, names: list[str | None], ranges: Ranges):
        self.path, self.names, self.ranges, self.open = path, names, ranges, {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def codes(self, grams: np.ndarray) -> np.ndarray:
        prints = self.ranges.of(grams)
        order = np.argsort(prints)
        prints = prints[order]
        found = np.zeros(len(grams), np.uint8)
        for shard, lo, hi in self.ranges.parts(prints):
            if self.names[shard] is None:
                continue
            if shard not in self.open:
                self.open[shard] = mapped(self.path, self.names[shard])["shared"]
            places, codes = self.open[shard]["places"], self.open[shard]["codes"]
            if not len(places):
                continue
            want = self.ranges.places(prints[lo:hi], shard)
            at = np.minimum(np.searchsorted(places, want), len(places) - 1)
            found[lo:hi] = np.where(places[at] == want, codes[at], 0)
        out = np.empty(len(grams), np.uint8)
        out[order] = found
        return out


def sets(docs: DataFrame, shared: Shared, n=N, threshold=THRESHOLD, id_column="doc_id", text="text", flush_grams: int = FLUSH_GRAMS) -> DataFrame:
    """(id, sid, n, o, scan, grams) of each row with an id.

    sid: the set's identity, null without words; n: its size; o: the overlap that a partner needs. Of sets that can have a
    partner, grams: their shared n-grams, rare ones first; scan: the length of the inverted lists of those it can first meet in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            sid, size, need, scan = (np.zeros(rows, np.int64) for _ in range(4))
            lens, dead, has = np.zeros(rows, np.int32), np.ones(rows, bool), np.zeros(rows, bool)
            values: dict[int, np.ndarray] = {}
            held: list[tuple[int, np.ndarray]] = []

            def settle() -> None:
                codes = shared.value.codes(np.concatenate([u for _, u in held]))
                at = 0
                for row, u in held:
                    c = codes[at : at + len(u)]
                    at += len(u)
                    again = np.flatnonzero(c)
                    if len(again) >= need[row]:
                        order = again[np.argsort(c[again], kind="stable")]
                        values[row] = u[order].view(np.int64)
                        lens[row] = len(order)
                        scan[row] = (1 << c[order[: len(order) - need[row] + 1]].astype(np.int64)).sum()
                        dead[row] = False
                held.clear()

            total = 0
            for row, u in sets_of(batch.column(1), n):
                sid[row], size[row], need[row], has[row] = set_id(u), len(u), _required(len(u), threshold), True
                held.append((row, u))
                total += len(u)
                if total > flush_grams:
                    settle()
                    total = 0
            if held:
                settle()
            offsets = np.zeros(rows + 1, np.int32)
            np.cumsum(lens, out=offsets[1:])
            flat = np.concatenate([values[i] for i in sorted(values)]) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sid, mask=~has),
                    pa.array(size),
                    pa.array(need),
                    pa.array(scan),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(dead)),
                ],
                ["id", "sid", "n", "o", "scan", "grams"],
            )
            del values, flat
            trim()

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(made, f"id {kind}, sid long, n long, o long, scan long, grams array<long>")


# ---- who meets -------------------------------------------------------------------------------------------------------


def boundary(reps: DataFrame, subset=SUBSET, subset_cost=SUBSET_COST) -> int:
    """The most n-grams to meet in that a light set has: that of the least total cost."""
    able = reps.where(F.col("o") >= subset)
    by = {r["p"]: (r["sets"], r["scan"]) for r in able.groupBy((F.col("s") - F.col("o") + 1).alias("p")).agg(F.count("*").alias("sets"), F.sum("scan").alias("scan")).collect()}
    return least_cost(by, subset, subset_cost)


def least_cost(by: dict[int, tuple[int, int]], subset: int, subset_cost: int) -> int:
    """by: (sets, list entries) by the number of n-grams to meet in."""
    sizes = sorted(by)
    cost = {x: sum(by[p][0] * math.comb(p + subset - 1, subset) * subset_cost if p <= x else by[p][1] for p in sizes) for x in [0, *sizes]}
    return min(cost, key=lambda x: (cost[x], -x))


def _subsets(subset: int) -> str:
    """SQL: all subsets of that many elements of the array `g`, in its order, each as array<long>."""
    if subset == 1:
        return "transform(g, a -> array(a))"
    if subset == 2:
        return "flatten(transform(sequence(1, size(g) - 1), i -> transform(slice(g, i + 1, size(g)), h -> array(element_at(g, i), h))))"
    if subset == 3:
        return (
            "flatten(flatten(transform(sequence(1, size(g) - 2), i -> transform(sequence(i + 1, size(g) - 1), j -> "
            "transform(slice(g, j + 1, size(g)), h -> array(element_at(g, i), element_at(g, j), h))))))"
        )
    raise ValueError("subsets have 1 to 3 n-grams")


def heads(one: DataFrame, x: int, subset: int, path: str) -> DataFrame:
    """(sid, head): the heads of all lists that a set is in, of lists of more than one set. one: a row for each set; path: of the heads by list."""
    p = F.col("s") - F.col("o") + 1
    light = (F.col("o") >= subset) & (p <= x)
    prefix = lambda more: F.slice("grams", F.lit(1), (p + more).cast("int"))
    postings = one.select("sid", light.alias("light"), F.explode(prefix(0)).alias("key"))
    if x:
        pairs = one.where(light).select("sid", prefix(subset - 1).alias("g")).where(F.size("g") >= subset)
        pairs = pairs.select("sid", F.lit(None).cast("boolean").alias("light"), F.explode(F.expr(_subsets(subset))).alias("key"))
        postings = postings.unionByName(pairs.withColumn("key", F.xxhash64("key")))
    # the null of a subset's rows: any set can be its head
    least = postings.groupBy("key").agg(F.min(F.when(~F.coalesce("light", F.lit(False)), F.col("sid"))).alias("head"), F.min("sid").alias("low"), F.max("sid").alias("high"))
    least = written(least.where("head IS NOT NULL AND low < high").select("key", "head"), "list-heads", path)  # a join of two plain exchanges can split a hot list
    return postings.join(least, "key").select("sid", "head").distinct()


def without_held(members: DataFrame) -> DataFrame:
    """(sid, head) without heads whose sets all belong to one lesser head too.

    A set's heads are compared with its eight least: these are what families have in common.
    """
    by = members.groupBy("sid").agg(F.sort_array(F.collect_set("head")).alias("heads"))
    pairs = by.select("sid", F.explode("heads").alias("head"), F.slice("heads", 1, 8).alias("less")).select("head", F.explode("less").alias("less")).where("less < head")
    both = pairs.groupBy("head", "less").agg(F.count("*").alias("both"))
    size = members.groupBy("head").agg(F.count("*").alias("size"))
    held = both.join(size, "head").where("both = size").select("head").distinct()
    return members.join(held, "head", "left_anti").select("sid", "head")


def tiles(members: DataFrame, reps: DataFrame, tile_bytes=TILE_BYTES) -> tuple[DataFrame, int]:
    """((sid, bucket, tile, side, less), buckets).

    side: 0 or 1 in tiles of two blocks, of which only pairs across count, else -1. less: the set's heads before this one.
    """
    sized = members.join(reps.select("sid", (F.col("s") * 8 + 64).alias("bytes")), "sid")
    by_head = sized.groupBy("head").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("size")).where("size > 1")
    buckets = max(1, -(-(by_head.agg(F.sum("bytes")).first()[0] or 0) // tile_bytes))
    cut = F.when(F.col("bytes") > tile_bytes, F.ceil(F.col("bytes") / (tile_bytes / 2))).otherwise(1).cast("long")
    kept = members.join(by_head.select("head", cut.alias("cut")), "head")
    kept = kept.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("cut")))
    every = kept.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("head", "cut", "block"))).alias("heads"))
    each = every.select("sid", F.col("heads.head").alias("every"), F.inline("heads"))
    each = each.select("sid", "head", "cut", "block", F.filter("every", lambda h: h < F.col("head")).alias("less"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tile = F.when(F.col("cut") == 1, F.col("head")).otherwise(F.xxhash64("head", low, high))
    bucket = F.when(F.col("cut") == 1, F.pmod(F.xxhash64("head"), F.lit(buckets))).otherwise(F.pmod(F.xxhash64("head", low, high), F.lit(1 << 62)) + buckets)
    side = F.when(low == high, -1).when(F.col("block") == low, 0).otherwise(1).cast("int")
    return each.select("sid", bucket.alias("bucket"), tile.alias("tile"), side.alias("side"), "less"), buckets


# ---- exact overlaps --------------------------------------------------------------------------------------------------


class Lists:
    """Inverted lists of members' values; members are asked for in order, each for the later ones in its lists."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        _, self.code = np.unique(values, return_inverse=True)
        self.starts = starts
        owner = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        self.owner = owner[np.argsort(self.code, kind="stable")]
        counts = np.bincount(self.code) if len(self.code) else np.zeros(0, np.int64)
        self.end = np.cumsum(counts)
        self.next = self.end - counts

    def later(self, a: int) -> np.ndarray:
        code = self.code[self.starts[a] : self.starts[a + 1]]
        self.next[code] += 1
        lo = self.next[code]
        lens = self.end[code] - lo
        total = int(lens.sum())
        if not total:
            return self.owner[:0]
        return self.owner[np.repeat(lo - np.cumsum(lens) + lens, lens) + np.arange(total)]


def _values(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all elements of a column of lists, where each row starts)."""
    rows = column.combine_chunks()
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False), out=starts[1:])
    return rows.flatten().to_numpy(zero_copy_only=False).view(np.uint64), starts


def links_of(t: pa.Table, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[int, int]]]:
    """(a, the later members linked to it, their Jaccard, the bounds of its tile). t: rows by tile and sid, distinct."""
    tile, size, side = t["tile"].to_numpy().view(np.uint64), t["n"].to_numpy(), t["side"].to_numpy()
    grams, starts = _values(t["grams"])
    lists = Lists(mix(grams ^ mix(np.repeat(tile, np.diff(starts)))), starts)
    del grams
    less, less_starts = _values(t["less"])
    others = Lists(mix(less ^ mix(np.repeat(tile, np.diff(less_starts)))), less_starts)
    cuts = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]]) if len(tile) else np.zeros(1, np.int64)
    for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        for a in range(first, end):
            met, elsewhere = lists.later(a), others.later(a)
            if not len(met):
                continue
            overlap = np.bincount(met - a, minlength=end - a)
            overlap[elsewhere - a] = 0
            b = np.flatnonzero(overlap)
            shared = overlap[b]
            b += a
            jaccard = shared / (size[a] + size[b] - shared)
            good = jaccard >= threshold - 1e-12
            if side[a] >= 0:
                good &= side[b] != side[a]
            if good.any():
                yield a, b[good], jaccard[good], (first, end)


def _prepared(t: pa.Table) -> pa.Table:
    tile, sid = t["tile"].to_numpy(), t["sid"].to_numpy()
    order = np.lexsort((sid, tile))
    same = (tile[order][1:] == tile[order][:-1]) & (sid[order][1:] == sid[order][:-1])  # of rows that repeat a doc_id
    return t.take(pa.array(order[np.concatenate([[True], ~same])]))


def _linked(threshold: float):
    def found(t: pa.Table) -> pa.Table:
        t = _prepared(t)
        sid, weight = t["sid"].to_numpy(), t["weight"].to_numpy()
        root, links = np.arange(t.num_rows), np.zeros(t.num_rows, np.int64)
        for a, b, _, (first, end) in links_of(t, threshold):
            links[a] += weight[b].sum()
            links[b] += weight[a]
            roots = np.unique(np.append(root[b], root[a]))
            if len(roots) > 1:
                part = root[first:end]
                part[np.isin(part, roots)] = roots[0]
        some = np.flatnonzero(links)
        out = pa.table({"sid": sid[some], "root": sid[root[some]], "links": links[some]})
        del t, root, links
        trim()
        return out

    return found


def _paired(threshold: float):
    def found(t: pa.Table) -> pa.Table:
        t = _prepared(t)
        sid = t["sid"].to_numpy()
        parts = [(np.full(len(b), sid[a]), sid[b], j) for a, b, j, _ in links_of(t, threshold)] or [(sid[:0], sid[:0], np.zeros(0))]
        a, b, j = map(np.concatenate, zip(*parts))
        return pa.table({"a": a, "b": b, "jaccard": j})

    return found


def _joined(docs: DataFrame, n: int, threshold: float, subset: int, id_column: str, text: str, at_most: int | None, paired: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: id, sid; reps: sid, rep, weight of sets that can have partners; what the tiles found), all written in the shared folder.

    at_most: a boundary to use in place of the one of least cost.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(id_column).isNotNull()).select(F.col(text).alias("text"))
    ranges = Ranges((texts.agg(F.sum(F.length("text"))).first()[0] or 0) // 6)
    path, sets_path, lists_path, members_path = (new_path(spark, x) for x in ("shared-grams", "sets", "list-heads", "heads"))
    shared = Shared(path, shared_grams(texts, n, ranges, path), ranges)
    every = written(sets(docs, shared, n, threshold, id_column, text), "sets", sets_path)
    removed(spark, path)
    live = every.where("grams IS NOT NULL")
    reps = live.groupBy("sid", "id").agg(F.first("n").alias("n"), F.first("o").alias("o"), F.first("scan").alias("scan"), F.first(F.size("grams")).cast("long").alias("s"))
    reps = reps.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "o", "scan", "s")], F.min("id").alias("rep"), F.count("*").alias("weight"))
    reps = written(reps, "reps")
    count = reps.count()
    chosen = small(reps.select("sid", F.col("rep").alias("id"), "s", "weight"), count, 40)
    one = live.select("sid", "id", "n", "o", "grams").join(chosen, ["sid", "id"])
    x = boundary(reps, subset) if at_most is None else at_most
    members = written(heads(one, x, subset, lists_path), "heads", members_path)
    removed(spark, lists_path)
    kept = written(without_held(members), "kept-heads")
    removed(spark, members_path)
    placed, _ = tiles(kept, reps)
    placed = written(placed, "tiles")
    size = placed.agg(F.count("*"), F.sum(F.size("less"))).first()
    rows = one.join(small(placed, 1, 64 * size[0] + 8 * (size[1] or 0)), "sid").select("bucket", "tile", "sid", "side", "less", "n", "weight", "grams")
    work, kind = (_paired, "a long, b long, jaccard double") if paired else (_linked, "sid long, root long, links long")
    found = written(rows.groupBy("bucket").applyInArrow(work(threshold), kind), "found")
    ids = written(every.select("id", "sid"), "ids")
    removed(spark, sets_path)
    return ids, reps, found


def jaccard_pairs(docs: DataFrame, n=N, threshold=THRESHOLD, subset=SUBSET, id_column="doc_id", text="text", at_most: int | None = None) -> DataFrame:
    """(a, b, jaccard): every pair of different doc_ids, a < b, whose texts' n-gram sets have at least that Jaccard.

    Copies are expanded into all pairs, which grow with the square of a group; linked() has a row for each document.
    """
    ids, _, pairs = _joined(docs, n, threshold, subset, id_column, text, at_most, True)
    members = written(ids.where("sid IS NOT NULL").distinct(), "members")
    first, second = members.select(F.col("sid").alias("a"), F.col("id").alias("ida")), members.select(F.col("sid").alias("b"), F.col("id").alias("idb"))
    between = pairs.join(first, "a").join(second, "b").where("ida != idb").select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"), "jaccard")
    within = first.join(second, F.col("a") == F.col("b")).where("ida < idb").select(F.col("ida").alias("a"), F.col("idb").alias("b"), F.lit(1.0).alias("jaccard"))
    # a doc_id with several texts can meet another one twice
    return within.unionByName(between).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """(v, label): every node of the edges (a, b) with the least node that it is connected to.

    Rounds of least labels of neighbours with a jump to the label's label; each is written in the shared folder.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    both_path, last = new_path(spark, "edges"), new_path(spark, "labels")
    both = written(both.distinct(), "edges", both_path)
    labels = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), "labels", last)
    while True:
        near = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("label").alias("near"))
        least = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("far"))
        path = new_path(spark, "labels")
        fresh = written(least.join(jump, "next", "left").select("v", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels", path)
        removed(spark, last)
        labels, last = fresh.select("v", "label"), path
        if fresh.where("moved").isEmpty():
            removed(spark, both_path)
            return labels


def linked(docs: DataFrame, n=N, threshold=THRESHOLD, subset=SUBSET, id_column="doc_id", text="text", at_most: int | None = None) -> DataFrame:
    """(doc_id, class_id, links) for every doc_id."""
    ids, reps, found = _joined(docs, n, threshold, subset, id_column, text, at_most, False)
    several = ids.where("sid IS NOT NULL").groupBy("id").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a < z")
    again = ids.join(several.select("id", "a"), "id").select("a", F.col("sid").alias("b")).where("a <> b")
    labels = components(found.where("sid <> root").select(F.col("root").alias("a"), F.col("sid").alias("b")).unionByName(again))
    links = found.groupBy("sid").agg(F.sum("links").alias("found"))
    # sets that only hang together through a doc_id with several texts needn't be among reps
    known = reps.select("sid", "rep", "weight").unionByName(ids.join(several, "id").where("sid IS NOT NULL").select("sid", F.col("id").alias("rep"), F.lit(1).cast("long").alias("weight")))
    known = known.groupBy("sid").agg(F.min("rep").alias("rep"), F.max("weight").alias("weight"))
    known = known.join(labels.withColumnRenamed("v", "sid"), "sid", "left").join(links, "sid", "left")
    known = known.select("sid", "rep", F.coalesce("label", "sid").alias("label"), (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("links"))
    known = written(known, "known")
    classes = known.groupBy("label").agg(F.min("rep").alias("class"))
    in_class = written(known.join(classes, "label").select("sid", "class", "links"), "classes")
    out = ids.join(small(in_class, in_class.count(), 32), "sid", "left")
    out = out.groupBy("id", "sid").agg(F.first("class").alias("class"), F.first("links").alias("links"))
    return out.groupBy("id").agg(F.least(F.min("class"), F.col("id")).alias("class_id"), F.coalesce(F.sum("links"), F.lit(0)).alias("links")).withColumnRenamed("id", id_column)


def one_of_each_group(docs: DataFrame, n=N, threshold=THRESHOLD, subset=SUBSET, id_column="doc_id", text="text") -> DataFrame:
    """The rows without near copies of lesser doc_ids: one document of each class, the least doc_id, stays.

    Rows that repeat a doc_id are one document, of which the row with the least hash of the text stays. Rows
    without a doc_id or words are in no class and stay.
    """
    classes = linked(docs, n, threshold, subset, id_column, text)
    name = unused("gone", docs.columns)
    gone = written(classes.where(F.col("class_id") != F.col(id_column)).select(F.col(id_column).alias(name)), "gone")
    left = docs.join(small(gone, gone.count(), 16), F.col(id_column) == F.col(name), "left_anti")
    twice = docs.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias(name)).agg(F.count("*").alias("rows")).where("rows > 1").select(name)
    twice = written(twice, "twice")
    count = twice.count()
    if not count:
        return left
    repeated, rank = small(twice, count, 16), unused("rank", docs.columns)
    order = W.partitionBy(id_column).orderBy(F.xxhash64(text), F.to_json(F.struct("*")))
    again = left.join(repeated, F.col(id_column) == F.col(name), "left_semi").select("*", F.row_number().over(order).alias(rank)).where(F.col(rank) == 1).drop(rank)
    return left.join(repeated, F.col(id_column) == F.col(name), "left_anti").unionByName(again)
