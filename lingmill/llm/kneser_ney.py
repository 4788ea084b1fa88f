"""Perplexity under an interpolated modified Kneser-Ney trigram model of the corpus.

A document is <s> <s> w1 ... wn </s>, its words lower-cased runs of letters, digits and underscores, by 48-bit hashes.
Counting: tasks count the trigrams of a few million words at a time in numpy and send them, packed with a dictionary, to
the task of the middle word v. There all of (u, v) and all of (v, w) meet, so that one exchange gives the trigram counts,
the contexts' totals and the continuation counts N1+(. v w). Middle words too frequent for one task (by their share in
a bounded sample, which affects the sizes of tasks alone) are sent twice: by u for the trigrams, by w for the
continuations. Every trigram of every document is counted; nothing is pruned.

Storage: each task writes a shard to the shared folder: n-grams as sorted arrays of their hashes (an index over the first
bits, then 32 more bits an entry) with a byte an entry that says the count or names the context's counts; rare values
lie in an overflow array. Workers map the shards into memory and share the pages; where the shared folder is no local
file system, Spark's own folder of the executor holds a copy to map. Broadcast are only the paths, the discounts and the
statistics of the few split words.

Discounts are D1, D2, D3+ of Chen and Goodman for each order, from counts of counts over the whole corpus (with 0.5, 1
and 1.5 where these are too few to give them). Bigrams and unigrams use continuation counts throughout, <s> included;
unigrams are interpolated with the uniform distribution over the words, </s> and one unknown word.

Defined results: a null or empty text, or one without words, isn't counted and has a null perplexity and no words; rows
with a null doc_id are counted and scored like others; repeated rows count as often as they occur; an empty table gives
an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingmill.llm.arrays import mapped, put
from lingmill.llm.common import new_path, trim, written
from lingmill.llm.textvec import GOLDEN, codepoints, lowered, mix, slices, words

BOS, EOS = np.uint64(1), np.uint64(2)
FLUSH_WORDS = 4 << 20
SHARD_WORDS = 2 << 20
BLOCK_WORDS = 1 << 19  # that are scored at once
UNIGRAM_WORDS = 1 << 27
SAMPLE_DOCS = 20_000
_BITS = 21
_WORD = np.uint64(0xFFFFFFFFFFFF0000)  # the bits that tell words apart: the others would only fill the exchange
_MASK = np.uint64((1 << _BITS) - 1)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + GOLDEN) * GOLDEN + b)


def triple(ab: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(ab * GOLDEN + c + GOLDEN)


def documents(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, its and the next rows' words between <s> <s> and </s>, where each row starts); rows without words have nothing."""
    for at, part in slices(column):
        cp, starts = codepoints(lowered(part))
        hashes, before = words(cp, starts)
        counts = np.diff(before)
        sizes = np.where(counts > 0, counts + 3, 0)
        begin = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=begin[1:])
        out = np.full(int(begin[-1]), BOS, np.uint64)
        some = counts > 0
        out[begin[1:][some] - 1] = EOS
        out[np.arange(len(hashes)) + np.repeat(begin[:-1] + 2 - before[:-1], counts)] = hashes & _WORD
        yield at, out, begin


def targets(begin: np.ndarray) -> np.ndarray:
    """Places of all that is predicted: of each row everything after <s> <s>."""
    sizes = np.diff(begin)
    keep = np.ones(int(begin[-1]), bool)
    some = begin[:-1][sizes > 0]
    keep[some] = keep[some + 1] = False
    return np.flatnonzero(keep)


# ---- blobs -----------------------------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: memoryview, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T).view(kind).ravel()


def packed(vocabulary: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Sorted distinct hashes and columns of numbers below 2^32; the first column is sorted."""
    first = np.diff(columns[0].astype(np.int64), prepend=0).astype(np.uint32)
    parts = [np.array([len(vocabulary), len(first), len(columns)], np.int64).tobytes(), _planes(np.diff(vocabulary, prepend=np.uint64(0)))]
    parts += [_planes(x) for x in (first, *(c.astype(np.uint32) for c in columns[1:]))]
    return zstd.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = memoryview(zstd.ZstdDecompressor().decompress(blob))
    m, n, k = np.frombuffer(raw, np.int64, 3)
    at = 24
    vocabulary = np.cumsum(_unplanes(raw[at:], m, np.uint64), dtype=np.uint64)
    at += 8 * m
    columns = []
    for _ in range(k):
        columns.append(_unplanes(raw[at:], n, np.uint32))
        at += 4 * n
    columns[0] = np.cumsum(columns[0], dtype=np.int64)
    return vocabulary, columns


@dataclass
class Layout:
    """Which shard an n-gram belongs to. hot: hashes (sorted) of words that are split, and into how many parts."""

    shards: int
    hot: np.ndarray
    parts: np.ndarray

    def parts_of(self, v: np.ndarray) -> np.ndarray:
        out = np.ones(len(v), np.uint64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
            found = self.hot[at] == v
            out[found] = self.parts[at[found]]
        return out

    def of(self, v: np.ndarray, other: np.ndarray, parts: np.ndarray) -> np.ndarray:
        split = mix(other) % parts
        return (mix(v + split * GOLDEN) % np.uint64(self.shards)).astype(np.int64)


def counted(layout: Layout, stream: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(shard, role, blob of v, u, w, count) of the trigrams that end at the places. Roles: 0 both, 1 trigrams, 2 continuations."""
    vocabulary, code = np.unique(stream, return_inverse=True)
    if len(vocabulary) > 1 << _BITS:  # more than a key has room for: halves
        half = len(place) // 2
        base = place[half] - 2
        del vocabulary, code
        yield from counted(layout, stream[: place[half - 1] + 1], place[:half])
        yield from counted(layout, stream[base:], place[half:] - base)
        return
    code, b = code.view(np.uint64), np.uint64(_BITS)
    keys = code[place - 1]
    for other in (place - 2, place):
        keys <<= b
        keys |= code[other]
    del stream, code, place, other
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts, keys = np.diff(first, append=len(keys)), keys[first]
    v, u, w = (keys >> (b + b)).astype(np.int64), ((keys >> b) & _MASK).astype(np.int64), (keys & _MASK).astype(np.int64)
    parts = layout.parts_of(vocabulary)[v]
    hot = parts > 1
    routes = [(0, ~hot, w), (1, hot, u), (2, hot, w)]
    for role, chosen, other in routes:
        rows = np.flatnonzero(chosen)
        if not len(rows):
            continue
        shard = layout.of(vocabulary[v[rows]], vocabulary[other[rows]], parts[rows])
        order = np.argsort(shard, kind="stable")
        rows, shard = rows[order], shard[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            r = rows[lo:hi]
            used = np.unique(np.concatenate([v[r], u[r], w[r]]))
            yield int(shard[lo]), role, packed(vocabulary[used], [*(np.searchsorted(used, x[r]) for x in (v, u, w)), counts[r]])


# ---- sorted hash arrays ----------------------------------------------------------------------------------------------


def table(hashes: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a table from sorted distinct hashes to rows of counts."""
    n = len(hashes)
    bits = max(0, int(n // 8).bit_length() - 1)
    top = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
    offsets = np.zeros((1 << bits) + 1, np.uint32)
    np.cumsum(np.bincount(top, minlength=1 << bits), out=offsets[1:])
    low = ((hashes >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    values = values.astype(np.int64)
    key = np.zeros(n, np.uint64)
    for column in values.T:
        key = mix(key * GOLDEN + column.astype(np.uint64))
    _, first, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    common = np.argsort(-times, kind="stable")[:255]
    name = np.full(len(first), 255, np.uint8)
    name[common] = np.arange(len(common), dtype=np.uint8)
    codes = name[back]
    over = np.flatnonzero(codes == 255)
    return {"offsets": offsets, "low": low, "codes": codes, "book": values[first[common]], "over": over.astype(np.uint32), "rare": values[over]}


def lookup(t: dict[str, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Rows of counts, zeros where the hash isn't there."""
    width = t["book"].shape[1]
    out = np.zeros((len(hashes), width))
    n = len(t["low"])
    if not n or not len(hashes):
        return out
    bits = (len(t["offsets"]) - 1).bit_length() - 1
    top = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    want = ((hashes >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lo, end = t["offsets"][top].astype(np.int64), t["offsets"][top + 1].astype(np.int64)
    hi = end.copy()
    low = t["low"]
    for _ in range(int((hi - lo).max()).bit_length()):
        mid = (lo + hi) >> 1
        less = (low[np.minimum(mid, n - 1)] < want) & (lo < hi)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(less, hi, np.where(lo < hi, mid, hi))
    hit = np.flatnonzero((lo < end) & (low[np.minimum(lo, n - 1)] == want))
    code = t["codes"][lo[hit]]
    if len(t["book"]):
        out[hit] = t["book"][np.minimum(code, len(t["book"]) - 1)]
    rare = hit[code == 255]
    if len(rare):
        out[rare] = t["rare"][np.searchsorted(t["over"], lo[rare].astype(np.uint32))]
    return out


# ---- merging ---------------------------------------------------------------------------------------------------------


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts x, where each distinct value begins in it, the distinct values)."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return order, begin, s[begin]


def _context(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct contexts, rows of total count, continuations of count 1, 2, 3 or more)."""
    order, begin, distinct = _groups(keys)
    c = counts[order]
    if not len(c):
        return distinct, np.zeros((0, 4), np.int64)
    return distinct, np.stack([np.add.reduceat(x, begin) for x in (c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c >= 3).astype(np.int64))], axis=1)


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _trigrams(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(hash, u, v, w, count) of the distinct trigrams, by hash."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for blob in blobs:
        vocabulary, (v, u, w, c) = unpacked(blob)
        for out, x in zip(columns, (vocabulary[u], vocabulary[v], vocabulary[w], c.astype(np.int64))):
            out.append(x)
    if not blobs:
        none = np.zeros(0, np.uint64)
        return none, none, none, none, np.zeros(0, np.int64)
    u, v, w, c = map(np.concatenate, columns)
    order, begin, h = _groups(triple(pair(u, v), w))
    first = order[begin]
    return h, u[first], v[first], w[first], np.add.reduceat(c[order], begin)


def _joined(*parts: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)]


def merged(layout: Layout, path: str, first_hashes: list[int]):
    """For all blobs of a shard: writes its tables, with the unigrams by range of hashes; returns one row of statistics."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        by = [_trigrams([bytes(b) for b in rows.loc[rows["role"] == role, "blob"]]) for role in (0, 1, 2)]
        h, u, v, w, c = _joined(by[0], by[1])
        order = np.argsort(h, kind="stable")
        tables = {"tri": table(h[order], c[order, None])}
        n3 = _of_counts(c)
        tables["ctx3"] = table(*_context(pair(u, v), c))
        del h, u, v, w, c, order
        _, _, v, w, _ = _joined(by[0], by[2])
        del by
        order, begin, h = _groups(pair(v, w))
        first = order[begin]
        c2 = np.diff(begin, append=len(order))
        tables["bi"] = table(h, c2[:, None])
        v, w = v[first], w[first]
        contexts, stats = _context(v, c2)
        split = layout.parts_of(contexts) > 1
        hot = [[str(x), *map(int, s)] for x, s in zip(contexts[split], stats[split])]
        order2, begin2, distinct = _groups(contexts[~split])
        tables["ctx2"] = table(distinct, stats[~split][order2[begin2]])
        _, begin, ends = _groups(w)
        n = np.diff(begin, append=len(w))
        cuts = np.searchsorted(ends, np.array(first_hashes[1:-1], np.uint64))
        for i, (e, c) in enumerate(zip(np.split(ends, cuts), np.split(n, cuts))):
            tables[f"c1-{i}"] = {"blob": np.frombuffer(packed(e, [np.arange(len(e)), c]), np.uint8)}
        name = put(path, tables)
        info = {"n3": n3, "n2": _of_counts(c2), "hot": hot}
        del tables, order, first, v, w, h, c2, order2
        trim()
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "name": [name], "info": [json.dumps(info)]})

    return merge


def discounts(n: list[int]) -> list[float]:
    n1, n2, n3, n4 = n
    flat = [0.5, 1.0, 1.5]
    if not (n1 and n2 and n3 and n4):
        return flat
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return found if all(0 <= d <= i for i, d in enumerate(found, 1)) else flat


@dataclass
class Model:
    path: str
    layout: Layout
    shards: dict[int, str]
    unigrams: list[str]
    discounts: list[list[float]]  # of orders 1, 2, 3
    hot: dict[int, list[int]]  # counts of the contexts that are split words
    total: int  # continuation counts of all unigrams
    unigram_context: list[int]  # unigrams of continuation count 1, 2, 3 or more

    @property
    def words(self) -> int:
        return sum(self.unigram_context) + 1


def _hot_words(docs: DataFrame, rows: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that are over half a shard's share, by a sample of documents."""
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, stream, begin in documents(batch.column(1)):
                x, n = np.unique(stream[targets(begin) - 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n)], ["word", "n"])

    found = written(sample.mapInArrow(counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "sample")
    total = found.agg(F.sum("n")).first()[0] or 0
    # at most 2 * shards words have such a share
    top = found.where(F.col("n") * (2 * shards) > total).toArrow() if total and shards > 1 else None
    if not top:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hot, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(hot)
    return hot[order], np.ceil(2 * n[order] * shards / total).astype(np.uint64) + np.uint64(1)


def fit(docs: DataFrame, text="text", shard_words=SHARD_WORDS, flush_words=FLUSH_WORDS) -> Model | None:
    """Counts all rows of docs; None if they have no words."""
    spark = docs.sparkSession
    texts = docs.select(F.lit(0).alias("id"), F.col(text).alias("text"))
    size = texts.agg(F.count("text"), F.sum(F.length("text"))).first()
    shards = max(1, -(-(size[1] or 0) // (6 * shard_words)))
    layout = Layout(shards, *_hot_words(texts, size[0], shards))
    path = new_path(spark, "kneser-ney")
    shared = spark.sparkContext.broadcast(layout)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(streams: list, places: list) -> Iterator[pa.RecordBatch]:
            stream, place = np.concatenate(streams), np.concatenate(places)
            streams.clear()
            places.clear()
            rows = list(counted(shared.value, stream, place))
            del stream, place
            trim()
            for at in range(0, len(rows), 64):
                some = rows[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["shard", "role", "blob"])

        streams, places, size = [], [], 0
        for batch in batches:
            for _, stream, begin in documents(batch.column(1)):
                # a single text may exceed what one flush can number: it is cut, each part with two words of context
                cut = max(3, min(flush_words, 1 << (_BITS - 1)))
                where = targets(begin)
                for lo in range(0, len(where), cut):
                    some = where[lo : lo + cut]
                    if not len(some):
                        continue
                    a, z = some[0] - 2, some[-1] + 1
                    if size and size + z - a > flush_words:
                        yield from flush(streams, places)
                        streams, places, size = [], [], 0
                    streams.append(stream[a:z])
                    places.append(some - a + size)
                    size += z - a
        if size:
            yield from flush(streams, places)

    # unigrams are summed by range of hashes over all shards
    ranges = max(1, -(-shards * shard_words // UNIGRAM_WORDS))
    first_hashes = [-(-(i << 32) // ranges) << 32 for i in range(ranges + 1)]
    blobs = texts.mapInArrow(count, "shard int, role int, blob binary")
    # one partition a shard, so that a task reads the blobs of one only
    stats = written(blobs.repartitionById(shards, "shard").groupBy("shard").applyInPandas(merged(layout, path, first_hashes), "shard int, name string, info string"), "shards").collect()
    if not stats:
        return None
    infos = [json.loads(s["info"]) for s in stats]
    hot: dict[int, list[int]] = {}
    for info in infos:
        for x, *s in info["hot"]:
            hot[int(x)] = [a + b for a, b in zip(hot.get(int(x), [0] * 4), s)]
    names = [s["name"] for s in stats]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                hashes, counts = [], []
                for name in names:
                    h, (_, n) = unpacked(mapped(path, name)[f"c1-{i}"]["blob"].tobytes())
                    hashes.append(h)
                    counts.append(n.astype(np.int64))
                order, begin, h = _groups(np.concatenate(hashes))
                c = np.add.reduceat(np.concatenate(counts)[order], begin) if len(h) else np.zeros(0, np.int64)
                name = put(path, {"uni": table(h, c[:, None])})
                info = {"n1": _of_counts(c), "total": int(c.sum()), "types": [int((c == 1).sum()), int((c == 2).sum()), int((c >= 3).sum())]}
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([name]), pa.array([json.dumps(info)])], ["range", "name", "info"])

    parts = spark.range(0, ranges, 1, ranges).mapInArrow(summed, "range long, name string, info string")
    uni = sorted(written(parts, "unigrams").collect())
    uinfo = [json.loads(r["info"]) for r in uni]
    total = lambda rows: [sum(x) for x in zip(*rows)]
    return Model(
        path,
        layout,
        {s["shard"]: s["name"] for s in stats},
        [r["name"] for r in uni],
        [discounts(total(x)) for x in ([i["n1"] for i in uinfo], [i["n2"] for i in infos], [i["n3"] for i in infos])],
        hot,
        sum(i["total"] for i in uinfo),
        total([i["types"] for i in uinfo]),
    )


# ---- scoring ---------------------------------------------------------------------------------------------------------


class Scorer:
    """Log probabilities from the mapped shards."""

    def __init__(self, model: Model):
        self.m = model
        self.open: dict[str, dict] = {}
        self.hot = np.array(sorted(model.hot), np.uint64)
        self.hot_stats = np.array([model.hot[int(x)] for x in self.hot], float).reshape(-1, 4)

    def file(self, name: str) -> dict[str, dict[str, np.ndarray]]:
        if name not in self.open:
            self.open[name] = mapped(self.m.path, name)
        return self.open[name]

    def spread(self, shard: np.ndarray, asks: list[tuple[str, np.ndarray, int]], names) -> list[np.ndarray]:
        """Looks up hashes in tables, by shard. asks: (table, hashes, width)."""
        out = [np.zeros((len(shard), width)) for _, _, width in asks]
        order = np.argsort(shard, kind="stable")
        s = shard[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]]) if len(s) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            name = names(int(s[lo]))
            if name is None:
                continue
            tables, rows = self.file(name), order[lo:hi]
            for o, (t, hashes, _) in zip(out, asks):
                h = hashes[rows]
                near = np.argsort(h)  # neighbours in the arrays are read together
                o[rows[near]] = lookup(tables[t], h[near])
        return out

    def log_probabilities(self, stream: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of the words at the places, each after the two words before it. Equal words and bigrams are looked up once."""
        m, layout = self.m, self.m.layout
        d1, d2, d3 = m.discounts
        words, code = np.unique(stream, return_inverse=True)
        parts = layout.parts_of(words)
        # words: unigrams, and contexts of bigrams
        (ctx2,) = self.spread(layout.of(words, words, np.ones(len(words), np.uint64)), [("ctx2", words, 4)], m.shards.get)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
            found = self.hot[at] == words
            ctx2[found] = self.hot_stats[at[found]]
        range_of = (((words >> np.uint64(32)) * np.uint64(len(m.unigrams))) >> np.uint64(32)).astype(np.int64)
        (uni,) = self.spread(range_of, [("uni", words, 1)], lambda i: m.unigrams[i])
        n1, n2, n3 = m.unigram_context
        p1 = (uni[:, 0] - _discount(uni[:, 0], d1) + (d1[0] * n1 + d1[1] * n2 + d1[2] * n3) / m.words) / m.total
        # bigrams: of the last two words, and contexts of trigrams
        both, two = np.unique(code[:-1] * np.int64(len(words)) + code[1:], return_inverse=True)
        first, second = np.divmod(both, len(words))
        x, y = words[first], words[second]
        hashes = pair(x, y)
        (bi,) = self.spread(layout.of(x, y, parts[first]), [("bi", hashes, 1)], m.shards.get)
        (ctx3,) = self.spread(layout.of(y, x, parts[second]), [("ctx3", hashes, 4)], m.shards.get)
        p2 = _interpolated(bi[:, 0], ctx2[first], d2, p1[second])
        # trigrams
        before, last = two[place - 2], two[place - 1]
        v = code[place - 1]
        (tri,) = self.spread(layout.of(words[v], words[code[place - 2]], parts[v]), [("tri", triple(hashes[before], words[code[place]]), 1)], m.shards.get)
        return np.log(_interpolated(tri[:, 0], ctx3[before], d3, p2[last]))


def _interpolated(count: np.ndarray, context: np.ndarray, d: list[float], lower: np.ndarray) -> np.ndarray:
    gamma = context[:, 1:] @ np.array(d)
    return np.where(context[:, 0] > 0, (count - _discount(count, d) + gamma * lower) / np.maximum(context[:, 0], 1), lower)


def _discount(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


def perplexity(docs: DataFrame, model: Model | None, id_column="doc_id", text="text") -> DataFrame:
    """(doc_id, words, log_probability, perplexity) for every row; words without </s>, which is predicted too."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            rows = batch.num_rows
            count, total = np.zeros(rows, np.int64), np.zeros(rows)
            pending: list[tuple[int, np.ndarray, np.ndarray]] = []

            def settle() -> None:
                if not pending:
                    return
                places, size = [], 0
                for _, stream, begin in pending:
                    places.append(targets(begin) + size)
                    size += len(stream)
                logs = scorer.log_probabilities(np.concatenate([x for _, x, _ in pending]), np.concatenate(places))
                done = 0
                for at, _, begin in pending:
                    n = np.where(np.diff(begin) > 0, np.diff(begin) - 2, 0)
                    ends = np.cumsum(n)
                    sums = np.concatenate([[0.0], np.cumsum(logs[done : done + int(ends[-1])])])
                    total[at : at + len(n)] = sums[ends] - sums[ends - n]
                    count[at : at + len(n)] = n
                    done += int(ends[-1])
                pending.clear()
                del places, logs
                trim()

            if scorer:
                for item in documents(batch.column(1)):
                    pending.append(item)
                    if sum(len(x[1]) for x in pending) > BLOCK_WORDS:
                        settle()
                settle()
            fill = lambda x: pa.array(x, mask=np.asarray(count == 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.maximum(count - 1, 0)), fill(total), fill(np.exp(-total / np.maximum(count, 1)))], ["id", "words", "log_probability", "perplexity"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(scored, f"id {kind}, words long, log_probability double, perplexity double")
    return rows.withColumnRenamed("id", id_column)
