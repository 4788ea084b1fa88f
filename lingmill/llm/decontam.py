"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Texts are normalised character by character: letters and digits are lower-cased and stripped of accents, combining
marks vanish, and every run of anything else is one space; the place of each remaining character in the original is
kept. The patterns are all windows of `window` normalised words of every benchmark text; a shorter text, down to an answer of
one word, is one pattern of all its words. Each document is scanned once, whole; matches are whole words. Hits of one
item make a span in characters of the original.

find() reports them all (`least` is 1). without_contaminated() drops a document for texts of EVIDENCE words or more:
that a document has the word "yes" doesn't say that it has the test; `least` is its parameter too.

The automaton is broadcast as its patterns and built once a worker. Should the patterns exceed `limit` characters,
they are split over several automata, so that a worker never holds more; each part then takes one scan.

Defined results: a null or empty text matches nothing, as do null or empty benchmark texts; a null item_id is reported
as null; a null doc_id is reported as null; several items with the same passage are all reported; repeated rows are
reported once each; empty tables give an empty result (an empty benchmark rejects nothing). Extra columns are
ignored by find(), and without_contaminated() returns exactly the columns it is given.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingmill.llm.common import sifted
from lingmill.llm.textvec import codepoints, slices

WINDOW = 8
LEAST = 1
EVIDENCE = 4
LIMIT = 1 << 25
_DROP = 0xFFFFFFFF
_LOW = 0x3000


def fold(c: str) -> int:
    """The normalised code point of a character: 0 for a separator, _DROP for a combining mark."""
    kind = unicodedata.category(c)[0]
    if kind == "M":
        return _DROP
    if kind not in "LN":
        return 0
    base = [x for x in unicodedata.normalize("NFKD", c.lower()) if unicodedata.category(x)[0] in "LN"]
    return ord(base[0]) if base else ord(c)


_FOLD_LOW = np.array([fold(chr(i)) for i in range(_LOW)], np.uint32)


def folded(cp: np.ndarray) -> np.ndarray:
    out = _FOLD_LOW[np.minimum(cp, _LOW - 1)]
    high = np.flatnonzero(cp >= _LOW)
    if len(high):
        seen, back = np.unique(cp[high], return_inverse=True)
        out[high] = np.array([fold(chr(i)) for i in seen], np.uint32)[back]
    return out


def normalised(column: pa.Array) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(the rows' normalised text, each as " word word \\n"; the original place of each character in its row; where
    each row ends in the normalised text; words before each row, with the total as the last)."""
    cp, starts = codepoints(column)
    f = folded(cp)
    solid = f != _DROP
    if not solid.all():  # marks vanish: neighbours of a mark are neighbours of each other
        where = np.flatnonzero(solid)
        before = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(solid, out=before[1:])
        f, starts_f = f[where], before[starts]
    else:
        where, starts_f = None, starts
    mask = f != 0
    first = np.zeros(len(f) + 1, bool)
    first[starts_f] = True
    prev = np.zeros(len(f), bool)
    prev[1:] = mask[:-1]
    prev &= ~first[:-1]
    begin = mask & ~prev
    words = np.zeros(len(f) + 1, np.int64)
    np.cumsum(begin, out=words[1:])
    letters = np.zeros(len(f) + 1, np.int64)
    np.cumsum(mask, out=letters[1:])
    rows = np.arange(len(starts))
    ends = letters[starts_f[1:]] + words[starts_f[1:]] + 2 * rows[1:]
    at = np.flatnonzero(mask)
    row_of = np.repeat(rows[:-1], np.diff(letters[starts_f]))
    place = np.arange(len(at)) + words[at + 1] + 2 * row_of
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, "<u4")
    out[place] = f[at]
    out[ends - 1] = 10
    origin = np.zeros(len(out), np.int64)
    origin[place] = (at if where is None else where[at]) - starts[:-1][row_of]
    return out.tobytes().decode("utf-32-le"), origin, ends, words[starts_f]


def patterns(benchmark: DataFrame, columns: list[str], item="item_id", window=WINDOW, least=LEAST) -> dict[str, list]:
    """Normalised window -> items that have it. A benchmark is a fixed test set: it is read to the driver in a stream."""
    found: dict[str, list] = {}
    for row in benchmark.select(item, *columns).toLocalIterator():
        for text in row[1:]:
            if not text:
                continue
            words = normalised(pa.array([text], pa.large_string()))[0].split()
            if len(words) < least:
                continue
            size = min(window, len(words))
            for i in range(len(words) - size + 1):
                items = found.setdefault(f" {' '.join(words[i : i + size])} ", [])
                if row[0] not in items:
                    items.append(row[0])
    return found


def parts(found: dict[str, list], limit=LIMIT) -> list[dict[str, list]]:
    """The patterns in parts of about `limit` characters; all windows of an item are in one of them."""
    by: dict = {}
    for k, items in found.items():
        for x in items:
            by.setdefault(x, []).append(k)
    out, size = [{}], 0
    for x, windows in by.items():
        chars = sum(map(len, windows))
        if size + chars > limit and size:
            out.append({})
            size = 0
        for k in windows:
            out[-1].setdefault(k, []).append(x)
        size += chars
    return out


_BUILT: dict[int, tuple[object, ahocorasick.Automaton]] = {}


def automaton(shared: Broadcast) -> ahocorasick.Automaton:
    """Built once for a worker's copy of the patterns; only the last one is kept."""
    found = shared.value
    if id(found) not in _BUILT:
        a = ahocorasick.Automaton()
        for k, items in found.items():
            a.add_word(k, (len(k), items))
        if len(a):
            a.make_automaton()
        _BUILT.clear()
        _BUILT[id(found)] = found, a
    return _BUILT[id(found)][1]


def scan(column: pa.Array, a: ahocorasick.Automaton) -> Iterator[tuple[int, int, int, tuple]]:
    """(row, start, end, items) of every hit, in characters of the original."""
    if not len(a):
        return
    for at, part in slices(column):
        text, origin, ends, _ = normalised(part)
        for end, (size, items) in a.iter(text):
            row = int(np.searchsorted(ends, end, "right"))
            yield at + row, int(origin[end - size + 2]), int(origin[end - 1]) + 1, items


def find(docs: DataFrame, benchmark: DataFrame, columns=("text",), id_column="doc_id", item="item_id", text="text", window=WINDOW, least=LEAST, limit=LIMIT) -> DataFrame:
    """(doc_id, item_id, start, end, windows) for every document row and benchmark item with a hit.

    start and end: of the first and last hit, in characters of the original; windows: hits in between.
    """
    spark = docs.sparkSession
    id_kind, item_kind = docs.schema[id_column].dataType, benchmark.schema[item].dataType
    schema = f"{id_column} {id_kind.simpleString()}, {item} {item_kind.simpleString()}, start long, end long, windows long"
    found = None
    for part in parts(patterns(benchmark, list(columns), item, window, least), limit):
        shared = spark.sparkContext.broadcast(part)

        def hits(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a = automaton(shared)
            for batch in batches:
                spans: dict = {}
                for row, start, end, items in scan(batch.column(1), a):
                    for x in items:
                        s = spans.setdefault((row, x), [start, end, 0])
                        s[0], s[1], s[2] = min(s[0], start), max(s[1], end), s[2] + 1
                rows = [r for r, _ in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array([x for _, x in spans], to_arrow(item_kind)),
                        *(pa.array([s[i] for s in spans.values()], pa.int64()) for i in range(3)),
                    ],
                    [id_column, item, "start", "end", "windows"],
                )

        one = docs.select(F.col(id_column), F.col(text)).mapInArrow(hits, schema)
        found = one if found is None else found.unionByName(one)
    return found


def to_arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, columns=("text",), item="item_id", text="text", window=WINDOW, least=EVIDENCE, limit=LIMIT) -> DataFrame:
    """The rows without any hit, with all their columns."""
    at = docs.columns.index(text)
    for part in parts(patterns(benchmark, list(columns), item, window, least), limit):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a = automaton(shared)

            def keep(batch: pa.RecordBatch) -> np.ndarray:
                kept = np.ones(batch.num_rows, bool)
                for row, *_ in scan(batch.column(at), a):
                    kept[row] = False
                return kept

            return sifted(batches, keep)

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
