"""Sequence packing: shortest-pack-first over the length histogram.

Documents longer than `capacity` are cut into pieces of that many units and a rest, so that whole texts are packed.
The lengths of all pieces make a histogram (at most `capacity` rows, however large the corpus). On the driver the
lengths are placed longest first: each goes into the shortest open pack that has room, and whole batches of equal
packs are handled at once as a pattern with a count. Each use of a length in a pattern is then an interval of ranks
among the pieces of that length, and pieces join their pattern by length and rank. Ranks are counted in two steps
(within BUCKETS buckets by a hash of the identifier, then the buckets' offsets), so that no length, however frequent, has
to be sorted in one task.

Defined results: a null or empty text has length 0 and takes no room: its pack is null; a null identifier is packed
like any other; repeated rows are packed each; equal lengths are ranked by bucket, identifier and piece; an empty
table gives an empty result. Only the identifier and the text are read, so that other columns can have any name.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lingmill.llm.common import small, written

CAPACITY = 2048
BUCKETS = 1 << 10

Pattern = tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """[(((length, times), ...), packs of this pattern), ...], longest lengths first within a pattern."""
    room: dict[int, list[list]] = {}
    open_rooms: list[int] = []  # a heap of the most room first
    done: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, left: int, count: int) -> None:
        if left == 0:
            done.append((pattern, count))
            return
        if left not in room:
            room[left] = []
            heappush(open_rooms, -left)
        room[left].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if open_rooms and -open_rooms[0] >= length:
                left = -open_rooms[0]
                pattern, count = room[left].pop()
                if not room[left]:
                    del room[left]
                    heappop(open_rooms)
                used = min(n, count)
                if used < count:
                    put(pattern, left, count - used)
                grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
                put(grown, left - length, used)
                n -= used
            else:
                times = capacity // length
                full, rest = divmod(n, times)
                if full:
                    put(((length, times),), capacity - length * times, full)
                if rest:
                    put(((length, rest),), capacity - length * rest, 1)
                n = 0
    for left in sorted(room):
        done.extend((p, c) for p, c in room[left])
    heapify(open_rooms)
    merged: dict[Pattern, int] = {}
    for p, c in done:
        merged[p] = merged.get(p, 0) + c
    return sorted(merged.items(), reverse=True)


def intervals(packs: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, times, first pack, place in the pack of the first, the pattern's number)."""
    at: dict[int, int] = {}
    out, base = [], 0
    for number, (pattern, count) in enumerate(packs):
        place = 0
        for length, times in pattern:
            start = at.get(length, 0)
            at[length] = start + count * times
            out.append((length, start, at[length], times, base, place, number))
            place += length * times
        base += count
    return out


def word_count(text: str | Column) -> Column:
    """Runs of other characters than white space; regexp_count would make a string of each and an array of all."""
    marks = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\S++", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, r"\s++", "")), F.lit(0)).cast("long")


def pack(docs: DataFrame, length: Column | None = None, id_column="doc_id", text="text", capacity=CAPACITY, buckets=BUCKETS) -> DataFrame:
    """(id, piece, length, pack, place, pattern): place is where the piece begins in its pack.

    length: the length of a row in units; words of `text` if None.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_column).alias("id"), (word_count(text) if length is None else length).cast("long").alias("total"))
    pieces = F.when(F.col("total") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / capacity).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = sized.select("id", "total", F.explode(pieces).alias("piece"))
    rows = rows.select(
        "id", "piece", F.greatest(F.lit(0), F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity)).cast("long").alias("length")
    )
    rows = written(rows, "pieces")  # the texts are read and measured once
    histogram = {r["length"]: r["n"] for r in rows.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = intervals(shortest_pack_first(histogram, capacity))
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy(F.col("id").asc_nulls_first(), "piece")) - 1
    ranked = bucketed.withColumn("rank", within.cast("long"))
    offsets = (
        bucketed.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    ranked = ranked.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("offset"))
    ranges = spark.createDataFrame(found, "length long, first long, after long, times long, base long, start long, pattern long")
    o = F.col("rank") - F.col("first")
    return (
        ranked.alias("r")
        .join(small(ranges, len(found), 56).alias("i"), (F.col("r.length") == F.col("i.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")), "left")
        .select(
            F.col("id").alias(id_column),
            "piece",
            F.col("r.length").alias("length"),
            (F.col("base") + F.floor(o / F.col("times"))).cast("long").alias("pack"),
            (F.col("start") + F.pmod(o, F.col("times")) * F.col("r.length")).cast("long").alias("place"),
            "pattern",
        )
    )
