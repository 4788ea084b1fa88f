"""Approximate nearest neighbours through low-dimensional stable projections and a kd-tree.

Vectors are projected to M dimensions by Gaussian (2-stable) directions: the squared projected distance over the squared
true distance follows a chi-square law with M degrees of freedom. A kd-tree over the projections yields the vectors of each
query in the order of their projected distance; their true distances are verified, and the query stops as soon as
chi2_M(r^2 / d_k^2) >= CONFIDENCE, r being the next projected distance and d_k the true distance of its k-th neighbour
so far: a closer vector would have shown up by then with that probability, whatever the data. There is no cap on the
number of verified candidates.

Distribution: the top of the kd-tree cuts the projected space into cells of about `cell_rows` vectors. Its splits come
from a sample of about `sample` vectors, of which only the projections reach the driver; they affect the cells' sizes alone,
all vectors are indexed. A cell that came out too large is divided by a hash of the id into parts that are searched one
by one. Each part is written once as a kd-tree of its own to the shared folder, and workers map it; so vectors move
once, and queries, in any number, go where the trees are, in even partitions. A query first searches its own cell; with the
d_k found there it is sent to those cells alone whose box the stopping test doesn't exclude, and the results are merged.

Defined results: rows with a null id, a null or empty vector, a null or NaN component or one of 1e150 or more (infinite
ones among them: their squares overflow), or a length other than the most frequent one (of equally frequent ones the
longest) are neither queries nor neighbours; of rows that repeat an id the least vector counts; a vector is never its own
neighbour but equal vectors are neighbours at distance 0; of equal distances the lesser id comes first; where there are
fewer than k others all are given; an empty table gives an empty result. Only the two named columns are read, and those
that the condition on queries names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingmill.llm.arrays import mapped, put
from lingmill.llm.common import new_path, small, trim, written

K = 10
M = 8
CONFIDENCE = 0.97
CELL_ROWS = 1 << 14
LEAF_ROWS = 64
SAMPLE = 1 << 16
QUERIES_A_TASK = 256


def chi2_cdf(x: float, m: int) -> float:
    """For even m."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1.0
    while chi2_cdf(hi, m) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def directions(dims: int, m: int = M, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, m))


def kd_leaves(points: np.ndarray, leaf_rows: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: median splits of the widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf_rows:
            out.append(rows)
            continue
        part = points[rows]
        dim = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = np.argpartition(part[:, dim], len(rows) // 2)
        todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return out


def kd_splits(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """The top of the tree: nodes (dimension, value, left, right); children below 0 are cells -1 - n."""
    nodes: list[tuple[int, float, int, int]] = []

    def build(rows: np.ndarray, wanted: int, cell: list[int]) -> int:
        if wanted <= 1 or len(rows) < 2 or (np.ptp(sample[rows], axis=0) == 0).all():
            cell[0] += 1
            return -cell[0]
        dim = int(np.argmax(np.ptp(sample[rows], axis=0)))
        left = wanted // 2
        values = np.sort(sample[rows, dim])
        value = float(values[min(len(values) - 1, max(1, len(values) * left // wanted))])
        below = sample[rows, dim] < value
        if not below.any():
            value = float(values[values > values[0]][0])
            below = sample[rows, dim] < value
        at = len(nodes)
        nodes.append((dim, value, 0, 0))
        nodes[at] = (dim, value, build(rows[below], left, cell), build(rows[~below], wanted - left, cell))
        return at

    build(np.arange(len(sample)), cells, [0])
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))] if nodes else []
    while todo:
        node, rows = todo.pop()
        dim, value, left, right = nodes[node]
        below = points[rows, dim] < value
        for child, part in ((left, rows[below]), (right, rows[~below])):
            if not len(part):
                continue
            if child < 0:
                out[part] = -1 - child
            else:
                todo.append((child, part))
    return out


def box_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared least distances of a point to each box."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(axis=1)


def tree_of(rank: np.ndarray, vectors: np.ndarray, projected: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(the order of the leaves, the arrays of a part of the index in that order). rank: the place of each id among all of the part."""
    leaves = kd_leaves(projected, leaf_rows)
    order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in leaves])]).astype(np.int64)
    p = projected[order]
    low, high = (f.reduceat(p, starts[:-1]) if len(order) else p for f in (np.minimum, np.maximum))
    return order, {"rank": rank[order], "vectors": vectors[order], "projected": p, "starts": starts, "low": low, "high": high}


def search(tree: dict[str, np.ndarray], query: np.ndarray, projected: np.ndarray, own: int, k: int, bound: float, quantile: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows of the k nearest that the stopping test lets find, squared distances, verified vectors).

    own: the row of the query itself, or -1; bound: squared distance of the k-th neighbour that it has from elsewhere.
    """
    starts, rank = tree["starts"], tree["rank"]
    near = box_distances(projected, tree["low"], tree["high"])
    order = np.argsort(near, kind="stable")
    near = near[order]
    best, who = np.zeros(0), np.zeros(0, np.int64)
    kth, at, step, verified = bound, 0, 2, 0
    equal = 1e-12 * (1 + projected @ projected)  # equal vectors, whose projections may differ by rounding, are all verified: the least ids win
    limit = lambda: max(quantile * kth, equal)
    wait_r, wait_row = np.zeros(0), np.zeros(0, np.int64)  # projected but not yet next in order
    while at < len(order) or len(wait_r):
        if at < len(order) and near[at] < limit():
            leaves = order[at : at + step]
            rows = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in leaves])
            at += len(leaves)
            step = min(64, 2 * step)
            r = ((tree["projected"][rows] - projected) ** 2).sum(axis=1)
            wait_r, wait_row = np.concatenate([wait_r, r]), np.concatenate([wait_row, rows])
        else:
            at = len(order)
        # everything nearer than what is left of the tree is next, in order of its projected distance
        ready = (wait_r <= near[at]) if at < len(order) else np.ones(len(wait_r), bool)
        ready_r, ready_row = wait_r[ready], wait_row[ready]
        wait_r, wait_row = wait_r[~ready], wait_row[~ready]
        by = np.argsort(ready_r, kind="stable")
        ready_r, ready_row = ready_r[by], ready_row[by]
        done, size = 0, max(2 * k, 32)
        while done < len(ready_r) and ready_r[done] < limit():
            rows = ready_row[done : done + size]
            rows = rows[ready_r[done : done + size] < limit()]
            done, size = done + size, 2 * size
            verified += len(rows)
            rows = rows[rows != own]
            d = ((tree["vectors"][rows].astype(np.float64) - query) ** 2).sum(axis=1)
            best, who = np.concatenate([best, d]), np.concatenate([who, rows])
            top = np.lexsort((rank[who], best))[:k]
            best, who = best[top], who[top]
            if len(best) == k:
                kth = min(kth, best[-1])
        if done < len(ready_r):  # the test holds
            break
    return who, best, verified


def _stack(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ids(blob: np.ndarray) -> pa.Array:
    with pa.ipc.open_stream(pa.py_buffer(blob.tobytes())) as reader:
        return reader.read_all().column(0).combine_chunks()


def _cleaned(vectors: DataFrame, id_column: str, vector: str, of: Column | None) -> DataFrame:
    """(id, v, asks): usable rows, one for each id."""
    native = vectors.schema[vector].dataType.simpleString()
    kind = native if native in ("array<float>", "array<double>") else "array<double>"
    v = F.col("v")
    rows = vectors.where(F.col(id_column).isNotNull())
    rows = rows.select(F.col(id_column).alias("id"), F.col(vector).cast(kind).alias("v"), F.coalesce(F.lit(True) if of is None else of, F.lit(False)).alias("asks"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 1e150)))
    twice = written(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "twice")
    count = twice.count()
    if not count:
        return rows
    repeated = small(twice, count, 24)
    again = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    return rows.join(repeated, "id", "left_anti").unionByName(again)


def neighbours(vectors: DataFrame, of: Column | None = None, k=K, m=M, confidence=CONFIDENCE, cell_rows=CELL_ROWS, sample=SAMPLE, id_column="vec_id", vector="embedding", seed=42) -> DataFrame:
    """(id, rank, neighbour, distance): the k nearest among all vectors, rank from 1, of every vector that `of` holds for (None: of all)."""
    spark = vectors.sparkSession
    id_type = vectors.schema[id_column].dataType
    kind = id_type.simpleString()
    schema = f"id {kind}, rank int, neighbour {kind}, distance double"
    rows = _cleaned(vectors, id_column, vector, of)
    lengths = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    dims, total, tasks = lengths[0]["dims"], lengths[0]["n"], max(1, -(-lengths[0]["asks"] // QUERIES_A_TASK))
    rows = rows.where(F.size("v") == dims)
    matrix, quantile = directions(dims, m, seed), chi2_quantile(confidence, m)

    def projections(column: pa.Array) -> np.ndarray:
        return _stack(column).astype(np.float64) @ matrix

    cells = max(1, min(-(-total // cell_rows), sample // 16))
    nodes: list[tuple[int, float, int, int]] = []
    if cells > 1:
        share = min(1.0, sample / total)

        def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(projections(batch.column(0))), pa.list_(pa.float64()))], ["p"])

        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("v").mapInArrow(projected, "p array<double>").toArrow()
        nodes = kd_splits(_stack(some["p"]), cells) if some.num_rows > 1 else []

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = projections(batch.column(0))
            cell = cell_of(p, nodes)
            found = np.unique(cell)
            parts = [p[cell == c] for c in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array([len(x) for x in parts], pa.int64())] + [pa.array([f(x[:, i]) for x in parts], pa.float64()) for f in (np.min, np.max) for i in range(m)],
                ["cell", "n", *[f"low{i}" for i in range(m)], *[f"high{i}" for i in range(m)]],
            )

    sides = [f"{s}{i}" for s in ("low", "high") for i in range(m)]
    by_cell = rows.select("v").mapInArrow(measured, "cell long, n long, " + ", ".join(f"{s} double" for s in sides))
    boxes = sorted(by_cell.groupBy("cell").agg(F.sum("n").alias("n"), *[(F.min if s[0] == "l" else F.max)(s).alias(s) for s in sides]).collect())  # at most sample / 16 cells
    numbers, counts = np.array([b["cell"] for b in boxes]), np.array([b["n"] for b in boxes])
    low, high = (np.array([[b[f"{s}{i}"] for i in range(m)] for b in boxes]).reshape(-1, m) for s in ("low", "high"))
    parts = {int(c): int(-(-n // (2 * cell_rows))) for c, n in zip(numbers, counts)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cell_of(projections(batch.column("v")), nodes)
                split = np.array([parts[c] for c in cell.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(split)], [*batch.schema.names, "cell", "parts"])

    vector_kind = rows.schema["v"].dataType.simpleString()
    points = rows.select("id", "v").mapInArrow(placed, f"id {kind}, v {vector_kind}, cell long, parts long")
    path = new_path(spark, "trees")

    def planted(t: pa.Table) -> pa.Table:
        ids, x = t["id"].combine_chunks(), _stack(t["v"])
        rank = np.empty(len(x), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(x))
        order, arrays = tree_of(rank, x, x.astype(np.float64) @ matrix)
        out = pa.BufferOutputStream()
        held = pa.table({"id": ids.take(pa.array(order))})
        with pa.ipc.new_stream(out, held.schema) as writer:
            writer.write_table(held)
        arrays["ids"] = np.frombuffer(out.getvalue(), np.uint8)
        name = put(path, {"tree": arrays})
        done = pa.table({"cell": t["cell"].slice(0, 1), "part": t["part"].slice(0, 1), "name": pa.array([name])})
        trim()
        return done

    index = points.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    trees = written(index.groupBy("cell", "part").applyInArrow(planted, "cell long, part long, name string"), "tree-names")
    best = f"array<struct<distance: double, id: {kind}>>"

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tree, ids = None, {}, None
        for batch in batches:
            names, own_ids, bounds = batch.column("name").to_pylist(), batch.column("id"), batch.column("bound").to_numpy(zero_copy_only=False)
            if not len(names):
                continue
            x = _stack(batch.column("v")).astype(np.float64)
            p = x @ matrix
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            distances, who, lens = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if names[lo] != name:
                    name = names[lo]
                    tree = mapped(path, name)["tree"]
                    ids = _ids(tree["ids"])
                own = pc.index_in(own_ids.slice(lo, hi - lo), ids).to_pylist()
                for i in range(lo, hi):
                    w, d, _ = search(tree, x[i], p[i], -1 if own[i - lo] is None else own[i - lo], k, bounds[i], quantile)
                    who.append(ids.take(pa.array(w)))
                    distances.append(d)
                    lens.append(len(d))
            offsets = np.zeros(len(lens) + 1, np.int32)
            np.cumsum(lens, out=offsets[1:])
            found = pa.StructArray.from_arrays([pa.array(np.concatenate(distances)), pa.concat_arrays(who)], ["distance", "id"])
            yield pa.RecordBatch.from_arrays([own_ids, batch.column("v"), batch.column("cell"), pa.ListArray.from_arrays(pa.array(offsets), found)], ["id", "v", "cell", "best"])

    def asked(queries: DataFrame) -> DataFrame:
        """queries (id, v, cell, bound): searched in all parts of their cells; by tree, in even partitions."""
        where = queries.join(trees, "cell").select("id", "v", "cell", "bound", "name")
        ordered = where.repartitionByRange(tasks, "name", "id").sortWithinPartitions("name")
        return ordered.mapInArrow(searched, f"id {kind}, v {vector_kind}, cell long, best {best}")

    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    queries = rows.where("asks").select("id", "v").mapInArrow(placed, f"id {kind}, v {vector_kind}, cell long, parts long")
    own = asked(queries.select("id", "v", "cell", F.lit(float("inf")).alias("bound")))
    first = written(own.groupBy("id").agg(F.first("v").alias("v"), F.first("cell").alias("cell"), nearest.alias("best")), "own-cells")
    bound = F.when(F.size("best") == k, F.element_at("best.distance", -1)).otherwise(F.lit(float("inf")))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, at, bounds = projections(batch.column("v")), batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
            rows_of, to = [], []
            for i in range(len(p)):
                some = numbers[(box_distances(p[i], low, high) < quantile * bounds[i]) & (numbers != at[i])]
                rows_of.append(np.full(len(some), i))
                to.append(some)
            take = pa.array(np.concatenate(rows_of))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("v").take(take), pa.array(np.concatenate(to)), batch.column("bound").take(take)], ["id", "v", "cell", "bound"])

    others = asked(first.select("id", "v", "cell", bound.alias("bound")).mapInArrow(opened, f"id {kind}, v {vector_kind}, cell long, bound double")) if len(numbers) > 1 else None
    every = first.select("id", "best") if others is None else first.select("id", "best").unionByName(others.select("id", "best"))
    merged = every.groupBy("id").agg(nearest.alias("best")).select("id", F.posexplode("best").alias("pos", "b"))
    return merged.select(F.col("id").alias(id_column), (F.col("pos") + 1).alias("rank"), F.col("b.id").alias("neighbour"), F.sqrt("b.distance").alias("distance"))
