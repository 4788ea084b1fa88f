"""Arrays in files of the shared folder, written by tasks and mapped by workers, which share their pages."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingmill.llm.common import new_path, written

SHARD_ROWS = 1 << 20


def put(path: str, tables: dict[str, dict[str, np.ndarray]]) -> str:
    """Writes tables as one file of aligned arrays; returns its name, which no other attempt shares."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path)
    system.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    layout, at = {}, 0
    for t, arrays in tables.items():
        for a, x in arrays.items():
            layout[f"{t}/{a}"] = (at, str(x.dtype), list(x.shape))
            at += -(-x.nbytes // 64) * 64
    head = json.dumps(layout).encode()
    head = len(head).to_bytes(8, "little") + head
    head += b" " * (-len(head) % 64)
    with system.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(head)
        for arrays in tables.values():
            for x in arrays.values():
                out.write(np.ascontiguousarray(x).tobytes())
                out.write(b"\0" * (-x.nbytes % 64))
    return name


def _local(path: str, name: str) -> str:
    """A path to map: the file itself, or a copy in the executor's own Spark folder."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        return f"{base}/{name}"
    here = f"{SparkFiles.getRootDirectory()}/{name}"
    if not os.path.exists(here):
        part = f"{here}.{uuid.uuid4().hex}"
        with system.open_input_stream(f"{base}/{name}", compression=None) as src, open(part, "wb") as out:
            while chunk := src.read(16 << 20):
                out.write(chunk)
        os.replace(part, here)
    return here


def mapped(path: str, name: str) -> dict[str, dict[str, np.ndarray]]:
    raw = np.memmap(_local(path, name), np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    base = -(-(8 + size) // 64) * 64
    out: dict[str, dict[str, np.ndarray]] = {}
    for key, (at, kind, shape) in json.loads(raw[8 : 8 + size].tobytes()).items():
        t, a = key.split("/")
        n = int(np.prod(shape))
        out.setdefault(t, {})[a] = raw[base + at : base + at + n * np.dtype(kind).itemsize].view(kind).reshape(shape) if n else np.zeros(shape, kind)
    return out


class Numbers:
    """A number for each of many strings, in mapped files: names has one for each shard, or None for one without strings."""

    def __init__(self, path: str, names: list[str | None]):
        self.path, self.names, self.open = path, names, {}

    def __getstate__(self):
        return {"path": self.path, "names": self.names, "open": {}}

    def found(self, strings: Iterable[str]) -> dict[str, float]:
        """The numbers of those strings that have one."""
        by: dict[int, list] = {}
        for t in strings:
            key = md5(t.encode(), usedforsecurity=False).digest()
            by.setdefault(int.from_bytes(key[:4], "big") * len(self.names) >> 32, []).append((key, t))
        out = {}
        for shard, asked in by.items():
            if self.names[shard] is None:
                continue
            if shard not in self.open:
                self.open[shard] = mapped(self.path, self.names[shard])["numbers"]
            keys, numbers = self.open[shard]["keys"], self.open[shard]["numbers"]
            want = np.array([k for k, _ in asked], "S16")
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == want)
            out.update((asked[i][1], x) for i, x in zip(hit.tolist(), numbers[at[hit]].tolist()))
        return out

    def get(self, string: str, default: float | None = None) -> float | None:
        return self.found([string]).get(string, default)


def numbers(rows: DataFrame, string: str, number: Column, count: int) -> Numbers:
    """Writes the numbers of count rows of distinct strings."""
    shards, path = max(1, -(-count // SHARD_ROWS)), new_path(rows.sparkSession, "numbers")
    key = F.md5(F.col(string))  # of its UTF-8
    shard = F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * shards, 32).cast("int")

    def stored(part: pa.Table) -> pa.Table:
        keys = np.array(part["key"].to_pylist(), "S16")
        order = np.argsort(keys)
        name = put(path, {"numbers": {"keys": keys[order], "numbers": part["number"].to_numpy()[order]}})
        return pa.table({"shard": part["shard"].slice(0, 1).cast(pa.int32()), "name": pa.array([name])})

    keyed = rows.select(shard.alias("shard"), F.unhex(key).alias("key"), number.cast("double").alias("number"))
    names = dict(map(tuple, written(keyed.groupBy("shard").applyInArrow(stored, "shard int, name string"), "shards").collect()))
    return Numbers(path, [names.get(i) for i in range(shards)])
