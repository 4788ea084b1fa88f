"""WARC archives with a Zstandard dictionary (.warc.zst).

Each archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from the archive's own
records, all of them; then each record is one Zstandard frame, compressed on its own with that dictionary, so that any
record can be read by itself from its offset. An archive takes the rows of one input partition in their order, up to
`archive_bytes` of records; the next rows begin another. Nothing is shuffled, and memory is bounded by archive_bytes.

archived() returns the frames as rows: a pure function of its input, so that lost tasks simply run again. save() puts
them into files, each written under a name of its own and renamed when complete; read() gets the records back.

Defined results: a null or empty html is a record with an empty block; a null or empty url gives the target
urn:page:<page_id>; a null page_id is archived with an identifier made from the contents alone, and equal rows are
archived each, with the same identifier; archives too small to train on (under 10 KB, or all alike) get a dictionary of their raw content; a record
larger than archive_bytes has an archive to itself; an empty table gives no archive. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 112_640
LEAST_BYTES = 10 * 1024
SAMPLE_BYTES = 1 << 16
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
FRAMES = "archive string, seq long, id {kind}, record_id string, offset long, length long, frame binary"


def record(page_id, url: str | None, html: str | None, date=DATE) -> tuple[str, bytes]:
    """(record id, a WARC/1.1 resource record)."""
    block = (html or "").encode("utf-8", "surrogatepass")
    target = (url or "").strip() or f"urn:page:{'' if page_id is None else page_id}"
    name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{target}\n{hashlib.sha1(block).hexdigest()}')}"
    digest = hashlib.sha1(block).hexdigest()
    lines = [
        "WARC/1.1",
        "WARC-Type: resource",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(target.split())}",
        f"WARC-Block-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    return name, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size=DICTIONARY_BYTES) -> zstd.ZstdCompressionDict:
    """Trained on all records, in samples of at most SAMPLE_BYTES; the records themselves where they are under LEAST_BYTES, or all alike."""
    whole = b"".join(records)
    samples = [r[i : i + SAMPLE_BYTES] for r in records for i in range(0, len(r), SAMPLE_BYTES)]
    if len(whole) >= LEAST_BYTES and len(set(samples)) >= 8:
        return zstd.train_dictionary(min(size, len(whole) // 10), samples, k=256, d=8)
    content = b"".join(dict.fromkeys(samples))
    return zstd.ZstdCompressionDict(content[-size:] if len(content) >= 8 else content.ljust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT)


def frames(records: list[bytes], level=LEVEL, size=DICTIONARY_BYTES) -> Iterator[bytes]:
    """The dictionary's skippable frame, then one frame a record."""
    d = dictionary(records, size)
    raw = d.as_bytes()
    yield struct.pack("<II", MAGIC, len(raw)) + raw
    c = zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=True, write_checksum=True)
    for r in records:
        yield c.compress(r)


def archived(pages: DataFrame, id_column="page_id", url="url", html="html", prefix="pages", archive_bytes=ARCHIVE_BYTES, level=LEVEL, dictionary_bytes=DICTIONARY_BYTES) -> DataFrame:
    """(archive, seq, id, record_id, offset, length, frame): seq 0 is the dictionary, without id and record_id."""
    kind = pages.schema[id_column].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, names, records, size = [], [], [], 0
        id_type = None

        def flush() -> Iterator[pa.RecordBatch]:
            archive, at = f"{prefix}-{part:06d}-{number:05d}.warc.zst", 0
            seq, chunk, taken = 0, [], 0
            keys, labels = [None, *ids], [None, *names]
            for frame in frames(records, level, dictionary_bytes):
                chunk.append((seq, at, frame))
                at += len(frame)
                taken += len(frame)
                seq += 1
                if taken > 4 << 20 or seq == len(keys):
                    lo, hi = chunk[0][0], seq
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([archive] * len(chunk), pa.string()),
                            pa.array([x[0] for x in chunk], pa.int64()),
                            pa.array(keys[lo:hi], id_type),
                            pa.array(labels[lo:hi], pa.string()),
                            pa.array([x[1] for x in chunk], pa.int64()),
                            pa.array([len(x[2]) for x in chunk], pa.int64()),
                            pa.array([x[2] for x in chunk], pa.binary()),
                        ],
                        ["archive", "seq", "id", "record_id", "offset", "length", "frame"],
                    )
                    chunk, taken = [], 0

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, u, h in zip(*batch.columns):
                name, data = record(i.as_py(), u.as_py(), h.as_py())
                if records and size + len(data) > archive_bytes:
                    yield from flush()
                    number += 1
                    ids, names, records, size = [], [], [], 0
                ids.append(i.as_py())
                names.append(name)
                records.append(data)
                size += len(data)
        if records:
            yield from flush()

    rows = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(made, FRAMES.format(kind=kind)).withColumnRenamed("id", id_column)


def save(frame_rows: DataFrame, path: str) -> DataFrame:
    """Writes the archives as files below `path` (any file system of pyarrow); (archive, records, bytes) of each.

    A file appears under its name only when it is complete; a task that runs again replaces it by the same bytes.
    """

    def wrote(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        rows = rows.sort_values("seq")
        system, base = fs.FileSystem.from_uri(path)
        system.create_dir(base, recursive=True)
        name = rows["archive"].iloc[0]
        temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary, compression=None) as out:
            for frame in rows["frame"]:
                out.write(bytes(frame))
        system.move(temporary, f"{base}/{name}")
        return pd.DataFrame({"archive": [name], "records": [len(rows) - 1], "bytes": [int(rows["length"].sum())]})

    return frame_rows.select("archive", "seq", "length", "frame").groupBy("archive").applyInPandas(wrote, "archive string, records long, bytes long")


def records_of(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    magic, size = struct.unpack("<II", archive[:8])
    if magic != MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary")
    d = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(archive[8 : 8 + size]))
    at = 8 + size
    while at < len(archive):
        o = d.decompressobj()
        yield o.decompress(archive[at:])
        at = len(archive) - len(o.unused_data)


def headers_and_block(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(archive, seq, record_id, url, html) of every record below `path`."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = content.as_py()
                rows = [headers_and_block(r) for r in records_of(view)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.rsplit("/", 1)[-1]] * len(rows), pa.string()),
                        pa.array(range(1, len(rows) + 1), pa.int64()),
                        pa.array([h["WARC-Record-ID"].strip("<>") for h, _ in rows], pa.string()),
                        pa.array([h["WARC-Target-URI"] for h, _ in rows], pa.string()),
                        pa.array([b.decode("utf-8", "replace") for _, b in rows], pa.string()),
                    ],
                    ["archive", "seq", "record_id", "url", "html"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("path", "content").mapInArrow(parsed, "archive string, seq long, record_id string, url string, html string")
