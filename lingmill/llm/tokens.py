"""Token counts under a unigram model, by dynamic programming shared along a trie.

The pieces are those of a public tokenizer's file in the tiktoken form (base64 piece and rank a line); its path is a
parameter, and the pieces stay as they are. Their probabilities are those of the corpus: texts are cut into pre-tokens by
PATTERN, all distinct pre-tokens of all texts are counted, and the pieces of their most likely splits are counted and made
probabilities (with `alpha` added to each count), `rounds` times; the first splits are those into the fewest pieces.

The distinct pre-tokens are put in a trie: they are sorted over all tasks, so that each walks its range depth first with
only the current path in memory. The best score and token count of every prefix are computed once for all pre-tokens that
share it, and a terminal keeps the count of its pre-token. The terminals' counts lie in the shared folder as sorted arrays of
hashes; workers map them and add up the counts of their texts' pre-tokens. Distinct pre-tokens are all that is shuffled;
broadcast is the vocabulary, whose size doesn't depend on the data.

Defined results: a null or empty text has no pre-tokens and no tokens; a null doc_id is returned as null; every row has
its own result, repeated ones too (and counts as often as it occurs); bytes that the vocabulary lacks count as one token each,
at a low score; of equally likely splits the one of fewest tokens counts, then the one whose last token is shorter; an
empty table gives an empty result. Only doc_id and text are read, so that other columns can have any name.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingmill.llm.arrays import Numbers, numbers
from lingmill.llm.common import new_path, removed, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r" ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+"
UNKNOWN = -40.0
ROUNDS = 2
ALPHA = 1.0
#: Pre-tokens that a task remembers; beyond it starts anew (results don't change).
REMEMBERED = 1 << 20
HELD = 1 << 18  # distinct pre-tokens that a task counts before it sends them
RANGE_ROWS = 1 << 16


def vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """piece -> log probability, all alike."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return dict.fromkeys(pieces, -math.log(max(len(pieces), 1)))


def _walk(tokens: Iterable[bytes], pieces: dict[bytes, float]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """(pre-token, least tokens by depth, start of the last token by depth) for distinct pre-tokens in sorted order.

    The lists are those of the current path: each shared prefix is scored once.
    """
    longest = max(map(len, pieces), default=1)
    get = pieces.get
    scores, counts, starts = [0.0], [0], [0]  # by depth, along the path of the last pre-token
    last = b""
    for token in tokens:
        size = len(token)
        most = min(size, len(last))
        if token[:most] == last[:most]:
            depth = most
        else:
            lo, hi = 0, most - 1  # the first difference lies in lo..hi
            while lo < hi:
                mid = (lo + hi) >> 1
                if token[lo : mid + 1] == last[lo : mid + 1]:
                    lo = mid + 1
                else:
                    hi = mid
            depth = lo
        del scores[depth + 1 :], counts[depth + 1 :], starts[depth + 1 :]
        for end in range(depth + 1, size + 1):
            best, fewest, begin = scores[end - 1] + get(token[end - 1 : end], UNKNOWN), counts[end - 1] + 1, end - 1
            for start in range(end - 2, max(-1, end - longest - 1), -1):
                p = get(token[start:end])
                if p is not None:
                    s = scores[start] + p
                    if s > best or (s == best and counts[start] + 1 < fewest):
                        best, fewest, begin = s, counts[start] + 1, start
            scores.append(best)
            counts.append(fewest)
            starts.append(begin)
        last = token
        yield token, counts, starts


def forward(tokens: Iterable[bytes], pieces: dict[bytes, float]) -> Iterator[tuple[bytes, int]]:
    """(pre-token, tokens) for distinct pre-tokens in sorted order."""
    for token, counts, _ in _walk(tokens, pieces):
        yield token, counts[len(token)]


def splits(tokens: Iterable[bytes], pieces: dict[bytes, float]) -> Iterator[tuple[bytes, list[bytes]]]:
    """(pre-token, its tokens from the last to the first)."""
    for token, _, starts in _walk(tokens, pieces):
        found, end = [], len(token)
        while end:
            found.append(token[starts[end] : end])
            end = starts[end]
        yield token, found


def pretokens(docs: DataFrame, pattern: str = PATTERN, text="text") -> DataFrame:
    """(pretoken, n) of all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, n = re.compile(pattern).findall, Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["pretoken", "n"])
            n.clear()
            return out

        for batch in batches:
            for x in batch.column(0):
                n.update(find(x.as_py() or ""))
                if len(n) > HELD:
                    yield sent()
        yield sent()

    return docs.select(F.col(text)).mapInArrow(counted, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def _sorted(rows: pa.Array) -> list[tuple[bytes, int]]:
    """(UTF-8, row) in the order of the trie."""
    return sorted((t.encode(), i) for i, t in enumerate(rows.to_pylist()))


def fit(known: DataFrame, pieces: dict[bytes, float], rounds: int = ROUNDS, alpha: float = ALPHA) -> dict[bytes, float]:
    """Log probabilities of the pieces, from counted pre-tokens."""
    for _ in range(rounds):
        shared = known.sparkSession.sparkContext.broadcast(pieces)

        def used(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                order, n = _sorted(batch.column(0)), batch.column(1).to_pylist()
                for (_, i), (_, found) in zip(order, splits((t for t, _ in order), shared.value)):
                    for piece in found:
                        total[piece] += n[i]
            inside = [(p, c) for p, c in total.items() if p in shared.value]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in inside], pa.binary()), pa.array([c for _, c in inside], pa.int64())], ["piece", "n"])

        # as many rows as the vocabulary has pieces, at most
        counts = {bytes(r["piece"]): r["n"] for r in known.mapInArrow(used, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        total = sum(counts.values()) + alpha * len(pieces)
        pieces = {p: math.log((counts.get(p, 0) + alpha) / total) for p in pieces}
        shared.unpersist()
    return pieces


def terminals(known: DataFrame, pieces: dict[bytes, float], count: int) -> Numbers:
    """The tokens of each of the counted pre-tokens."""
    shared = known.sparkSession.sparkContext.broadcast(pieces)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, found = _sorted(batch.column(0)), [0] * batch.num_rows
            for (_, i), (_, n) in zip(order, forward((t for t, _ in order), shared.value)):
                found[i] = n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["pretoken", "tokens"])

    return numbers(known.mapInArrow(scored, "pretoken string, tokens long"), "pretoken", F.col("tokens"), count)


def token_counts(docs: DataFrame, vocabulary_path: str = VOCABULARY, pattern: str = PATTERN, id_column="doc_id", text="text", rounds: int = ROUNDS, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, pretokens, tokens) for every row."""
    spark = docs.sparkSession
    path, ordered_path = new_path(spark, "pretokens"), new_path(spark, "pretokens")
    counted = written(pretokens(docs, pattern, text), "pretokens", path)
    count = counted.count()
    ranges = counted.repartitionByRange(max(1, -(-count // RANGE_ROWS)), "pretoken").sortWithinPartitions("pretoken")
    known = written(ranges, "pretokens", ordered_path)
    removed(spark, path)
    table = terminals(known, fit(known, vocabulary(vocabulary_path), rounds, alpha), count)
    removed(spark, ordered_path)
    shared = spark.sparkContext.broadcast(table)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminal, find, known = shared.value, re.compile(pattern).findall, {}
        for batch in batches:
            column = batch.column(1)
            pieces, tokens = [0] * len(column), [0] * len(column)
            done = 0
            while done < len(column):
                # as many rows at a time as have about a million characters
                rows, chars = [], 0
                while done + len(rows) < len(column) and chars < 1 << 20:
                    text = column[done + len(rows)].as_py() or ""
                    rows.append(find(text))
                    chars += len(text)
                if len(known) > REMEMBERED:
                    known = {}
                known.update(terminal.found(set().union(*rows).difference(known)))
                count = known.__getitem__
                for i, row in enumerate(rows, done):
                    pieces[i], tokens[i] = len(row), int(sum(map(count, row)))
                done += len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64())], [id_column, "pretokens", "tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text)).mapInArrow(summed, f"{id_column} {kind}, pretokens long, tokens long")
