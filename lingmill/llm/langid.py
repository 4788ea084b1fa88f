"""Language identification: multinomial naive Bayes over hashed character n-grams.

The texts are lower-cased, every run of other characters than letters counts as one space, and all n-grams of the
orders ORDERS are hashed into BUCKETS buckets. The model is fitted on a bounded sample of the labelled rows (about
`train_docs` per label, picked by a hash of doc_id; the bound is a parameter), its matrix of log probabilities
(BUCKETS x labels, float32) is broadcast, and whole texts are scored in numpy as a sparse matrix in CSR form: one
entry for each n-gram, summed by row. Scoring needs no shuffle.

Defined results: a null or empty text, or one without letters, has no label (`und`) and is rejected; nulls in other
columns change nothing; ties go to the label that sorts first; repeated rows are scored each; an empty table gives an
empty result, and with no labelled rows at all every text is `und` and rejected. A document is also rejected if its
mean score per n-gram lies more than `slack` nats plus `z` standard errors under what texts of its best label have.
Rows whose own `lang` differs from the identified one are kept. identify() returns columns of its own and never
reads others than the ones named; keep_identified() returns exactly the columns it is given, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingmill.llm.common import sifted, trim
from lingmill.llm.textvec import codepoints, lowered, mix, slices, word_mask

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    logp: np.ndarray  # BUCKETS x labels, float32
    prior: np.ndarray
    mean: np.ndarray  # of the score per n-gram in training texts of each label
    sd: np.ndarray
    slack: float = 1.5
    z: float = 8.0


def features(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashed n-grams of each order, where each row starts): entry i of any order ends at letter-or-space i.

    Every row is letters with single spaces between and around its words; an n-gram may not cross rows, its
    entry is then BUCKETS.
    """
    cp, starts = codepoints(lowered(column))
    mask = word_mask(cp)
    low = cp < 128
    mask &= ~(low & ((cp < 97) | (cp > 122)))  # digits and the underscore are no letters
    first = np.zeros(len(cp) + 1, bool)
    first[starts] = True
    prev = np.zeros(len(cp), bool)
    prev[1:] = mask[:-1]
    prev &= ~first[:-1]
    begin = mask & ~prev
    words = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(begin, out=words[1:])
    letters = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(mask, out=letters[1:])
    rows = np.arange(len(starts))
    # one space before each word, and one at the end of each row that has words
    has = np.diff(words[starts]) > 0
    ends = np.zeros(len(starts), np.int64)
    np.cumsum(has, out=ends[1:])
    out_starts = letters[starts] + words[starts] + ends[rows]
    total = int(out_starts[-1])
    seq = np.full(total, 32, np.uint64)
    at = np.flatnonzero(mask)
    row_of = np.repeat(rows[:-1], np.diff(letters[starts]))
    seq[np.arange(len(at)) + words[at + 1] + ends[row_of]] = cp[at]
    grams = []
    pos = np.arange(total) - np.repeat(out_starts[:-1], np.diff(out_starts))
    key = np.zeros(total, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = seq if n == 1 else np.concatenate([np.zeros(n - 1, np.uint64), seq[: 1 - n]])[:total]
        key = (key << np.uint64(21)) | shifted
        if n in ORDERS:
            bucket = (mix(key + np.uint64(n)) >> np.uint64(48)).astype(np.int32) % BUCKETS
            if n > 1:
                bucket[pos < n - 1] = BUCKETS
            grams.append(bucket)
    return grams, out_starts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums by row; rows without entries have 0."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=np.float64)
    return out


def score(column: pa.Array, model: Model, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood of each row under each label, n-grams of each row). table: model.logp with a last row of zeros."""
    grams, starts = features(column)
    total = table[grams[0]]
    for g in grams[1:]:
        total += table[g]
    lens = np.diff(starts)
    count = sum(np.maximum(lens - n + 1, 0) for n in ORDERS)
    return _sums(total, starts), count


def classify(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label numbers, -1 for none; posterior of the label; accepted) of each row, slice by slice."""
    n = len(column)
    label, confidence, accepted = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
    if not model.labels:
        return label, confidence, accepted
    table = np.vstack([model.logp, np.zeros((1, len(model.labels)), np.float32)])
    for at, part in slices(column):
        sums, count = score(part, model, table)
        post = sums + model.prior
        best = post.argmax(axis=1)
        top = post[np.arange(len(best)), best]
        some = count > 0
        mean = sums[np.arange(len(best)), best] / np.maximum(count, 1)
        floor = model.mean[best] - model.slack - model.z * model.sd[best] / np.sqrt(np.maximum(count, 1))
        end = at + len(part)
        label[at:end] = np.where(some, best, -1)
        confidence[at:end] = np.where(some, 1 / np.exp(post - top[:, None]).sum(axis=1), 0)
        accepted[at:end] = some & (mean >= floor)
    return label, confidence, accepted


def fit(docs: DataFrame, id_column="doc_id", text="text", lang="lang", train_docs=2000, alpha=0.1, slack=1.5, z=8.0) -> Model:
    """Fits on the labelled rows whose hash of doc_id is among about `train_docs` per label."""
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull() & (F.trim(lang) != "") & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0), np.zeros(0), slack, z)
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, int(min(1.0, train_docs / v) * (1 << 30)))])
    sample = known.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) <= share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    number = {k: i for i, k in enumerate(labels)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the counts, and for each label the rows by their number of n-grams: kept as plain sums
        counts = np.zeros((len(labels), BUCKETS + 1), np.int64)
        for batch in batches:
            code = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for at, part in slices(batch.column(1)):
                grams, starts = features(part)
                row = np.repeat(code[at : at + len(part)], np.diff(starts))
                for g in grams:
                    counts += np.bincount(row * (BUCKETS + 1) + g, minlength=counts.size).reshape(counts.shape)
        counts = counts[:, :BUCKETS]
        k, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(counts[k, b])], ["label", "bucket", "n"])

    rows = sample.mapInArrow(counted, "label long, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(labels), BUCKETS))
    counts[rows["label"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    smooth = counts + alpha
    logp = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    share_of = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    mean = (share_of * logp).sum(axis=1)
    sd = np.sqrt(np.maximum((share_of * logp**2).sum(axis=1) - mean**2, 1e-9))
    rows_by = np.array([sizes[k] for k in labels], float)
    return Model(labels, logp.T.astype(np.float32).copy(), np.log(rows_by / rows_by.sum()), mean, sd, slack, z)


def identify(docs: DataFrame, model: Model, id_column="doc_id", text="text") -> DataFrame:
    """(id, label, confidence, accepted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array([*model.labels, UNKNOWN], object)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            label, confidence, accepted = classify(batch.column(1), m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[label], pa.string()), pa.array(confidence), pa.array(accepted)], ["id", "label", "confidence", "accepted"]
            )
            trim()

    kind = docs.schema[id_column].dataType.simpleString()
    return (
        docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
        .mapInArrow(scored, f"id {kind}, label string, confidence double, accepted boolean")
        .withColumnRenamed("id", id_column)
    )


def keep_identified(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """The rows that language identification accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        return sifted(batches, lambda batch: classify(batch.column(at), m)[2])

    return docs.mapInArrow(kept, docs.schema)
