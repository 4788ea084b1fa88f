"""URL filter: host names are segmented into words, and naive Bayes scores the words of host and path.

Host labels without separators ("cheappills") are split by unigram Viterbi: the most likely sequence of words, where a
word's probability is its share in the pages' visible text and in the separated tokens of their URLs, and an unknown
string of length l has that of a word never seen, falling tenfold with each character. A host label without separators
says nothing of words, however many pages it has: it isn't counted, nor where its own pages show it. All words
of all pages are counted and kept.

The filter is a multinomial naive Bayes model of two classes over host words (h:) and path tokens (p:, numbers as #).
Its training labels come from `seeds`, terms of unwanted hosts (a parameter): a URL is unwanted if a separated token of
its host is a seed, or a word that a token is split into. The model is fitted on all pages, keeps every token, and generalises to hosts that share
words but have other terms. Tokens that it doesn't know say nothing.

Storage: words and weights lie in the shared folder as sorted arrays of 128-bit hashes and a number each, in shards by the
hash. Workers map them and look up the parts of the host names and the tokens of a batch at once, so that nothing of the
size of the vocabulary is broadcast or reaches the driver.

Defined results: a null, empty or hostless URL has a null host and score and isn't blocked; nulls elsewhere change
nothing; scores of equal hosts and paths are equal; repeated rows are scored each; an empty table gives an empty result;
with no unwanted or no other URLs nothing is blocked; a run of over 63 letters, which no host label can have, is one word. Of ties the split with fewer words is taken, then the one whose
last word is longer. Only the named columns are read, so that others can have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingmill.llm.arrays import Numbers, numbers
from lingmill.llm.common import written

SEEDS = ("spam", "casino", "pills", "bets", "ads", "porn", "xxx", "viagra", "gambling", "escort", "warez")
LONGEST = 63  # characters of a host label (RFC 1035): no word in one is longer
HELD = 1 << 18  # distinct words or tokens that a task counts before it sends them
ASKED = 1 << 17  # strings that are looked up at once
IGNORED = {"www", "m", "blog"}
_PARTS = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::\d*)?([^?#]*)", re.I)
_TOKENS = re.compile(r"[^\W\d_]+|\d+")
_SHOWN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.I | re.S)


def parts(url: str | None) -> tuple[str, str] | None:
    """(host, path) in lower case, or None."""
    m = _PARTS.match((url or "").strip())
    host = m and m[1].lower().strip(".")
    return (host, m[2].lower()) if host else None


def label_tokens(host: str) -> list[list[str]]:
    """Of each label but the last, without common prefixes, the letters between separators; numbers are left out."""
    labels = host.split(".")
    labels = labels[:-1] if len(labels) > 1 else labels
    return [[t for t in _TOKENS.findall(label) if not t.isdigit()] for label in labels if label not in IGNORED]


def host_tokens(host: str) -> list[str]:
    return [t for label in label_tokens(host) for t in label]


def path_tokens(path: str) -> list[str]:
    return ["#" if t.isdigit() else t for t in _TOKENS.findall(path)]


def segment(name: str, logp: dict[str, float], unknown: float) -> list[str]:
    """The most likely words of a name. unknown: the log probability of an unseen string before its length counts."""
    best = [(0.0, 0, 0)]  # (score, -words, start of the last word)
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            word = name[start:end]
            p = logp.get(word)
            if p is None:
                p = unknown - math.log(10) * len(word)
            options.append((best[start][0] + p, best[start][1] - 1, start))
        top = max(options, key=lambda o: (round(o[0], 9), o[1], -o[2]))
        best.append(top)
    words, end = [], len(name)
    while end:
        start = best[end][2]
        words.append(name[start:end])
        end = start
    return words[::-1]


def word_model(pages: DataFrame, url="url", html="html") -> tuple[Numbers, float]:
    """(log probability of each word, that of an unseen one), from the visible text and URL tokens of all pages."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
            n.clear()
            return out

        for batch in batches:
            for u, h in zip(batch.column(0), batch.column(1)):
                found, whole = parts(u.as_py()), set()
                if found:
                    labels = label_tokens(found[0])
                    whole = {label[0] for label in labels if len(label) == 1}
                    n.update(t for label in labels if len(label) > 1 for t in label)
                    n.update(t for t in path_tokens(found[1]) if t != "#")
                shown = h.as_py()
                if shown:
                    n.update(t for t in _TOKENS.findall(_SHOWN.sub(" ", shown).lower()) if not t.isdigit() and t not in whole)
                if len(n) > HELD:
                    yield sent()
        yield sent()

    partial = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(counted, "word string, n long")
    summed = written(partial.groupBy("word").agg(F.sum("n").alias("n")), "words")
    size = summed.agg(F.count("*").alias("words"), F.sum("n").alias("n")).first()
    total = max(size["n"] or 0, 1)
    return numbers(summed, "word", F.log(F.col("n") / total), size["words"]), -math.log(total)


@dataclass
class Model:
    words: Numbers
    unknown: float
    weights: Numbers | None  # log odds of each token
    prior: float | None  # None: nothing is ever blocked
    seeds: frozenset[str]


class Segmenter:
    """Words of host names, remembered by name within a task."""

    def __init__(self, words: Numbers, unknown: float):
        self.words, self.unknown, self.known = words, unknown, {}

    def learn(self, hosts: Iterable[str]) -> None:
        """Splits hosts of a batch that aren't known yet; their parts are looked up together."""
        if len(self.known) > 1 << 18:
            self.known.clear()
        pending, asked = [], set()
        for host in {*hosts} - self.known.keys():
            names = host_tokens(host)
            pending.append((host, names))
            asked.update(t[i:j] for t in names if len(t) <= LONGEST for i in range(len(t)) for j in range(i + 1, min(i + LONGEST, len(t)) + 1))
            if len(asked) > ASKED:
                self._split(pending, asked)
                pending, asked = [], set()
        self._split(pending, asked)

    def _split(self, pending: list[tuple[str, list[str]]], asked: set[str]) -> None:
        logp = self.words.found(asked)
        self.known.update((host, [w for t in names for w in (segment(t, logp, self.unknown) if len(t) <= LONGEST else [t])]) for host, names in pending)

    def __call__(self, host: str) -> list[str]:
        return self.known[host]


def tokens(host_words: list[str], path: str) -> list[str]:
    return [f"h:{w}" for w in host_words] + [f"p:{t}" for t in path_tokens(path)]


def fit(pages: DataFrame, url="url", html="html", seeds=SEEDS, alpha=1.0) -> Model:
    words, unknown = word_model(pages, url, html)
    spark = pages.sparkSession
    shared, wanted = spark.sparkContext.broadcast((words, unknown)), frozenset(seeds)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, n = Segmenter(*shared.value), Counter()

        def sent() -> pa.RecordBatch:
            keys, counts = list(n), list(n.values())
            n.clear()
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.int32()), pa.array(counts, pa.int64())], ["token", "bad", "n"])

        for batch in batches:
            some = [found for u in batch.column(0) if (found := parts(u.as_py()))]
            cut.learn(host for host, _ in some)
            for host, path in some:
                words = cut(host)
                bad = int(not (wanted.isdisjoint(host_tokens(host)) and wanted.isdisjoint(words)))
                n[("", bad)] += 1
                n.update((t, bad) for t in tokens(words, path))
                if len(n) > HELD:
                    yield sent()
        yield sent()

    partial = pages.select(F.col(url).alias("url")).mapInArrow(counted, "token string, bad int, n long")
    by = partial.groupBy("token").agg(*[F.coalesce(F.sum(F.when(F.col("bad") == b, F.col("n"))), F.lit(0)).alias(name) for b, name in ((0, "good"), (1, "bad"))])
    summed = written(by, "tokens")
    first = summed.where("token = ''").first()
    rest = summed.where("token <> ''")
    total = rest.agg(F.count("*").alias("tokens"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not first or not first["good"] or not first["bad"]:
        return Model(words, unknown, None, None, wanted)
    good, bad = ((total[c] or 0) + alpha * (total["tokens"] + 1) for c in ("good", "bad"))
    odds = F.log((F.col("bad") + alpha) / bad) - F.log((F.col("good") + alpha) / good)
    weights = numbers(rest, "token", odds, total["tokens"])
    return Model(words, unknown, weights, math.log(first["bad"] / first["good"]), wanted)


def filtered(pages: DataFrame, model: Model, id_column="page_id", url="url") -> DataFrame:
    """(page_id, url, host, host_words, score, blocked) for every row; score: the log odds of being unwanted."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cut = Segmenter(m.words, m.unknown)
        for batch in batches:
            hosts, split, scores, blocked = [], [], [], []
            rows = [parts(u.as_py()) for u in batch.column(1)]
            cut.learn(found[0] for found in rows if found)
            weights = m.weights.found({t for found in rows if found for t in tokens(cut(found[0]), found[1])}) if m.weights else {}
            for found in rows:
                hosts.append(found and found[0])
                words = cut(found[0]) if found else None
                split.append(words and " ".join(words))
                score = sum((weights.get(t, 0.0) for t in tokens(words, found[1])), m.prior) if found and m.prior is not None else None
                scores.append(score)
                blocked.append(score is not None and score > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(split, pa.string()), pa.array(scores, pa.float64()), pa.array(blocked, pa.bool_())],
                ["id", "url", "host", "host_words", "score", "blocked"],
            )

    kind = pages.schema[id_column].dataType.simpleString()
    rows = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url")).mapInArrow(scored, f"id {kind}, url string, host string, host_words string, score double, blocked boolean")
    return rows.withColumnRenamed("id", id_column)
