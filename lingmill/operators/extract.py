"""Feature extraction: messages to feature tables (group_id, feat, value, group_norm).

All extractors count a message once in a group (rows that repeat its id are dropped), drop null groups and empty
messages, and norm by the group's total before any minimum frequency. n-grams are made and counted in one pass: a
partial aggregate by task, one exchange on (group, feature), and the groups' totals from the stored aggregate. Where each
message is a group, nothing is exchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lingmill.functions import text as X
from lingmill.functions.tokenize import characters, feature_length, ngrams, tokenize
from lingmill.functions.transforms import TRANSFORMS
from lingmill.operators.kernel import stored


def distinct_messages(messages: DataFrame, group: str, message_id: str) -> DataFrame:
    """Messages with a group, each id once in a group.

    The ids alone are checked first: the texts are only exchanged if some id repeats.
    """
    known = messages.where(F.col(group).isNotNull())
    twice = known.groupBy(group, message_id).agg(F.count("*").alias("__n")).where("__n > 1")
    if twice.isEmpty():
        return known
    w = W.partitionBy(group, message_id).orderBy(*[c for c in messages.columns if c not in (group, message_id)])
    return known.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")


def count_features(exploded: DataFrame, min_freq: int = 1, transform: str = "identity", totals: DataFrame | None = None) -> DataFrame:
    """From rows (group_id, feat) to a feature table. totals: (group_id, total) where it isn't the number of rows."""
    counts = exploded.groupBy("group_id", "feat").agg(F.count("*").alias("value"))
    return normed(counts, min_freq, transform, totals)


def normed(counts: DataFrame, min_freq: int = 1, transform: str = "identity", totals: DataFrame | None = None) -> DataFrame:
    if totals is None:
        # the texts are cut once; the totals of few groups are known to be small, and are broadcast
        counts = stored(counts, "counts")
        totals = stored(counts.groupBy("group_id").agg(F.sum("value").alias("total")), "totals")
    kept = counts.where(F.col("value") >= min_freq) if min_freq > 1 else counts
    return kept.join(totals, "group_id").select("group_id", "feat", "value", TRANSFORMS[transform](F.col("value") / F.col("total")).cast("double").alias("group_norm"))


def clean(text: Column) -> Column:
    return X.shrink_space(X.mark_newlines(text))


def token_rows(messages: DataFrame, group: str, message_id: str, message: str, tokens: Column | None = None) -> DataFrame:
    """(group_id, tokens) of every message that counts."""
    rows = distinct_messages(messages, group, message_id).where(F.col(message).isNotNull())
    return rows.select(F.col(group).alias("group_id"), (tokenize(clean(F.col(message))) if tokens is None else tokens).alias("tokens"))


def add_ngrams(messages: DataFrame, n: int = 1, group="user_id", message_id="message_id", message="message", min_freq=1, transform="identity", tokens: Column | None = None) -> DataFrame:
    rows = token_rows(messages, group, message_id, message, tokens)
    if group == message_id:
        return _features_of_messages(rows.select("group_id", F.sort_array(ngrams(F.col("tokens"), n)).alias("g")), min_freq, transform)
    return count_features(rows.select("group_id", F.explode(ngrams(F.col("tokens"), n)).alias("feat")), min_freq, transform)


def _features_of_messages(rows: DataFrame, min_freq: int, transform: str) -> DataFrame:
    """The feature table of (group_id, g) with one row a group: sorted features are counted where they are, nothing is exchanged."""
    g, ends = F.col("g"), F.col("ends")
    total = F.size(g)
    last = F.filter(F.sequence(F.lit(0), total - 1), lambda i: (i == total - 1) | (F.get(g, i) != F.get(g, i + 1)))
    # a filter on the size would be pushed below and cut the texts again
    rows = rows.select("group_id", "g", F.when(total > 0, last).otherwise(F.array().cast("array<int>")).alias("ends"))
    runs = F.transform(ends, lambda e, k: F.struct(F.get(g, e).alias("feat"), (e - F.when(k > 0, F.get(ends, k - 1)).otherwise(-1)).cast("long").alias("value")))
    each = rows.select("group_id", total.alias("total"), F.explode(runs).alias("r")).select("group_id", "r.feat", "r.value", "total")
    kept = each.where(F.col("value") >= min_freq) if min_freq > 1 else each
    return kept.select("group_id", "feat", "value", TRANSFORMS[transform](F.col("value") / F.col("total")).cast("double").alias("group_norm"))


def add_ngrams_from_tokens(messages: DataFrame, n: int = 1, group="user_id", message_id="message_id", message="message", **kw) -> DataFrame:
    """From messages that hold JSON lists of tokens."""
    return add_ngrams(messages, n, group, message_id, message, tokens=F.from_json(F.col(message), "array<string>"), **kw)


def add_char_ngrams(messages: DataFrame, n: int = 1, group="user_id", message_id="message_id", message="message", **kw) -> DataFrame:
    """Runs of characters, joined by spaces (a space itself is nothing)."""
    return add_ngrams(messages, n, group, message_id, message, tokens=characters(F.lower(clean(F.col(message)))), **kw)


def meta_features(messages: DataFrame, n: int = 1, group="user_id", message_id="message_id", message="message", transform="identity", count_last_twice=True, tokens: Column | None = None) -> DataFrame:
    """Average n-gram length and n-grams a message, totals of n-grams and messages. count_last_twice: the length of a message's last n-gram counts twice."""
    grams = token_rows(messages, group, message_id, message, tokens).select("group_id", ngrams(F.col("tokens"), n).alias("g"))
    lengths = F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    last = F.when(F.size("g") > 0, F.length(F.element_at("g", -1))).otherwise(0) if count_last_twice else F.lit(0)
    by = grams.groupBy("group_id").agg(F.sum(lengths + last).alias("chars"), F.sum(F.size("g")).alias("grams"), F.count("*").alias("messages"))
    f = TRANSFORMS[transform]
    stack = f"stack(4, '_avg{n}gramLength', chars / grams, '_avg{n}gramsPerMsg', grams / messages, '_total{n}grams', cast(grams as double), '_totalMsgs', cast(messages as double)) AS (feat, value)"
    return by.where("grams > 0").select("group_id", F.expr(stack)).select("group_id", "feat", "value", f(F.col("value")).cast("double").alias("group_norm"))


def add_collocations(messages: DataFrame, collocations: list[str], group="user_id", message_id="message_id", message="message", sub_collocations=False, **kw) -> DataFrame:
    """Greedy longest matches of a set of collocations, single tokens elsewhere. The set is a parameter, sent with the plan."""
    first: dict[str, int] = {}
    known = set(collocations)
    for c in known:
        words = c.split(" ")
        first[words[0]] = max(first.get(words[0], 1), len(words))

    def cut(tokens: list[str]) -> list[str]:
        out, i = [], 0
        while i < len(tokens):
            size = next((k for k in range(min(first.get(tokens[i], 1), len(tokens) - i), 1, -1) if " ".join(tokens[i : i + k]) in known), 1)
            out.append(" ".join(tokens[i : i + size]))
            if sub_collocations and size > 1:
                out += [s for k in range(1, size) for j in range(i, i + size - k + 1) if (s := " ".join(tokens[j : j + k])) in known or k == 1]
            i += size
        return [x[:128] for x in out]

    @F.pandas_udf("array<string>")
    def collocated(column: pd.Series) -> pd.Series:
        return column.map(lambda t: cut(list(t)) if t is not None else [])

    rows = token_rows(messages, group, message_id, message).select("group_id", F.explode(collocated("tokens")).alias("feat"))
    return count_features(rows, **kw)


def add_topic_features(topic_messages: DataFrame, group="user_id", message_id="message_id", topics="topics", transform="identity") -> DataFrame:
    """Shares of topics among the topic tokens (array of struct with topic_id) of a group's messages."""
    rows = distinct_messages(topic_messages, group, message_id).select(F.col(group).alias("group_id"), F.explode(topics).alias("t"))
    return count_features(rows.select("group_id", F.col("t.topic_id").cast("string").alias("feat")), transform=transform)


def add_phrases(parses: DataFrame, group="user_id", message_id="message_id", parse="message", transform="identity") -> DataFrame:
    """All constituents of bracketed parses, tagged and plain; norms by the number of tagged phrases."""

    def phrases(text: str | None) -> list[str]:
        out, stack, token = [], [], ""
        for c in (text or "") + " ":
            if c in "() \n\t":
                if token and stack:
                    stack[-1].append(token)
                token = ""
                if c == "(":
                    stack.append([])
                elif c == ")" and stack:
                    node = stack.pop()
                    words = [w for x in node[1:] for w in (x if isinstance(x, list) else [x])]
                    if node and words:
                        out += [f"{node[0]}: {' '.join(words)}"[:255], " ".join(words)[:255]]
                    if stack:
                        stack[-1].append(words)
            else:
                token += c
        return out

    @F.pandas_udf("array<string>")
    def constituents(column: pd.Series) -> pd.Series:
        return column.map(phrases)

    rows = distinct_messages(parses, group, message_id).select(F.col(group).alias("group_id"), F.explode(constituents(parse)).alias("feat"))
    tagged = rows.where(F.col("feat").contains(": ")).groupBy("group_id").agg(F.count("*").alias("total"))
    return count_features(rows, transform=transform, totals=tagged)


def add_names(messages: DataFrame, first_names: DataFrame, last_names: DataFrame, language_words: DataFrame, group="user_id", message_id="message_id", message="message") -> DataFrame:
    """2- to 4-grams from a first name to a last name, unless all of their words are words of the language; each list has a column `term`. Norms by the number of 2-grams."""
    rows = stored(token_rows(messages, group, message_id, message), "tokens")
    # most grams can't be a name by the length of their first and last word: these aren't made
    lengths = lambda t: [r[0] for r in t.select(F.length(F.lower("term")).alias("k")).where("k IS NOT NULL").distinct().collect()]
    firsts, lasts = lengths(first_names), lengths(last_names)
    grams = None
    for n in (2, 3, 4):
        keep = feature_length(n)
        begins = F.filter(F.sequence(F.lit(0), F.size("tokens") - n), lambda i: F.least(F.length(F.substring_index(F.get("tokens", i), " ", 1)), F.lit(keep)).isin(firsts))
        runs = F.transform(begins, lambda i: F.substring(F.concat_ws(" ", *[F.get("tokens", i + k) for k in range(n)]), 1, keep))
        named = F.filter(runs, lambda g: F.length(F.substring_index(g, " ", -1)).isin(lasts))
        one = rows.where(F.size("tokens") >= n).select("group_id", F.explode(named).alias("feat"))
        grams = one if grams is None else grams.unionByName(one)
    words = F.split("feat", " ")
    named = (
        grams.withColumn("first", F.element_at(words, 1))
        .withColumn("last", F.element_at(words, -1))
        .join(first_names.select(F.lower("term").alias("first")).distinct(), "first", "left_semi")
        .join(last_names.select(F.lower("term").alias("last")).distinct(), "last", "left_semi")
    )
    common = language_words.select(F.lower("term").alias("first")).distinct().withColumn("common_first", F.lit(True))
    common_last = common.withColumnsRenamed({"first": "last", "common_first": "common_last"})
    named = named.join(common, "first", "left").join(common_last, "last", "left").where("NOT (coalesce(common_first, false) AND coalesce(common_last, false))")
    totals = rows.groupBy("group_id").agg(F.sum(F.greatest(F.size("tokens") - 1, F.lit(0))).alias("total"))
    return count_features(named.select("group_id", "feat"), totals=totals)


def add_embeddings(vectors: DataFrame, group="user_id", vector="embedding", aggregate="avg", suffix="me") -> DataFrame:
    """Message vectors summed up by group, one feature a dimension."""
    agg = {"avg": F.avg, "min": F.min, "max": F.max, "median": F.median}[aggregate]
    rows = vectors.where(F.col(group).isNotNull()).select(F.col(group).alias("group_id"), F.posexplode(vector).alias("dim", "x"))
    return rows.groupBy("group_id", "dim").agg(agg(F.col("x").cast("double")).alias("value")).select("group_id", F.concat(F.col("dim").cast("string"), F.lit(suffix)).alias("feat"), "value", F.col("value").alias("group_norm"))


def embed_messages(messages: DataFrame, encode: Callable[[list[str]], list[list[float]]], message_id="message_id", message="message") -> DataFrame:
    """(message_id, embedding) by a model that the caller supplies: a function from a batch of texts to vectors, loaded in the workers."""
    kind = messages.schema[message_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({message_id: pdf[message_id], "embedding": [list(map(float, v)) for v in encode(pdf[message].fillna("").tolist())]})

    return messages.select(message_id, message).mapInPandas(run, f"{message_id} {kind}, embedding array<double>")


def add_readability(messages: DataFrame, group="user_id", message_id="message_id", message="message", remove_xml=True, remove_urls=True) -> DataFrame:
    """The mean reading grade of a group's messages."""
    text = F.col(message)
    if remove_xml:
        text = X.remove_xml(text)
    if remove_urls:
        text = X.remove_urls(text)
    rows = distinct_messages(messages, group, message_id).select(F.col(group).alias("group_id"), X.reading_grade(X.shorten_dots(text)).alias("grade"))
    return rows.where("grade IS NOT NULL").groupBy("group_id").agg(F.avg("grade").alias("value")).select("group_id", F.lit("m_fk_score").alias("feat"), "value", F.col("value").alias("group_norm"))


def add_pos(tagged: DataFrame, group="user_id", message_id="message_id", message="message", keep_words=False, transform="identity") -> DataFrame:
    """Tag frequencies of messages of word/TAG tokens, or the tokens themselves as 1-grams."""
    tokens = F.filter(F.split(F.col(message), r"\s+"), lambda t: t.contains("/"))
    feat = tokens if keep_words else F.transform(tokens, lambda t: F.element_at(F.split(t, "/"), -1))
    rows = distinct_messages(tagged, group, message_id).select(F.col(group).alias("group_id"), F.explode(feat).alias("feat"))
    return count_features(rows, transform=transform)


def add_outcomes_as_features(outcomes: DataFrame, group: str, columns: list[str], transform="identity") -> DataFrame:
    """Outcome columns unpivoted; nulls have no row."""
    long = outcomes.where(F.col(group).isNotNull()).select(F.col(group).alias("group_id"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["group_id"], columns, "feat", "value")
    return long.where("value IS NOT NULL").select("group_id", "feat", "value", TRANSFORMS[transform](F.col("value")).cast("double").alias("group_norm"))


def add_timex(offsets: DataFrame, group="user_id", days="days", tag="tag") -> DataFrame:
    """From temporal expressions (days from the message's date, tag): means and spread of the offsets, shares of tags."""
    d = F.col(days)
    by = offsets.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_id")).agg(
        F.avg(d).alias("meanOffset"), F.avg(F.abs(d)).alias("abs_meanOffset"), F.avg(F.log(F.abs(d) + 1)).alias("log_meanOffset"),
        F.avg(F.when(d > 0, F.log(d + 1)).otherwise(0.0)).alias("pos_log_meanOffset"), F.avg(F.when(d < 0, F.log(-d + 1)).otherwise(0.0)).alias("neg_log_meanOffset"),
        F.avg(F.when(F.abs(d) < 0.000694, 1.0).otherwise(0.0)).alias("offset_is_zero"), F.stddev_pop(d).alias("stdOffset"), F.count("*").cast("double").alias("numTimexes"),
    )
    wide = by.unpivot(["group_id"], [c for c in by.columns if c != "group_id"], "feat", "value").where("value IS NOT NULL").select("group_id", "feat", "value", F.col("value").alias("group_norm"))
    tags = count_features(offsets.where(F.col(group).isNotNull()).select(F.col(group).alias("group_id"), F.concat(F.lit("ttag:"), F.col(tag)).alias("feat")))
    return wide.unionByName(tags.withColumn("value", F.col("value").cast("double")))


def add_ner(entities: DataFrame, group="user_id", term="term", entity="ner", by_collocation=False) -> DataFrame:
    """From rows of terms with their entity type (O or null for none): entity types, collocations and both, normed by terms or by entities."""
    known = entities.where(F.col(group).isNotNull()).withColumn("group_id", F.col(group))
    named = known.where(F.col(entity).isNotNull() & (F.col(entity) != "O"))
    feats = named.select("group_id", F.explode(F.array(F.col(entity), F.lower(term), F.concat(F.col(entity), F.lit(":"), F.lower(term)))).alias("feat"))
    totals = (named if by_collocation else known).groupBy("group_id").agg(F.count("*").alias("total"))
    return count_features(feats, totals=totals)


def concept_probabilities(hypernyms: dict[str, list[str]], word_senses: dict[str, list[str]]) -> list[tuple[str, str, float]]:
    """(word, concept, share): a word's count is split equally over its senses, and at every step equally over the parents, up a given graph."""
    out = []
    for word, senses in word_senses.items():
        share: dict[str, float] = {}
        todo = [(s, 1 / len(senses)) for s in senses]
        while todo:
            node, p = todo.pop()
            share[node] = share.get(node, 0) + p
            parents = hypernyms.get(node, [])
            todo += [(x, p / len(parents)) for x in parents]
        out += [(word, c, p) for c, p in sorted(share.items())]
    return out


def add_concepts(word_table: DataFrame, concepts: DataFrame) -> DataFrame:
    """From a 1-gram table and (word, concept, share): concept features, normed by the words that have concepts."""
    known = word_table.join(concepts.select(F.col("word").alias("feat")).distinct(), "feat", "left_semi")
    totals = known.groupBy("group_id").agg(F.sum("value").alias("total"))
    by = word_table.join(concepts, F.col("feat") == F.col("word")).groupBy("group_id", F.col("concept").alias("feat")).agg(F.sum(F.col("value") * F.col("share")).alias("value"))
    return by.join(totals, "group_id").select("group_id", "feat", "value", (F.col("value") / F.col("total")).alias("group_norm"))


__all__ = [n for n in dir() if n.startswith("add_")] + ["feature_length"]
