"""Message-level operators: messages to messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lingmill.functions import text as X
from lingmill.functions.tokenize import TOKEN, tokenize

SPAM_WORDS = ["giveaway", "sweepstakes", "coupon", "discount", "promo", "subscribe", "webcam", "viagra", "casino", "jackpot"]


def tokenized(messages: DataFrame, message="message", as_json: bool = False) -> DataFrame:
    tokens = tokenize(F.col(message))
    return messages.withColumn(message, F.to_json(tokens) if as_json else tokens)


def sentences(text: Column, split_on_commas: bool = False) -> Column:
    """Sentences by closing punctuation before white space and a capital or a quote; a newline ends one too."""
    marks = r"[.!?,]" if split_on_commas else r"[.!?]"
    cut = F.regexp_replace(F.regexp_replace(text, r"\s*\n\s*", ". "), rf"({marks}+[\"')\]]*)\s+", "$1\n")
    return F.filter(F.transform(F.split(cut, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_tokenized(messages: DataFrame, message_id="message_id", message="message", per_row: bool = False, split_on_commas: bool = False, normalise: bool = False) -> DataFrame:
    """A list of sentences for each message, or one row a sentence with ids <id>_00, <id>_01, ..."""
    text = X.normalise_sentence(F.col(message)) if normalise else F.col(message)
    found = sentences(text, split_on_commas)
    if not per_row:
        return messages.withColumn(message, found)
    rows = messages.select("*", F.posexplode(found).alias("__n", "__sentence"))
    return rows.withColumn(message_id, F.concat_ws("_", F.col(message_id), F.when(F.col("__n") < 100, F.lpad(F.col("__n").cast("string"), 2, "0")).otherwise(F.col("__n").cast("string")))).withColumn(message, F.col("__sentence")).drop("__n", "__sentence")


def annotated(messages: DataFrame, tool: Callable[[list[str]], list[str]], message="message") -> DataFrame:
    """Messages replaced by what an external tagger, parser or segmenter returns for a batch of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{message: tool(pdf[message].fillna("").tolist())})

    return messages.mapInPandas(run, messages.schema)


def not_yet_parsed(messages: DataFrame, parsed: DataFrame, message_id="message_id") -> DataFrame:
    """Messages whose id the output lacks: parsing can go on where it stopped."""
    return messages.join(parsed.select(message_id).distinct(), message_id, "left_anti")


def topic_messages(lines: DataFrame, line="value") -> DataFrame:
    """From lines of a Gibbs sampler's state (doc source index term_id term topic_id; # starts a comment): tokens with topics by message."""
    f = F.split(F.trim(line), r"\s+")
    rows = lines.where(~F.col(line).startswith("#") & (F.size(f) == 6))
    token = F.struct(F.element_at(f, 3).cast("int").alias("index"), F.element_at(f, 1).cast("long").alias("doc"), F.element_at(f, 4).cast("int").alias("term_id"), F.element_at(f, 5).alias("term"), F.element_at(f, 6).cast("int").alias("topic_id"))
    return rows.groupBy(F.element_at(f, 2).alias("message_id")).agg(F.array_sort(F.collect_list(token)).alias("topics"))


def deduplicated(messages: DataFrame, group="user_id", message_id="message_id", message="message", anonymize: bool = False) -> DataFrame:
    """Of a group's messages that begin alike the first by id; blank ones and retweets go.

    Alike: the same first five words without users, tags and excluded tokens, if there are six or more; else all.
    """
    text = F.col(message)
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^[#@]") & ~X.is_excluded(t))
    key = F.array_join(F.when(F.size(words) >= 6, F.slice(words, 1, 5)).otherwise(words), " ")
    kept = messages.where(text.isNotNull() & (F.trim(text) != "") & F.col(group).isNotNull() & X.retweet_parts(text)["retweeted"].isNull())
    order = W.partitionBy(group, "__key").orderBy(message_id)
    out = kept.withColumn("__key", key).withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__key", "__rank")
    return anonymized(out, message) if anonymize else out


def anonymized(messages: DataFrame, message="message") -> DataFrame:
    """Users, then URLs, become markers; blank messages go."""
    out = messages.withColumn(message, X.replace_urls(F.col(message)))
    return out.where(F.trim(message) != "")


def without_spam(messages: DataFrame, group="user_id", message="message", words: list[str] = SPAM_WORDS, threshold: float = 0.2) -> DataFrame:
    """All messages, with is_spam, of groups whose share of messages with one of the words is below the threshold.

    The shares are one aggregate by group; only those are joined, not the texts exchanged by a window.
    """
    spam = F.coalesce(F.lit(False), F.lit(False))
    for w in words:
        spam = spam | F.col(message).contains(w)
    marked = messages.withColumn("is_spam", F.coalesce(spam, F.lit(False)).cast("int"))
    bad = marked.groupBy(group).agg(F.avg("is_spam").alias("__share")).where(F.col("__share") >= threshold).select(group)
    return marked.join(bad, group, "left_anti")


def in_languages(messages: DataFrame, identify: Callable[[list[str]], list[tuple[str, float]]], languages: list[str], message="message", confidence: float = 0.8, light_english: bool = False, lower: bool = False) -> DataFrame:
    """Messages with their language, of the wanted ones; `identify` gives (language, confidence) for a batch of texts.

    light_english: Spanish below .95 and English above .60 count as English.
    """
    schema = StructType(list(messages.schema.fields)).add("language", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[message].fillna("").tolist()
            found = identify(texts)
            langs = [
                "en" if light_english and ((l == "es" and p < 0.95) or (l == "en" and p > 0.60)) else (l if p > confidence else None) for l, p in found
            ]
            out = pdf.assign(language=langs)
            if lower:
                out[message] = out[message].str.lower()
            yield out[out["language"].isin(languages)]

    return messages.mapInPandas(run, schema)


def words_by_group(messages: DataFrame, group="user_id", message_id="message_id", num_words="num_words") -> DataFrame:
    """Words of each group; a message counts once in it."""
    once = messages.where(F.col(group).isNotNull()).groupBy(group, message_id).agg(F.max(num_words).alias("n"))
    return once.groupBy(F.col(group).alias("group_id")).agg(F.sum("n").alias("num_words"))


def fetch(messages: DataFrame, columns: list[str], where: str | None = None) -> DataFrame:
    return (messages.where(where) if where else messages).select(*columns)
