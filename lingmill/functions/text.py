"""Text cleaning as Column expressions: everything runs inside the JVM and is expressible in SQL."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"]+"
USER = r"@[A-Za-z0-9_]+"
XML_TAG = r"<[^<>]+>"
EXCLUDED = (
    r"(?i)^(?:[<>]?[:;=8][o*'-]?[\])(\[dp/\\:}{@|]|https?://\S*|\d+\.\d+|\d{1,3}(?:,\d{3})+|[^\p{L}\p{N}_\s]+|_+|\d{1,2}:\d{2}(?:[ap]m)?|\d\S*|\S|\(\d+\))$"
)


def mark_newlines(text: Column) -> Column:
    """Newlines with the white space around them become one token."""
    return F.regexp_replace(text, r"\s*\n\s*", " <NEWLINE> ")


def shrink_space(text: Column) -> Column:
    """Newlines marked, runs of white space single, five or more dots four, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(mark_newlines(text), r"\s\s+", " "), r"\.{5,}", "...."))


def words_of(text: Column) -> Column:
    """Parts between runs of white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def mask_non_ascii(text: Column, marker: str = "<UNICODE>") -> Column:
    """Words with a character outside printable ASCII become the marker."""
    return F.array_join(F.transform(words_of(text), lambda w: F.when(w.rlike(r"[^\x15-\x7e]"), F.lit(marker)).otherwise(w)), " ")


def normalise_space(text: Column) -> Column:
    """Words joined by single spaces (Spark's strings are valid UTF-8, so no word needs a marker)."""
    return F.array_join(words_of(text), " ")


def remove_hex_escapes(text: Column) -> Column:
    return F.regexp_replace(text, r"\\x[0-9a-fA-F]{1,4}", " ")


def remove_xml(text: Column) -> Column:
    return F.regexp_replace(text, XML_TAG, " ")


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def shorten_dots(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(".."), F.lit(".")), F.lit(".."), F.lit("."))


def replace_users(text: Column) -> Column:
    return F.regexp_replace(text, USER, "<USER>")


def replace_urls(text: Column) -> Column:
    """URLs and users become markers."""
    return F.regexp_replace(replace_users(text), URL, "<URL>")


ENTITIES = {k: v for k, v in {**html.entities.html5}.items() if k.endswith(";") and len(v) == 1 and k not in ("amp;", "lt;", "gt;", "quot;", "apos;")}


def decode_entities(text: Column) -> Column:
    """Numeric and common named HTML entities; &amp; becomes ` and ` where another named entity is present."""
    out = text
    for code, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("hellip", "..."), ("mdash", "—"), ("ndash", "–"), ("rsquo", "’"), ("lsquo", "‘"), ("eacute", "é"), ("uuml", "ü"), ("ouml", "ö"), ("auml", "ä"), ("copy", "©"), ("euro", "€")):
        out = F.replace(out, F.lit(f"&{code};"), F.lit(char))
    named = text.rlike(r"&(?!amp;)[A-Za-z]+;")
    out = F.when(named, F.replace(out, F.lit("&amp;"), F.lit(" and "))).otherwise(out)
    # numeric: pieces between entities are kept, each code is turned into its character
    parts = F.regexp_extract_all(out, F.lit(r"&#\d{1,7};|[^&]+|&"), F.lit(0))
    decoded = F.transform(parts, lambda p: F.when(p.rlike(r"^&#\d{1,7};$"), _character(F.regexp_extract(p, r"\d+", 0).cast("int"))).otherwise(p))
    return F.array_join(decoded, "")


def _character(code: Column) -> Column:
    """The character of a code point below 2^16, from its UTF-16 bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def retweet_parts(text: Column) -> Column:
    """(retweeted, comment): what follows `RT @user` or is before `via @user`, and the rest; retweeted is null otherwise."""
    rt = F.regexp_extract(text, r"(?is)^(.*?)\b(?:RT|retweet(?:ed)?)\b[\s:]*@\w+[\s:]*(.*)$", 2)
    before = F.regexp_extract(text, r"(?is)^(.*?)\b(?:RT|retweet(?:ed)?)\b[\s:]*@\w+[\s:]*(.*)$", 1)
    via = F.regexp_extract(text, r"(?is)^(.*?)\(?\bvia\b\s*@\w+\)?(.*)$", 1)
    after = F.regexp_extract(text, r"(?is)^(.*?)\(?\bvia\b\s*@\w+\)?(.*)$", 2)
    is_rt, is_via = text.rlike(r"(?i)\bRT\b[\s:]*@\w+|\bretweet(ed)?\b[\s:]*@\w+"), text.rlike(r"(?i)\bvia\b\s*@\w+")
    return F.struct(
        F.when(is_rt, F.trim(rt)).when(is_via, F.trim(via)).alias("retweeted"),
        F.when(is_rt, F.trim(before)).when(is_via, F.trim(after)).otherwise(text).alias("comment"),
    )


def is_excluded(token: Column) -> Column:
    """Emoticons, URLs, numbers, punctuation, times, single characters and what starts with a digit."""
    return token.rlike(EXCLUDED)


def normalise_sentence(text: Column) -> Column:
    """Markup, links and handles out, repeated letters at most three, plain quotes, ASCII only, clitics apart."""
    steps = [
        (r"<3+", " "), (r"[<>=-]+>|<[<=-]+", " "), (URL, " "), (r"\S+@\S+\.\S+", " "), (r"[#@]\w+", " "), (r"&[#\w]+;", " "), (XML_TAG, " "),
        (r"[:;=8][o*'-]?[)(\]\[dDpP/\\:}{@|]", " "), (r"(\p{L})\1{3,}", "$1$1$1"), (r"[‘’`]", "'"), (r"[“”]", '"'), (r"([!?.,])\1+", "$1"),
        (r"[^\x20-\x7e]", " "), (r"(?i)\b(\w+)(n't|'ll|'re|'ve|'s|'d|'m)\b", "$1 $2"), (r"\s+", " "),
    ]
    out = text
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def syllables(word: Column) -> Column:
    """Groups of vowels, without a silent final e, at least one."""
    w = F.regexp_replace(F.lower(word), r"(?:[^l]e|es|ed)$", "")
    return F.greatest(F.lit(1), F.regexp_count(w, F.lit(r"[aeiouyáéíóúàèùâêîôûäöü]+")))


def reading_grade(text: Column) -> Column:
    """Flesch-Kincaid grade, at most 20; null without words."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}']+"), F.lit(0))
    n = F.size(words)
    sentences = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[.!?]+(?:\s|$)")))
    total = F.aggregate(F.transform(words, syllables), F.lit(0), lambda a, x: a + x)
    return F.when(n > 0, F.least(F.lit(20.0), F.lit(0.39) * n / sentences + F.lit(11.8) * total / n - F.lit(15.59)))
