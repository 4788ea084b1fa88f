"""Token lists made by hand from the tokenizer's contract; none of them comes from the pattern."""

import pytest
from pyspark.sql import functions as F

from lingmill.functions.tokenize import tokenize

CASES = [
    # phone numbers
    ("call 555-123-4567 now", ["call", "555-123-4567", "now"]),
    ("+1 (555) 123-4567", ["+1 (555) 123-4567"]),
    # emoticons keep their case, and so does what has one inside
    (":) :-D <3 =P (: -_- o_O d8", [":)", ":-D", "<3", "=P", "(:", "-_-", "o_O", "d8"]),
    ("8pm COOOOL Cool", ["8p", "m", "COOOOL", "cool"]),
    # web addresses, without paths
    ("http://foo.com/bar bit.ly HTTP://Foo.org", ["http://foo.com", "/", "bar", "bit.ly", "HTTP://Foo.org"]),
    ("foo.comical a.b.co.uk", ["foo.com", "ical", "a.b.co", ".", "uk"]),
    # a scheme alone
    ("https://x", ["https://", "x"]),
    # commands
    ("see [cmd_1]", ["see", "[cmd_1]"]),
    # the end of a GET request
    ("at /get?a=1;b=2", ["at", "/get?a=1;b=2"]),
    # tags and what ends like one
    ("<a href=x>link</a> <br /> <NEWLINE> foo> a<b c", ["<a href=x>", "link", "</a>", "<br />", "<newline>", "foo>", "a", "<b", "c"]),
    # users and hashtags
    ("@Some_User #Tag #a-b_c #x", ["@some_user", "#tag", "#a-b_c", "#", "x"]),
    # named entities
    ("[PERSON:Bob] left", ["[person:bob]", "left"]),
    # words, numbers, dots, the rest
    ("don't b2b-c3 3.5 1/2 ab_c", ["don't", "b2b-c3", "3.5", "1/2", "ab_c"]),
    ("wait... . . end", ["wait", "... . .", "end"]),
    ("Hello, World! a - b", ["hello", ",", "world", "!", "a", "-", "b"]),
    ("é, ñandú 日本語", ["é", ",", "ñandú", "日本語"]),
    ("", []),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_tokens(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t")).alias("x")).first()["x"] == expected


def test_very_long_runs(spark):
    text = "." * 50_000 + " " + "a" * 50_000 + " " + "<" * 200
    tokens = spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t")).alias("x")).first()["x"]
    assert tokens[0] == "." * 50_000 and tokens[1] == "a" * 50_000


def test_the_quick_pattern_cuts_as_the_whole_one(spark):
    """Every text of a few pieces that the quick alternatives could mistake."""
    from itertools import product

    from lingmill.functions.tokenize import FAST, TOKEN

    pieces = ["ooo", "Ooops", "word", "d", "po", "é", "8", ":", ";", ".", ",", "!", ">", "<", "-", "'", "@", "com", " ", "  ", "\n", "\xa0"]
    df = spark.createDataFrame([("".join(p),) for p in product(pieces, repeat=3)], "t string")
    cut = lambda pattern, group: F.regexp_extract_all("t", F.lit(pattern), F.lit(group))
    assert df.where(cut(FAST, 1) != cut(TOKEN, 0)).count() == 0


def test_texts_are_cut_once(spark):
    """The totals of groups, and all that uses the table again, read what was counted, not the texts."""
    from lingmill.operators.extract import add_ngrams

    m = spark.createDataFrame([("g", 1, "a b a"), ("h", 2, "b")], "user_id string, message_id long, message string")
    plan = add_ngrams(m)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_messages_as_groups_count_without_exchange(spark):
    from lingmill.operators.extract import add_ngrams

    m = spark.createDataFrame([(1, "b a b c b"), (1, "b a b c b"), (2, ""), (3, None), (None, "x"), (4, "a")], "message_id long, message string")
    for n in (1, 2):
        ft = add_ngrams(m, n, "message_id")
        want = add_ngrams(m.withColumn("user_id", F.col("message_id")), n)
        rows = lambda t: sorted(map(tuple, t.select("group_id", "feat", "value", "group_norm").collect()))
        assert rows(ft) == rows(want) and rows(ft)
        assert ft.schema["value"].dataType == want.schema["value"].dataType
        assert "Exchange" not in add_ngrams(m.dropDuplicates(["message_id"]).where("message_id > 1").localCheckpoint(), n, "message_id")._jdf.queryExecution().executedPlan().toString()
