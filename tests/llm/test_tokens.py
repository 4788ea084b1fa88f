import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lingmill.llm import tokens

PIECES = {b"a": -3.0, b"b": -3.5, b"ab": -4.0, b"abc": -5.0, b"c": -3.0, b"bc": -3.9, b" a": -3.2, b" ": -2.0, "é".encode(): -6.0, b"cab": -4.5}


def best(word, pieces):
    """(score, fewest tokens) over all splits, by enumeration."""
    if not word:
        return 0.0, 0
    options = []
    for i in range(1, len(word) + 1):
        p = pieces.get(word[:i], tokens.UNKNOWN if i == 1 else None)
        if p is not None:
            s, n = best(word[i:], pieces)
            options.append((round(s + p, 9), -(n + 1)))
    s, n = max(options)
    return s, -n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc é", min_size=1, max_size=9), max_size=30))
def test_trie_against_enumeration(words):
    coded = sorted(w.encode() for w in words)
    assert dict(tokens.forward(coded, PIECES)) == {w: best(w, PIECES)[1] for w in coded}


def fitted(texts, pieces, rounds, alpha):
    """Probabilities of the pieces by enumeration of splits, over all texts at once."""
    n = Counter(w.encode() for t in texts for w in re.findall(tokens.PATTERN, t or ""))
    for _ in range(rounds):
        used = Counter()
        for w, found in tokens.splits(sorted(n), pieces):
            assert b"".join(reversed(found)) == w
            for x in found:
                used[x] += n[w]
        used = {x: c for x, c in used.items() if x in pieces}
        total = sum(used.values()) + alpha * len(pieces)
        pieces = {x: math.log((used.get(x, 0) + alpha) / total) for x in pieces}
    return pieces


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abc é", min_size=1, max_size=8), max_size=20))
def test_splits_have_the_best_score(words):
    for w, found in tokens.splits(sorted(x.encode() for x in words), PIECES):
        assert b"".join(reversed(found)) == w
        assert sum(PIECES.get(x, tokens.UNKNOWN) for x in found) == pytest.approx(best(w, PIECES)[0])


def test_documents_against_single_words(spark):
    texts = ["The quick brown fox", "Über Äpfel, naïve!! 12345 __x", "", None, "same same same", "tab\t\n  new", "日本語 text", "a" * 3000 + " end", "same same same"]
    pieces = fitted([*texts, "The"], tokens.vocabulary(), 2, 1.0)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "The", 1)], "doc_id long, text string, tokens int").repartition(2)
    got = {r["doc_id"]: (r["pretokens"], r["tokens"]) for r in tokens.token_counts(docs).collect()}
    assert set(got) == {*range(len(texts)), None}
    for i, t in enumerate(texts):
        words = re.findall(tokens.PATTERN, t or "")
        assert "".join(words) == (t or "")
        assert got[i] == (len(words), sum(next(n for _, n in tokens.forward([w.encode()], pieces)) for w in words))
    assert got[2] == got[3] == (0, 0)


def test_probabilities_follow_the_corpus(spark):
    texts = ["the cat and the hat"] * 5 + ["that hatter"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    pieces = tokens.vocabulary()
    got = tokens.fit(tokens.pretokens(docs), pieces, 2, 1.0)
    assert got == pytest.approx(fitted(texts, pieces, 2, 1.0)) and sum(map(math.exp, got.values())) == pytest.approx(1)
    assert got[b" the"] == got[b" cat"] > got[b" hatred"] == got[b" dog"]


def test_scores_match_a_library_on_the_same_pieces():
    tk = pytest.importorskip("tokenizers")
    pieces = {k.decode(): -math.log(i + 3) for i, k in enumerate(tokens.vocabulary()) if k.isascii() and k.decode().isalpha()}
    order = list(pieces.items())
    model = tk.Tokenizer(tk.models.Unigram([("<unk>", -50.0), *order], 0, False))
    coded = {k.encode(): v for k, v in order}
    words = ["international", "tokenization", "hello", "zebra", "unbelievably", "qwertyuiop", "Spark", "interna", "internal"]
    mine = dict(tokens.forward(sorted(w.encode() for w in words), coded))
    for w in words:
        found = model.encode(w).tokens
        score = lambda ts: sum(pieces[t] for t in ts)
        assert mine[w.encode()] == len(found) or score(found) == pytest.approx(best(w.encode(), coded)[0])


def test_forgetting_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} other{i % 7}") for i in range(200)], "doc_id long, text string").coalesce(1)
    first = sorted(map(tuple, tokens.token_counts(docs).collect()))
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    monkeypatch.setattr(tokens, "HELD", 5)
    monkeypatch.setattr(tokens, "RANGE_ROWS", 16)
    assert sorted(map(tuple, tokens.token_counts(docs).collect())) == first


def test_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
