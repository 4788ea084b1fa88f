import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lingmill.llm import packing


def one_by_one(lengths, capacity):
    """Fill levels of all packs when single items go, longest first, into the shortest pack with room."""
    packs = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, p in enumerate(packs) if p + x <= capacity]
        if fits:
            packs[min(fits, key=lambda i: packs[i])] += x
        else:
            packs.append(x)
    return Counter(packs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(20, 40))
def test_patterns_against_single_items(lengths, capacity):
    found = packing.shortest_pack_first(dict(Counter(lengths)), capacity)
    used = Counter()
    for pattern, count in found:
        assert sum(x * k for x, k in pattern) <= capacity and count > 0
        for x, k in pattern:
            used[x] += k * count
    assert used == Counter(lengths)
    levels = Counter()
    for pattern, count in found:
        levels[sum(x * k for x, k in pattern)] += count
    assert levels == one_by_one(lengths, capacity)


def check(rows, totals, capacity):
    """rows fill packs without overlap, and the pieces of every document are complete."""
    by_pack, by_doc = defaultdict(list), Counter()
    for r in rows:
        if r["length"]:
            by_pack[r["pack"]].append((r["place"], r["length"]))
        else:
            assert r["pack"] is None
        by_doc[r["doc_id"]] += r["length"]
    for spans in by_pack.values():
        at = 0
        for place, length in sorted(spans):
            assert place == at
            at += length
        assert at <= capacity
    assert sorted(by_pack) == list(range(len(by_pack)))
    assert by_doc == totals
    return Counter(sum(x for _, x in spans) for spans in by_pack.values())


def test_pack_against_brute_force(spark):
    r = random.Random(0)
    sizes = [r.choice([0, 1, 2, 3, 5, 8, 30, 50, 100, 101, 250, 1000]) for _ in range(400)]
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(3)
    pieces = [min(100, n - at) for n in sizes for at in range(0, n, 100)]
    for buckets in (1, 3, packing.BUCKETS):
        rows = packing.pack(docs, capacity=100, buckets=buckets).collect()
        assert check(rows, Counter({i: n for i, n in enumerate(sizes)}), 100) == one_by_one(pieces, 100)


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "a b", 3), (None, "c d", 3), (4, "x " * 10_000, 4), (5, "a b", None), (5, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long").withColumnRenamed("length", "pack")
    got = packing.pack(docs).collect()
    check(got, Counter({1: 0, 2: 0, None: 4, 4: 10_000, 5: 4}), 2048)
    assert len(got) == 6 + 5 and sum(r["pack"] is None for r in got) == 2
    assert packing.pack(docs.limit(0)).collect() == []


def test_ties_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id long, text string")
    one, two = (sorted(map(tuple, packing.pack(docs.repartition(n), capacity=7, buckets=5).collect())) for n in (1, 4))
    assert one == two


def test_word_counts_make_no_strings(spark):
    odd = [None, "", " ", "\n\t", "a", " a", "a ", "x  xx\r\nx\x0b\x0cy", "a b c d", "\U0001f600 \U0001f600́", "$1 \\1 \\", "w" * 70_000 + " " * 70_000 + "w"]
    docs = spark.createDataFrame(list(enumerate(odd)), "i long, text string").select("i", packing.word_count("text").alias("n"))
    assert dict(map(tuple, docs.collect())) == {i: len(re.findall(r"[^ \t\n\x0b\f\r]+", x or "")) for i, x in enumerate(odd)}
    assert "regexp_extract_all" not in docs._jdf.queryExecution().optimizedPlan().toString()
