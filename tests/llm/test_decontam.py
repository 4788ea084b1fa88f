import random

import pyarrow as pa

from lingmill.llm import decontam

W = [f"word{i}" for i in range(300)]


def text_of(n, seed):
    return " ".join(random.Random(seed).choices(W, k=n))


def brute_force(docs, items, window=8, least=1):
    """{(doc, item): (start, end, windows)} by comparing all windows of words with their places."""
    def words(text):
        out, cur, start, end = [], "", 0, 0
        for i, c in enumerate(text or ""):
            f = decontam.fold(c)
            if f == 0xFFFFFFFF:
                continue
            if f == 0:
                if cur:
                    out.append((cur, start, end))
                cur = ""
            else:
                if not cur:
                    start = i
                cur += chr(f)
                end = i + 1
        return out + ([(cur, start, end)] if cur else [])

    patterns = {}
    for item, text in items:
        w = [x for x, *_ in words(text)]
        if len(w) >= least:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                patterns.setdefault(tuple(w[i : i + n]), set()).add(item)
    found = {}
    for doc, text in docs:
        w = words(text)
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                for item in patterns.get(tuple(x for x, *_ in w[i : i + n]), ()):
                    s, e, k = found.get((doc, item), (1 << 60, 0, 0))
                    found[doc, item] = min(s, w[i][1]), max(e, w[i + n - 1][2]), k + 1
    return found


def test_against_brute_force(spark):
    items = [(1, text_of(30, 1)), (2, "Què és 'això', Señor? Äpfel & Birnen"), (3, text_of(30, 1)), (4, "too short"), (5, None), (6, ""), (None, text_of(20, 9)), (8, "one two three four")]
    loud = text_of(30, 1).upper().replace(" ", "!!  ")
    docs = [
        (1, "start " + text_of(30, 1) + " end"), (2, loud), (3, text_of(500, 2)), (4, None), (5, ""), (6, "x QUE es aixo senor apfel birnen y"),
        (7, " ".join(text_of(30, 1).split()[3:12])), (8, " ".join(text_of(30, 1).split()[3:10])), (9, text_of(5000, 3) + " " + text_of(20, 9)), (None, text_of(20, 9)), (11, "one two three fourth"), (12, "ONE-two_three...four"),
        (13, "zero one two three four" * 2), (14, "This is Too-SHORT!"), (15, "too shorter"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = {(k[0], k[1], *v) for k, v in brute_force(docs, items).items()}
    assert {tuple(r) for r in decontam.find(d, b).collect()} == expected
    assert (7, 1) in {e[:2] for e in expected} and 8 not in {e[0] for e in expected} and 12 in {e[0] for e in expected}
    assert {e[:2] for e in expected if e[0] in (14, 15)} == {(14, 4)}  # a short answer, as whole words
    # several automata give the same
    assert {tuple(r) for r in decontam.find(d, b, limit=200).collect()} == expected
    clean = decontam.without_contaminated(d, b)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted({x for x, _ in docs if x} - {x for x, _ in brute_force(docs, items, least=decontam.EVIDENCE)})
    assert 14 in {r["doc_id"] for r in clean.collect()} and 14 not in {r["doc_id"] for r in decontam.without_contaminated(d, b, least=1).collect()}
    assert [r["doc_id"] for r in decontam.without_contaminated(d, b, limit=200).orderBy("doc_id").collect()] == [r["doc_id"] for r in clean.orderBy("doc_id").collect()]


def test_offsets_with_combining_marks(spark):
    text = "«Café» au lait, s'il vous plaît — merci"
    norm, origin, _, _ = decontam.normalised(pa.array([text], pa.large_string()))
    assert norm == " cafe au lait s il vous plait merci \n"
    b = spark.createDataFrame([(1, "CAFÉ au lait s’il vous plaît")], "item_id long, text string")
    r = decontam.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), b).first()
    assert text[r["start"] : r["end"]] == "Café» au lait, s'il vous plaît"


def test_questions_and_answers(spark):
    b = spark.createDataFrame([(1, text_of(12, 1), text_of(12, 2)), (2, None, text_of(12, 3))], "item_id long, question string, answer string")
    d = spark.createDataFrame([(1, text_of(12, 2)), (2, text_of(12, 3)), (3, text_of(12, 4))], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find(d, b, columns=("question", "answer")).collect()} == {(1, 1), (2, 2)}


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    b = spark.createDataFrame([(1, text_of(20, 1))], "item_id long, text string")
    d = spark.createDataFrame([(1, text_of(20, 1), 5, None)] * 2 + [(2, "clean", None, "w")], "doc_id long, text string, item_id long, windows string")
    assert [r["doc_id"] for r in decontam.find(d, b).collect()] == [1, 1]
    kept = decontam.without_contaminated(d, b)
    assert kept.schema == d.schema and [tuple(r) for r in kept.collect()] == [(2, "clean", None, "w")]
    assert decontam.find(d.limit(0), b).collect() == [] and decontam.find(d, b.limit(0)).collect() == []
    assert decontam.without_contaminated(d, b.limit(0)).count() == 3
