from lingmill.llm import chat


def brute_force(rows):
    out = []
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append(((t is not None, t or 0), r or "unknown", x or "", t))
    for c, turns in by.items():
        turns.sort(key=lambda x: x[:3])
        context = ""
        for i, (_, role, text, turn) in enumerate(turns):
            if role == "assistant" and text:
                prompt, target = context + "<|assistant|>\n", text + "<|end|>\n"
                out.append((c, turn, i, prompt, target, len(prompt), len(prompt) + len(target)))
            context += f"<|{role}|>\n{text}<|end|>\n"
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_against_brute_force(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", None), (1, 4, "assistant", "again é"),
        (2, 0, "assistant", "first"), (2, 1, "assistant", ""), (2, 2, "assistant", None), (2, 3, None, "who?"), (2, 4, "assistant", "me"),
        (3, 1, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, None, "assistant", "c"), (None, 0, "assistant", "lost"), (4, 0, "user", "no reply"),
        (5, 0, "user", "x" * 200_000), (5, 1, "assistant", "y" * 200_000),
    ]
    turns = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, prompt string, context int").repartition(3)
    got = [tuple(r) for r in chat.expand(turns).collect()]
    assert sorted(got, key=key) == sorted(brute_force(rows), key=key)


def test_only_the_reply_is_trainable(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "answer")], "conv_id long, turn long, role string, text string")
    r = chat.expand(turns).first()
    assert (r["prompt"] + r["target"])[r["train_start"] : r["train_end"]] == "answer<|end|>\n"


def test_empty_table(spark):
    assert chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
