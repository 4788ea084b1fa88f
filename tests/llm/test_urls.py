import math
from collections import Counter
from itertools import product

import pytest

from lingmill.llm import arrays, urls


def all_splits(name):
    for cuts in product([0, 1], repeat=len(name) - 1):
        words, cur = [], name[0]
        for c, cut in zip(name[1:], cuts):
            if cut:
                words.append(cur)
                cur = c
            else:
                cur += c
        yield words + [cur]


@pytest.mark.parametrize("name", ["cheappills", "x", "freebetsnow", "thepills", "abcxyz", "pillspills"])
def test_segmentation_against_all_splits(name):
    logp = {w: math.log(n / 1000) for w, n in {"cheap": 50, "pills": 40, "free": 60, "bets": 20, "the": 300, "now": 90, "he": 30, "a": 20}.items()}
    unknown = -math.log(1000)
    score = lambda ws: sum(logp.get(w, unknown - math.log(10) * len(w)) for w in ws)
    got = urls.segment(name, logp, unknown)
    assert "".join(got) == name
    best = max(all_splits(name), key=lambda ws: (round(score(ws), 9), -len(ws)))
    assert score(got) == pytest.approx(score(best)) and len(got) == len(best)


def test_parts():
    assert urls.parts("http://User:pw@WWW.Cheap-Pills.example.com:8080/En/12?q=1#x") == ("www.cheap-pills.example.com", "/en/12")
    assert urls.parts("//host/p") == ("host", "/p") and urls.parts("no url") is None and urls.parts("") is None and urls.parts(None) is None
    assert urls.host_tokens("www.cheap-pills24.example.com") == ["cheap", "pills", "example"]
    assert urls.path_tokens("/en/12/new.html") == ["en", "#", "new", "html"]


def site(spark):
    good = [f"https://blog.garden{x}.example.org/en/{i}" for i, x in enumerate(["flower", "tools", "water", "trees", "news"] * 20)]
    bad = [f"http://{h}.example.com/win/{i}" for i, h in enumerate(["cheap-pills", "casino-win", "free-bets", "spam-farm"] * 8)]
    rows = [(i, u, "<p>garden flower water tools</p><script>var x</script> cheap pills casino win free bets now") for i, u in enumerate(good + bad)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute_force(rows, model, seeds):
    """Scores by plain counts over all URLs."""
    n, docs = {0: Counter(), 1: Counter()}, Counter()
    split = lambda h: [w for t in urls.host_tokens(h) for w in urls.segment(t, model.words, model.unknown)]
    feats = {}
    for i, u in rows:
        h, p = urls.parts(u)
        bad = int(bool(set(urls.host_tokens(h)) & set(seeds)))
        feats[i] = [f"h:{w}" for w in split(h)] + [f"p:{t}" for t in urls.path_tokens(p)]
        n[bad].update(feats[i])
        docs[bad] += 1
    vocabulary = len(set(n[0]) | set(n[1])) + 1
    logp = {b: (lambda t, b=b: math.log((n[b][t] + 1) / (sum(n[b].values()) + vocabulary))) for b in (0, 1)}
    return {i: math.log(docs[1] / docs[0]) + sum(logp[1](t) - logp[0](t) for t in f) for i, f in feats.items()}


def test_against_brute_force(spark):
    pages = site(spark).repartition(3)
    model = urls.fit(pages)
    got = {r["page_id"]: r for r in urls.filtered(pages, model).collect()}
    expected = brute_force([(r["page_id"], r["url"]) for r in pages.collect()], model, urls.SEEDS)
    for i, s in expected.items():
        assert got[i]["score"] == pytest.approx(s)
        assert got[i]["blocked"] == (s > 0) == (i >= 100)


def test_unseen_concatenated_hosts(spark):
    model = urls.fit(site(spark))
    fresh = spark.createDataFrame([(1, "http://cheappills.example.net/x"), (2, "http://casinofreebets.example.net/win/3"), (3, "https://flowerwater.example.org/en/5")], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.filtered(fresh, model).collect()}
    assert got[1]["host_words"] == "cheap pills example"
    assert [got[i]["blocked"] for i in (1, 2, 3)] == [True, True, False]


def test_concatenated_hosts_of_many_fitted_pages(spark):
    hot = [(1000 + i, f"http://cheappills.example.com/win/{i}", "<p>cheappills cheap pills</p>") for i in range(500)]
    pages = site(spark).unionByName(spark.createDataFrame(hot, "page_id long, url string, html string"))
    model = urls.fit(pages)
    got = [r for r in urls.filtered(pages, model).collect() if r["page_id"] >= 1000]
    assert {(r["host_words"], r["blocked"]) for r in got} == {("cheap pills example", True)} and len(got) == 500


def test_rare_words_and_tokens_are_kept_beside_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(arrays, "SHARD_ROWS", 7)
    monkeypatch.setattr(urls, "HELD", 3)
    filler = spark.range(4, numPartitions=4).selectExpr("100000 + id AS page_id", "'https://plain.example.org/' || repeat('x/', 300000) AS url", "repeat('and ', 300000) AS html")
    rare = [(5000, "http://spam-zebra.example.com/quagga", "<p>zebra quagga</p>")]
    pages = site(spark).unionByName(filler).unionByName(spark.createDataFrame(rare, "page_id long, url string, html string"))
    model = urls.fit(pages)
    assert model.words.get("quagga") is not None and model.words.get("zzz") is None
    assert model.weights.get("h:zebra") > 0 and model.weights.get("p:quagga") > 0
    assert len(model.words.names) > 1
    fresh = spark.createDataFrame([(1, "http://zebraquagga.example.net/quagga")], "page_id long, url string")
    assert urls.filtered(fresh, model).first()["host_words"] == "zebra quagga example"


def test_long_words_are_words_too(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    rows = [(i, f"http://www{i}.example.org/{long}", f"<p>die {long} and cheap pills</p>") for i in range(3)]
    model = urls.fit(spark.createDataFrame(rows, "page_id long, url string, html string"))
    fresh = spark.createDataFrame([(1, f"http://cheap{long}pills.example.net/"), (2, f"http://{'ab' * 40}.example.net/")], "page_id long, url string")
    assert [r["host_words"] for r in urls.filtered(fresh, model).orderBy("page_id").collect()] == [f"cheap {long} pills example", "ab" * 40 + " example"]


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    model = urls.fit(site(spark))
    rows = [(1, None, "a"), (2, "", "b"), (3, "nonsense", None), (None, "http://cheap-pills.example.com/win/1", "c"), (5, "http://" + "ab" * 2000 + ".com/x", None), (6, "http://a.b/", "d"), (6, "http://a.b/", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, score string")
    got = sorted(urls.filtered(pages, model).collect(), key=lambda r: r["page_id"] or 0)
    assert [(r["page_id"], r["blocked"], r["host"] is None) for r in got] == [(None, True, False), (1, False, True), (2, False, True), (3, False, True), (5, False, False), (6, False, False), (6, False, False)]


def test_empty_and_one_sided(spark):
    empty = site(spark).limit(0)
    model = urls.fit(empty)
    assert urls.filtered(empty, model).collect() == []
    assert {r["blocked"] for r in urls.filtered(site(spark), model).collect()} == {False}
