import pyarrow as pa

import corpus_pipeline as P
from lingmill.llm import common, decontam, langid, ngram_join
from lingmill.llm.common import table
from tests.llm.test_decontam import brute_force as leaks
from tests.llm.test_ngram_join import brute_force as near
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def staged(spark, docs, sf_dir=SF):
    out = []
    for i, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(P.STAGES) - 1:
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    one, two, three, four = staged(spark, docs)
    assert one.columns == two.columns == three.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = {r["doc_id"] for r in one.collect()}
    # language ID: what its single scores say
    assert first == {r["doc_id"] for r in langid.identify(docs, langid.fit(docs)).collect() if r["accepted"]} and len(first) > 0.98 * len(rows)
    # near duplicates: the least doc_id of each connected group
    parent = {i: i for i in first}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near([(i, rows[i]) for i in sorted(first)], ngram_join.N, ngram_join.THRESHOLD):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    second = {r["doc_id"] for r in two.collect()}
    assert second == {i for i in first if find(i) == i} and len(second) < len(first)
    # decontamination
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    third = {r["doc_id"] for r in three.collect()}
    assert third == second - {d for d, _ in leaks([(i, rows[i]) for i in second], items, least=decontam.EVIDENCE)} and len(third) < len(second)
    # packing: all of them, whole
    from collections import Counter

    check(four.collect(), Counter({i: len(rows[i].split()) for i in third}), 2048)


def test_run_equals_its_stages(spark):
    docs = table(spark, SF, "documents")
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, staged(spark, docs)[-1].collect()))


def test_nulls_empty_repeated_and_clashing_columns(spark):
    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame(
        [(None, "Is and retitioning ouen the of with", "en", None, None), (9001, None, "en", "s", 1), (9002, "", None, None, None), (9003, "123 ...", "xx", "s", 1)], docs.schema
    )
    odd = docs.unionByName(extra).unionByName(docs.limit(5)).selectExpr("*", "lang AS gone", "1 AS rank", "text AS __text")
    out = staged(spark, odd)
    assert all(d.columns == odd.columns for d in out[:-1])
    ids = [r["doc_id"] for r in out[2].collect()]
    assert not {9001, 9002, 9003} & set(ids) and None in ids and len(set(ids)) == len(ids)


def test_empty_table(spark):
    empty = table(spark, SF, "documents").limit(0)
    assert [d.collect() for d in staged(spark, spark.createDataFrame([], empty.schema))] == [[], [], [], []]


def test_decontamination_keeps_everything_without_a_benchmark(spark):
    docs = table(spark, SF, "documents")
    assert decontam.without_contaminated(docs, table(spark, SF, "benchmark").limit(0)).count() == docs.count()


def test_workers_return_small_pieces_and_give_memory_back(spark, monkeypatch):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    model, rows = langid.fit(docs), docs.toArrow()
    odd = rows.slice(0, 1).set_column(rows.schema.get_field_index("text"), rows.schema.field("text"), pa.array(["123"], rows.schema.field("text").type))
    batch = pa.concat_tables([rows, odd] * 16).combine_chunks().to_batches()[0]
    stages, given_back = [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: stages.append(f) or self)
    monkeypatch.setattr(common, "trim", lambda: given_back.append(1))
    langid.keep_identified(docs, model)
    decontam.without_contaminated(docs, bench)
    for stage in stages:
        given_back.clear()
        pieces = list(stage(iter([batch, batch.slice(0, 0), batch.slice(0, 1)])))
        assert batch.nbytes > 6 << 20 and max(p.nbytes for p in pieces) < 2 << 20 and len(given_back) == 4  # each batch, and the end
        assert all(p.schema == batch.schema for p in pieces)
        one = [p for i in range(batch.num_rows // 16) for p in stage(iter([batch.slice(i, 1)]))]
        once, first = pa.Table.from_batches(one), pa.Table.from_batches(list(stage(iter([batch.slice(0, 1)]))), batch.schema)
        assert pa.Table.from_batches(pieces).equals(pa.concat_tables([once] * 16 + [first])) and 0 < once.num_rows < batch.num_rows // 16
    assert len(stages) == 2 and list(stages[0](iter([]))) == []
