"""Queries of the relational kernel, of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingmill.operators import features as G
from lingmill.operators import kernel as K
from lingmill.operators import predict as P
from lingmill.queries.base import features_sql, query, scratch, table, words
from lingmill.sources import results as RS
from lingmill.sources import tables as S


@query("k1_select", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def k1(spark, sf):
    return K.select(table(spark, sf, "customer"), "c_custkey", "c_name", "c_nationkey")


@query("k2_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def k2(spark, sf):
    return K.select(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", where=["o_totalprice > 100000", "o_orderstatus = 'F'"])


@query("k3_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1, 2")
def k3(spark, sf):
    return K.select(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "count(*) AS n", "cast(sum(l_quantity) AS double) AS quantity", group_by=["l_returnflag", "l_linestatus"])


@query("k4_order_by", "SELECT p_partkey, p_name FROM part ORDER BY p_name DESC, p_partkey")
def k4(spark, sf):
    return K.select(table(spark, sf, "part"), "p_partkey", "p_name", order_by=[("p_name", "DESC"), ("p_partkey", "ASC")])


@query("k5_limit_offset", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def k5(spark, sf):
    return K.select(table(spark, sf, "orders"), "o_orderkey", "o_custkey", order_by=[("o_orderkey", "ASC")], limit=50, offset=100)


@query("k6_distinct", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def k6(spark, sf):
    return K.select(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", distinct=True)


@query("k8_insert_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) t(k, v)")
def k8(spark, sf):
    path = scratch(spark, "values")
    K.insert_values(spark, path, [(1, "a"), (2, "b")], "k int, v string")
    K.insert_values(spark, path, [(3, "c")], "k int, v string")
    return spark.read.parquet(path)


@query("k9_insert_select", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def k9(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = scratch(spark, "select")
    K.create_like(nation.drop("n_regionkey"), path)
    K.insert_select(nation.where("n_regionkey = 1"), path)
    return spark.read.parquet(path)


@query("k11_add_column", "SELECT r_regionkey, r_name, CAST(NULL AS DOUBLE) AS score FROM region")
def k11(spark, sf):
    return K.add_column(table(spark, sf, "region").select("r_regionkey", "r_name"), "score", "double")


@query("k12_catalog", "SELECT 'feat$kernel' AS name")
def k12(spark, sf):
    table(spark, sf, "region").createOrReplaceTempView("`feat$kernel`")
    return spark.createDataFrame([(n,) for n in K.tables(spark, "feat$kernel%", features=True)], "name string")


@query("k13_repeated_keys", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def k13(spark, sf):
    return K.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey"])


@query("k14_random_sample")
def k14(spark, sf):
    return K.random_sample(table(spark, sf, "documents").select("doc_id", "source"), 0.1, ["doc_id"])


@query("k15_copy", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
def k15(spark, sf):
    return K.create_like(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), scratch(spark, "copy"), "c_acctbal > 0").drop("c_acctbal")


@query("k16_subset_by_key", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def k16(spark, sf):
    keys = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return K.subset_by_key(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")


@query("k17_update", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def k17(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    changes = c.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.concat(F.upper("c_mktsegment"), F.lit("!")))
    return K.updated(c, changes, "c_custkey")


@query("k18_split_by", "SELECT p_partkey, p_brand FROM part")
def k18(spark, sf):
    path = scratch(spark, "split")
    K.split_by(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", path)
    return spark.read.parquet(path).select("p_partkey", "p_brand")


@query("k21_rename", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def k21(spark, sf):
    return K.renamed(table(spark, sf, "supplier"), {"s_suppkey": "id", "s_name": "name"}, ["s_suppkey", "s_name"])


# ---- sources and sinks -----------------------------------------------------------------------------------------------


@query("s3_csv", "SELECT doc_id, text, source FROM documents")
def s3(spark, sf):
    path = scratch(spark, "csv")
    S.write_csv(table(spark, sf, "documents").select("doc_id", "text", "source"), path)
    return S.read_csv(spark, path, "doc_id long, text string, source string")


@query("s3_csv_inferred", "SELECT c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey FROM customer")
def s3b(spark, sf):
    path = scratch(spark, "csv")
    S.write_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return S.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("s6_conversation_corpus", "SELECT conv_id || '_' || turn AS message_id, role AS speaker, CAST(conv_id AS VARCHAR) AS conversation_id, text AS message FROM conversations")
def s6(spark, sf):
    folder = scratch(spark, "corpus")
    t = table(spark, sf, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("role").alias("speaker"), F.col("conv_id").cast("string").alias("conversation_id"), "text")
    t.write.json(f"{folder}/utterances.jsonl")
    return S.conversation_corpus(spark, folder)["utterances"]


@query("s7_gzip_csv", f"SELECT upper(group_id) AS group_id, feat, value, group_norm FROM {features_sql(1, 'role', source='conversations')}")
def s7(spark, sf):
    from lingmill.operators.extract import add_ngrams

    path = scratch(spark, "gzip")
    rows = table(spark, sf, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("id"), "text", "role").where("text IS NOT NULL AND role IS NOT NULL")
    rows.write.option("compression", "gzip").option("escape", "\\").csv(path)
    return add_ngrams(S.gzip_csv_messages(spark, path, 0, 1), 1, "group_id")


@query("s8_topic_csv", "SELECT CAST(p_size AS VARCHAR) AS category, p_name AS term, CAST(p_partkey AS DOUBLE) AS weight FROM part QUALIFY p_partkey > 0.5 * min(p_partkey) OVER (PARTITION BY p_size)")
def s8(spark, sf):
    path = scratch(spark, "topics")
    p = F.array_sort(F.collect_list(F.struct("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("w"))))
    flat = F.array_join(F.transform(p, lambda x: F.concat_ws(",", x["w"], x["p_partkey"])), ",")
    lines = table(spark, sf, "part").groupBy("p_size").agg(flat.alias("w")).select(F.concat_ws(",", "p_size", "w").alias("line"))
    S.write_lines(lines, path)
    return S.topic_csv(spark, path, 0.5)


@query("s10_joined_lines", f"SELECT group_id, group_id || ' en ' || string_agg(repeat(replace(feat, ' ', '_') || ' ', CAST(value - 1 AS INTEGER)) || replace(feat, ' ', '_'), ' ' ORDER BY feat) AS line FROM {features_sql(1, 'role', source='conversations')} GROUP BY group_id")
def s10(spark, sf):
    return G.joined_lines(words(spark, sf, "role", "conversations"))


@query("s12_dense_table", "SELECT c_mktsegment, coalesce(CAST(max(CASE WHEN c_nationkey = 1 THEN c_custkey END) AS VARCHAR), 'NULL') AS \"1\", coalesce(CAST(max(CASE WHEN c_nationkey = 2 THEN c_custkey END) AS VARCHAR), 'NULL') AS \"2\" FROM customer GROUP BY 1")
def s12(spark, sf):
    top = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.max("c_custkey").alias("k"))
    return S.dense_table(top, "c_mktsegment", "c_nationkey", "k", ["1", "2"])


# ---- sinks of results ------------------------------------------------------------------------------------------------

PREDICTED_SQL = "p AS (SELECT c_custkey AS group_id, 'balance' AS outcome, CAST(c_acctbal AS DOUBLE) AS y, CAST(c_nationkey * 100 AS DOUBLE) AS prediction FROM customer)"


def _balances(spark, sf):
    """Customers' balances, and a prediction that both engines can make."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("group_id"), F.lit("balance").alias("outcome"), F.col("c_acctbal").cast("double").alias("y"), (F.col("c_nationkey") * 100).cast("double").alias("prediction"))


@query("s14_scores", "SELECT c_mktsegment AS outcome, round(corr(CAST(c_acctbal AS DOUBLE), c_nationkey * 100), 5) AS pearson, round(avg(abs(c_acctbal - c_nationkey * 100)), 3) AS mae, count(*) AS n FROM customer GROUP BY 1")
def s14(spark, sf):
    path = scratch(spark, "scores")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    RS.write_scores(P.regression_metrics(_balances(spark, sf).join(c, F.col("group_id") == F.col("c_custkey")).withColumn("outcome", F.col("c_mktsegment"))), path)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return back.select("outcome", F.round("pearson", 5).alias("pearson"), F.round("mae", 3).alias("mae"), F.col("n").cast("long").alias("n"))


@query("s14_predictions", f"WITH {PREDICTED_SQL} SELECT group_id, y AS balance_true, prediction AS \"balance|all|true\", prediction / 2 AS \"balance|none|false\" FROM p")
def s14b(spark, sf):
    path = scratch(spark, "predictions")
    p = _balances(spark, sf).withColumns({"controls": F.lit("all"), "with_language": F.lit(True)})
    both = p.unionByName(p.withColumns({"controls": F.lit("none"), "with_language": F.lit(False), "prediction": F.col("prediction") / 2}))
    RS.write_predictions(both, ["balance"], path)
    return spark.read.schema('group_id long, balance_true double, `balance|all|true` double, `balance|none|false` double').option("header", True).csv(path)


@query("s14_probabilities", "SELECT doc_id AS group_id, k AS class, CASE WHEN (k = 'toxic') = (toxic = 1) THEN 0.75 ELSE 0.25 END::DOUBLE AS probability FROM labels, (VALUES ('clean'), ('toxic')) t(k) WHERE toxic IS NOT NULL")
def s14c(spark, sf):
    path = scratch(spark, "probabilities")
    rows = table(spark, sf, "labels").where("toxic IS NOT NULL").select(F.col("doc_id").alias("group_id"), F.when(F.col("toxic") == 1, F.array(F.lit(0.25), F.lit(0.75))).otherwise(F.array(F.lit(0.75), F.lit(0.25))).alias("probability"))
    RS.write_probabilities(rows, ["clean", "toxic"], path)
    return spark.read.schema("group_id long, class string, probability double").option("header", True).csv(path)


@query("s16_outcome_table", "SELECT doc_id, quality, toxic FROM labels")
def s16(spark, sf):
    path = scratch(spark, "outcomes")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    RS.create_outcome_table(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), f"{name}.labels")
    return spark.table(f"{name}.labels")


@query(
    "s19_messages_with_predictions",
    "WITH f AS (SELECT source AS group_id, avg(n_chars) AS y, count(*) * 100.0::DOUBLE AS prediction FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 5) SELECT group_id, round(y, 6) AS y, prediction, doc_id AS message_id, text AS message FROM f JOIN documents ON source = group_id QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY doc_id) <= 3",
)
def s19(spark, sf):
    d = table(spark, sf, "documents")
    p = d.where("source IS NOT NULL").groupBy(F.col("source").alias("group_id")).agg(F.avg("n_chars").alias("y"), (F.count("*") * 100.0).alias("prediction"))
    return RS.messages_with_predictions(p, d, "source", "doc_id", "text", 5, 3).withColumn("y", F.round("y", 6))


@query("s13_html", f"SELECT '<tr><td>' || replace(replace(replace(feat, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td><td>' || CAST(value AS VARCHAR) || '</td></tr>' AS line FROM {features_sql(1, 'role', source='conversations')}")
def s13h(spark, sf):
    path = scratch(spark, "html")
    RS.write_html(words(spark, sf, "role", "conversations"), ["feat", "value"], path)
    return spark.read.text(path).where("value LIKE '<tr><td>%'").withColumnRenamed("value", "line")
