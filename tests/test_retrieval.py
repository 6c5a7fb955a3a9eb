import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ann, context, cost, dense, filters, fusion, grounding, lexical, metrics, numerics
from corvane.operators import query as Q
from corvane.sources import cache


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "fabric policy fabric"), (2, "policy switch"), (3, "switch port port port")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "fabric policy")], "query_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lexical.bm25_search(docs, q).collect()}
    assert got == {1: 1.871188, 2: 0.552945}


def test_empty_query_and_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(0, "the of")], "query_id long, text string")
    assert lexical.bm25_search(docs, q).count() == 0


def test_reciprocal_ranks(spark):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 3)], "query_id long, doc_id string, rank int")
    b = spark.createDataFrame([(0, "x", 2), (0, "y", 1)], "query_id long, doc_id string, rank int")
    got = {r["doc_id"]: round(r["score"], 6) for r in fusion.reciprocal_rank_fusion([a, b]).collect()}
    assert got == {"x": 0.032522, "y": 0.032266}
    back = {r["doc_id"]: round(r["score"], 6) for r in fusion.reciprocal_rank_fusion([b, a]).collect()}
    assert got == back


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(0, 1, 1, 0), (0, 2, 2, 2), (0, 3, 3, 1)], "query_id long, doc_id long, rank int, rel int")
    one = metrics.with_ideal(rows).groupBy("query_id").agg(metrics.ndcg_retrieved(3).alias("e"), metrics.ndcg_retrieved(3, False).alias("l")).first()
    assert round(one["e"], 6) == 0.659002 and round(one["l"], 6) == 0.669672
    ap = spark.createDataFrame([(0, i, i, r) for i, r in enumerate([0, 1, 0, 1], 1)], "query_id long, doc_id long, rank int, rel int")
    assert metrics.average_precision_retrieved(ap).first()["ap"] == 0.5


def test_first_fit_and_prefix(spark):
    items = spark.createDataFrame([(0, i, c, 10.0 - i) for i, c in enumerate([10, 5, 20, 3])], "q long, id long, c long, score double")
    assert context.first_fit(items, 20, "q", "id", "c", "score").first()["ids"] == [0, 1, 3]
    assert [r["id"] for r in context.prefix_within(items, F.col("c"), 20, ["q"], [F.desc("score")]).collect()] == [0, 1]


def test_middle_out_order(spark):
    r = spark.range(1, 6).select("id", context.middle_out(F.col("id"), F.lit(5)).alias("p")).collect()
    assert [x["id"] for x in sorted(r, key=lambda x: x["p"])] == [1, 2, 3, 5, 4]


def test_unknown_operator_raises():
    with pytest.raises(ValueError):
        filters.metadata_filter([("a", "like", "x")])


def test_missing_field_rejects(spark):
    d = spark.createDataFrame([(1, {"a": "x"}), (2, {"b": "y"})], "id long, m map<string,string>")
    assert [r["id"] for r in d.where(filters.metadata_filter([("a", "ne", "z")], "m")).collect()] == [1]
    assert d.where(filters.metadata_filter([])).count() == 2


def test_query_types(spark):
    cases = {"CVE-2024-12345 affected versions": "exact_term", "Which devices are NOT affected": "negation", "Compare A and B": "comparative", "How do I configure it": "procedural", "What is BGP": "factual", "hello": "general"}
    d = spark.createDataFrame([(k,) for k in cases], "q string")
    assert {r["q"]: r["t"] for r in d.select("q", Q.query_type(F.col("q")).alias("t")).collect()} == cases


def test_query_cost_by_hand(spark):
    p = spark.createDataFrame([("m", 3.0, 15.0, 3.75, 0.3, 1)], cost.PRICE_SCHEMA)
    c = p.select(cost.query_cost(F.lit(8000), F.lit(400), F.lit(1000), F.lit(0)).alias("c")).first()["c"]
    assert abs(c - 0.03075) < 1e-12


def test_recall_of_approximate_search(spark):
    rng = np.random.default_rng(42)
    x = ann.unit(rng.standard_normal((600, 16)))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = dense.vector_search(v, q)
    for found in (ann.graph_lookup(ann.build_graphs(v), q), ann.ivf_lookup(ann.build_ivf(v), q, probe=12), ann.pq_lookup(ann.build_pq(v, centroids=32), q)):
        assert ann.recall(found, exact, 10).agg(F.avg("recall")).first()[0] >= 0.9
    truth = np.argsort(-(x @ x[0]), kind="stable")[:10].tolist()
    assert [r["id"] for r in exact.where("query_id = 0").orderBy("rank").collect()] == truth


def test_attention_by_tiles():
    rng = np.random.default_rng(0)
    q, k, v = (rng.standard_normal((9, 8)) for _ in range(3))
    assert np.allclose(numerics.attention(q, k, v), numerics.online_softmax_attention(q, k, v))
    a, b = rng.standard_normal(8), rng.standard_normal(8)
    assert math.isclose(numerics.rope(a, 5) @ numerics.rope(b, 3), numerics.rope(a, 12) @ numerics.rope(b, 10))


def test_byte_pairs(spark):
    docs = spark.createDataFrame([("low low lower newest newest newest",)], "text string")
    rules = numerics.train_bpe(numerics.word_frequencies(docs), 3)
    assert rules[0] == ("w", "e")
    assert numerics.apply_bpe("ab", [("a", "b")]) == ["ab"]


def test_grounding(spark):
    a = spark.createDataFrame([(1, "Spark reads parquet files quickly. Bananas grow upwards yellow.", "Spark reads parquet files quickly on clusters."), (2, "", "x")], "id long, answer string, context string")
    got = {r["id"]: (r["n_claims"], r["score"]) for r in grounding.grounded_answers(a, ["id"], "answer", "context").collect()}
    assert got == {1: (2, 0.5), 2: (0, 1.0)}


def test_cache_embeds_misses_once(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    known = texts.where("text = 'a'").distinct().select(cache.cache_key("m", F.col("text")).alias("key"), F.array(F.lit(1.0)).alias("embedding"))
    out, new = cache.embed_with_cache(texts, known, "m", lambda t: F.array(F.length(t).cast("double") * 7))
    assert out.count() == 3 and new.count() == 1


def test_streams_agree_with_tables(spark, tmp_path):
    from corvane.streaming.windows import event_windows

    rows = spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 7,0) as ts, id % 5 as user_id, 'a' as event_type, cast(id as double) as value from range(100)")
    rows.write.parquet(str(tmp_path / "e"))
    stream = event_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    closed = {tuple(r) for r in spark.table("w").collect()}
    whole = {tuple(r) for r in event_windows(spark.read.parquet(str(tmp_path / "e"))).collect()}
    assert closed and closed <= whole


def test_cosine_scan_takes_every_query(spark, tmp_path):
    import __spark_entry__ as entry

    rows = spark.range(0, 100_200, 100).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).cast("array<float>").alias("embedding"), F.lit(0).alias("label"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = entry.queries()["ret7_cosine_scan"](spark, str(tmp_path)).collect()
    assert len(got) == 5 * 1002 and len({r["query_id"] for r in got}) == 1002 and all(r["score"] <= 1 for r in got)


def test_epsilon_weighs_both_norms_together(spark):
    corpus = spark.createDataFrame([(1, [3e-6, 4e-6]), (2, [3.0, 4.0]), (3, [0.0, 0.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(0, [3e-6, 4e-6])], "query_id long, vector array<double>")
    got = [(r["id"], r["score"]) for r in dense.vector_search(corpus, q, 3, "epsilon", digits=6).orderBy("rank").collect()]
    assert got == [(2, 0.999996), (1, 0.2), (3, 0.0)]


def test_rounding_keeps_signs_and_halves(spark):
    from corvane.functions import vectors as V

    x = [-3e-7, -0.0, 0.0, 0.0078125, -0.0078125, 5e-7, 4.9999999e-7, 1e300, float("inf"), None]
    got = spark.createDataFrame([(x,)], "v array<double>").select(V.rounded(F.col("v"), 6)).first()[0]
    assert repr(got) == "[-0.0, -0.0, 0.0, 0.007813, -0.007813, 1e-06, 0.0, 1e+300, inf, None]"
    assert math.isnan(spark.range(1).select(V.half_away(F.lit(float("nan")), 6)).first()[0])


@pytest.mark.parametrize("name", ["vec1_normalize", "qry10_hyde_fusion", "tfm3_rotary", "tfm4_norms"])
def test_small_negatives_round_as_in_sql(spark, tmp_path, name):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    rows = [(i, [-1e-8 * (i + 1), 1.0, *[0.25 * (-1) ** k - 1e-9 for k in range(6)], *[1.0] * (i % 2)]) for i in range(8)]
    rows = [(i, [*v[:8], -1e-9]) for i, v in rows]
    rows.append((8, [-1e-9] + [1.0, -1.0] * 4))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    theirs = sorted(map(repr, map(tuple, rel.fetchall())))
    ours = sorted(repr(tuple(r[c] for c in rel.columns)) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    assert ours == theirs and any("-0.0," in r or "-0.0]" in r for r in theirs)
