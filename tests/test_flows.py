"""Flows made of several operators, and the indexes they keep, on corpora small enough to follow by hand."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import ann, chunking, dense, lexical, numerics, rag
from corvane.operators import context as X
from corvane.sources import tables

NOTES = [
    (1, "The gateway renews its lease every hour. A lease that is not renewed ends.", "guide"),
    (2, "Restart the gateway after an upgrade. Then check the lease.", "runbook"),
    (3, "Alerts go to the night shift. Nobody else is called.", None),
    (4, None, "empty"),
    (5, "", "empty"),
]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(NOTES, "doc_id long, text string, source string").repartition(2)


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_kept_index_searches_like_plain_documents(spark, notes):
    q = questions(spark, "gateway lease", "night alerts called", "unknownword")
    index = lexical.build_index(notes)
    assert rows(lexical.index_search(index, q)) == rows(lexical.bm25_search(notes, q))
    assert rows(lexical.index_scores(index, q)) and index.stats.first()["n"] == len(NOTES)
    halves = lexical.append_to_index(lexical.build_index(notes.where("doc_id < 3")), notes.where("doc_id >= 3"))
    assert rows(lexical.index_search(halves, q)) == rows(lexical.bm25_search(notes, q))
    none = lexical.build_index(notes.where("doc_id < 0"))
    assert lexical.index_search(none, q).count() == 0 and lexical.bm25_search(notes.where("doc_id < 0"), q).count() == 0


def test_many_terms_are_joined(spark, notes):
    q = questions(spark, "gateway lease night")
    index, terms = lexical.build_index(notes), lexical.query_terms(q).select("term").distinct()
    assert rows(lexical.of_terms(index.postings, terms, 1)) == rows(lexical.of_terms(index.postings, terms))


def test_kept_tables_follow_their_source(spark, tmp_path):
    path, built = str(tmp_path / "source"), []

    def build():
        built.append(1)
        return {"copy": tables.written(spark.read.parquet(path), "copy")}

    spark.range(3).write.parquet(path)
    assert tables.kept(spark, "copies", [path], build)["copy"].count() == 3
    assert tables.kept(spark, "copies", [path], build)["copy"].count() == 3 and len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert tables.kept(spark, "copies", [path], build)["copy"].count() == 5 and len(built) == 2


def test_questions_are_answered_from_their_documents(spark, notes):
    flow = rag.ingest(notes, target=12)
    assert {r["doc_id"] for r in flow.chunks.select("doc_id").collect()} == {1, 2, 3}
    got = {r["query_id"]: r for r in flow.ask(questions(spark, "when is our lease renewed", "who is called at night"), k=2).collect()}
    assert got[0]["needs_retrieval"] and not got[1]["needs_retrieval"]
    for r in got.values():
        assert r["n_chunks"] == 2 and r["context"].startswith("[Chunk1] Source: ") and r["verdict"] == "PASS"
        assert r["answer"].split()[0] in r["context"]
    only = flow.ask(questions(spark, "lease"), F.col("source") == "runbook").collect()
    assert "guide" not in only[0]["context"]
    none = flow.ask(questions(spark, "lease"), F.lit(False)).first()
    assert none["n_chunks"] == 0 and none["answer"] == "No source answers: lease"


def test_optimizer_dispatches_by_type(spark, notes):
    q = questions(spark, "what is a lease", "compare the gateway and the night shift", "not any alerts", "night shift")
    kinds = {(r["query_id"], r["technique"]) for r in rag.variants(q).collect()}
    assert kinds == {(0, "HYDE"), (1, "DECOMPOSE"), (2, "PASSTHROUGH"), (3, "MULTI_QUERY")}
    search = lambda q, k: lexical.bm25_search(notes, q, k)
    found = rag.optimized(q, search)
    assert {r["doc_id"] for r in found.where("query_id = 1").collect()} == {1, 2, 3}
    relevant = spark.createDataFrame([(1, 3), (1, 5), (3, 3)], "query_id long, doc_id long")
    assert {r["query_id"]: r["recall"] for r in rag.recall_of(found, relevant).collect()} == {1: 0.5, 3: 1.0}


def test_sub_questions_are_answered_apart(spark, notes):
    q = questions(spark, "the lease of the gateway and the night shift", "zzz")
    got = {r["query_id"]: r for r in rag.decomposed_answers(q, notes, lambda q, k: lexical.bm25_search(notes, q, k)).collect()}
    assert got[0]["n_parts"] == 2 and got[0]["answer"].endswith(NOTES[2][1]) and 0 < got[0]["confidence"] <= 1
    assert got[1]["answer"] == "Information not found in context." and got[1]["confidence"] == 0


def test_harness_and_report(spark, notes):
    q = questions(spark, "gateway lease hour", "night shift alerts")
    relevant = spark.createDataFrame([(0, 1), (1, 3)], "query_id long, doc_id long")
    scores = rag.harness(q, notes, relevant, lambda q, k: lexical.bm25_search(notes, q, k), 1)
    assert {(r["query_id"], r["precision"], r["recall"], r["faithfulness"]) for r in scores.collect()} == {(0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0)}
    assert {r["metric"]: r["status"] for r in rag.report(scores).collect()}["recall"] == "PASS"


def test_judges_that_dont_answer_in_json_are_unclear(spark):
    a = spark.createDataFrame([(1, "the lease ends", "the lease ends now")], "id long, answer string, context string")
    assert rag.judged_by(a, ["id"], "answer", "context", rag.overlap_judge).first()["verdict"] == "grounded"
    assert rag.judged_by(a, ["id"], "answer", "context", lambda a, c: F.lit("hm")).first()["verdict"] == "unclear"


def test_recursive_chunks():
    seps = chunking.SEPARATORS["markdown"]
    assert chunking.recursive_chunks("  short ", seps) == ["short"] and chunking.recursive_chunks(" \n", seps) == []
    text = "intro line\n## one\n" + "a " * 30 + "\n## two\n" + "b " * 30
    parts = chunking.recursive_chunks(text, seps, 20, 2)
    assert parts[0].startswith("intro line") and any(p.lstrip().startswith("## two") for p in parts)
    assert all(chunking.tokens_of(p) <= 20 for p in parts)
    assert chunking.divided("\n\n\nx", "\n\n") == ["\n\nx"] and chunking.divided("a. b. ", ". ") == ["a", "b"]
    assert chunking.recursive_chunks("x" * 100, [], 10, 0) == ["x" * 40, "x" * 40, "x" * 20]


def test_context_strategies(spark):
    items = spark.createDataFrame([(1, i, s, c, t) for i, (s, c, t) in enumerate([(0.9, 50, "core"), (0.5, 60, "general"), (0.8, 70, "supporting"), (0.2, 10, "general")])], "g long, id long, score double, t long, tier string")
    pick = lambda name, **o: X.selected(items, name, 130, "g", "id", "t", "score", "tier", **o).first()["ids"]
    assert pick("fixed_k", most=2) == [0, 2] and pick("dynamic") == [0, 2, 3] and pick("threshold") == [0, 2]
    assert pick("threshold", threshold=0.95) == [0] and pick("hierarchical") == [0, 3]
    with pytest.raises(ValueError):
        pick("other")
    assert [r["id"] for r in X.trimmed(items, 130, "g", "id", F.col("t")).orderBy("id").collect()] == [0, 1]


def test_streamed_answers_and_wrapping(spark):
    d = spark.createDataFrame([(1, 0.0, 0.5, "a"), (1, 0.0, 1.5, "c"), (1, 0.0, 0.9, "b")], "id long, asked double, at double, delta string")
    r = rag.streamed(d, ["id"]).first()
    assert (r["answer"], r["n_deltas"], r["first_delay"], r["total"]) == ("abc", 3, 0.5, 1.5)
    one = spark.range(1).select(T.wrapped(F.lit("aa bb cccccccc d"), 5).alias("w")).first()["w"]
    assert one == ["aa bb", "cccccccc", "d"]


def test_native_attention_is_the_matrix_one(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((6, 4))
    f = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "g long, i long, v array<double>")
    for causal in (False, True):
        got = np.array([r["out"] for r in numerics.attended(f, "g", "i", "v", "v", "v", causal).orderBy("i").collect()])
        assert np.allclose(got, numerics.attention(x, x, x, causal))
    turned = spark.createDataFrame([(3, x[0].tolist())], "p long, v array<double>").select(numerics.rotated(F.col("v"), F.col("p")).alias("r"), numerics.normed(F.col("v")).alias("n")).first()
    assert np.allclose(turned["r"], numerics.rope(x[0], 3)) and np.allclose(turned["n"], numerics.layer_norm(x[0]))


def test_too_many_queries_are_refused(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, vector array<double>")
    with pytest.raises(ValueError):
        dense.vector_search(v, v.withColumnRenamed("id", "query_id"), most=3)
    assert ann.ivf_lookup(ann.build_ivf(v, 2), v.withColumnRenamed("id", "query_id"), 1, 2).count() == 5


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        tables.shared_dir(Session())
