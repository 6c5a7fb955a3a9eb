"""Lexical and dense retrieval, fusion, filters and metrics over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators import dense, filters, fusion, lexical, metrics
from corvane.plans.registry import query, table
from corvane.plans.text_plans import TOKENS
from corvane.sources.tables import kept

BENCHMARK = "(select item_id as query_id, text from benchmark)"


def tokens_cte(queries: str = BENCHMARK) -> str:
    """Postings, statistics and the terms of ``queries`` (query_id, text) as common table expressions."""
    return f"""toks as (select doc_id, {TOKENS} as t from documents), posts as (select doc_id, len(t) as dl, unnest(t) as term from toks), post as (select doc_id, dl, term, count(*) as tf from posts group by all),
  stats as (select count(*) as n, sum(len(t)) / count(*) as avgdl from toks), dfs as (select term, count(*) as df from post group by term),
  qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({TOKENS}) as term from {queries}) group by all)"""


def bm25_cte(queries: str = BENCHMARK, k: int = 10) -> str:
    return tokens_cte(queries) + f""", bm25 as (select query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 6) as score
  from qt join dfs using (term) join post using (term), stats group by query_id, doc_id), bm25_top as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm25) where rank <= {k})"""


TOKENS_CTE, BM25_CTE = tokens_cte(), bm25_cte()
# vectors: queries are the rows with an id divisible by 100
VEC_CTE = """vecs as (select vec_id as id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
  qv as (select id as query_id, label as qlabel, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-10)) as q from vecs where id % 100 = 0),
  sims as (select query_id, qlabel, id, label, round(list_dot_product(v, q), 9) as score from vecs, qv),
  top10 as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from sims) where rank <= 10)"""


def benchmark_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical_index(spark, sf) -> lexical.LexicalIndex:
    """The kept index of the documents table: tokenised by the first search that wants it."""
    return lexical.LexicalIndex(**kept(spark, "lexical", [f"{sf}/documents.parquet"], lambda: lexical.build_index(table(spark, sf, "documents")).tables()))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark, sf):
    return vectors(spark, sf).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", F.col("label").alias("qlabel"))


@query(f"with {TOKENS_CTE} select n, round(avgdl, 6) as avgdl, (select count(*) from dfs) as n_terms from stats")
def agg1_corpus_stats(spark, sf):
    d = table(spark, sf, "documents")
    return lexical.corpus_stats(d).join(lexical.term_stats(lexical.postings(d)).agg(F.count("*").alias("n_terms"))).select("n", F.round("avgdl", 6).alias("avgdl"), "n_terms")


@query(f"with {TOKENS_CTE} select doc_id, term, tf from post")
def agg2_term_frequency(spark, sf):
    return lexical.postings(table(spark, sf, "documents")).select("doc_id", "term", "tf")


@query(f"with {TOKENS_CTE} select query_id, doc_id, round(sum(tf / greatest(dl, 1) * (ln((n + 1) / (df + 1)) + 1)), 6) as score from qt join dfs using (term) join post using (term), stats group by query_id, doc_id")
def ret1_tfidf(spark, sf):
    return lexical.tfidf_scores(table(spark, sf, "documents"), benchmark_queries(spark, sf))


@query(f"with {TOKENS_CTE} select term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) as idf from dfs, stats")
def ret2_bm25_fit(spark, sf):
    d = table(spark, sf, "documents")
    return lexical.term_stats(lexical.postings(d)).join(F.broadcast(lexical.corpus_stats(d))).select("term", "df", F.round(lexical.bm25_idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"with {BM25_CTE} select query_id, doc_id, score from bm25")
def ret3_bm25_score(spark, sf):
    return lexical.bm25_scores(table(spark, sf, "documents"), benchmark_queries(spark, sf))


@query(f"with {BM25_CTE} select query_id, doc_id, score, rank from bm25_top")
def ret4_bm25_search(spark, sf):
    return lexical.index_search(lexical_index(spark, sf), benchmark_queries(spark, sf))


@query(f"with {VEC_CTE} select query_id, id, round(score, 6) as score, rank from top10")
def ret5_exact_search(spark, sf):
    return dense.vector_search(vectors(spark, sf), vector_queries(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"with {VEC_CTE}, c as (select query_id, id, round(list_dot_product(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), q), 9) as score from vecs, qv) select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from c) where rank <= 10")
def ret6_normalised_search(spark, sf):
    return dense.vector_search(vectors(spark, sf), vector_queries(spark, sf), metric="cosine").withColumn("score", F.round("score", 6))


@query(f"with {VEC_CTE}, f as (select * from sims where label in (1, 2, 3)) select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from f) where rank <= 10")
def ret12_prefiltered_search(spark, sf):
    cond = filters.metadata_filter([("label", "in", [1, 2, 3])])
    return dense.prefiltered_search(vectors(spark, sf), vector_queries(spark, sf), cond).withColumn("score", F.round("score", 6))


@query(f"with {VEC_CTE}, t as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as r from sims) where r <= 40 and label in (1, 2, 3)) select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from t) where rank <= 10")
def ret13_postfiltered_search(spark, sf):
    cond = filters.metadata_filter([("label", "in", [1, 2, 3])])
    return dense.postfiltered_search(vectors(spark, sf), vector_queries(spark, sf), cond).withColumn("score", F.round("score", 6)).select("query_id", "id", "score", "rank")


def both_lists(spark, sf):
    """Lexical and dense top ten for the benchmark items; the dense query is the item's own row number among the vectors."""
    lex = lexical.index_search(lexical_index(spark, sf), benchmark_queries(spark, sf))
    v = vectors(spark, sf)
    q = v.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), "id").select(F.col("id").alias("query_id"), "vector")
    return lex, dense.vector_search(v, q).withColumnRenamed("id", "doc_id")


BOTH = BM25_CTE + """, vecs as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings), qv as (select id as query_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-10)) as q from vecs where id in (select item_id from benchmark)),
  sims as (select query_id, id as doc_id, round(list_dot_product(v, q), 9) as score from vecs, qv), dense_top as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sims) where rank <= 10)"""
RRF = BOTH + ", rrf as (select query_id, doc_id, round(sum(1 / (60 + rank)), 9) as score from (select query_id, doc_id, rank from bm25_top union all select query_id, doc_id, rank from dense_top) group by all)"


@query(f"with {RRF} select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from rrf) where rank <= 5")
def ret14_reciprocal_rank_fusion(spark, sf):
    return fusion.reciprocal_rank_fusion(list(both_lists(spark, sf)), top=5)


@query(f"""with {BOTH}, b as (select query_id, doc_id, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from bm25_top window w as (partition by query_id)),
  d as (select query_id, doc_id, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from dense_top window w as (partition by query_id)),
  f as (select query_id, doc_id, round(0.5 * coalesce(d.s, 0) + 0.5 * coalesce(b.s, 0), 6) as score from b full join d using (query_id, doc_id)) select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f) where rank <= 5""")
def ret15_weighted_fusion(spark, sf):
    return fusion.weighted_fusion(*both_lists(spark, sf), top=5)


@query(f"with {BOTH} select query_id, doc_id, r.score, rank from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(b.score / (1 + length(text)), 9) as score from bm25_top b join documents using (doc_id))) r where rank <= 5")
def ret16_cascade_rerank(spark, sf):
    first = both_lists(spark, sf)[0].join(table(spark, sf, "documents").select("doc_id", F.length("text").alias("len")), "doc_id")
    return fusion.cascade(first, F.round(F.col("first_score") / (1 + F.col("len")), 9)).select("query_id", "doc_id", "score", "rank")


@query(f"""with {RRF}, ranks as (select query_id, doc_id, b.rank as bm25_rank, d.rank as dense_rank from bm25_top b full join dense_top d using (query_id, doc_id)), k as (select r.* from rrf r join documents using (doc_id) where lang in ('en', 'de'))
  select query_id, doc_id, score, rank, bm25_rank, dense_rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from k) join ranks using (query_id, doc_id) where rank <= 5""")
def ret17_hybrid_search(spark, sf):
    lex, vec = both_lists(spark, sf)
    kept = table(spark, sf, "documents").where(filters.metadata_filter([("lang", "in", ["en", "de"])])).select("doc_id")
    fused = fusion.reciprocal_rank_fusion([lex, vec]).join(kept, "doc_id", "left_semi")
    return lexical.top_k(fused, 5).join(fusion.ranks_side_by_side(lex, vec), ["query_id", "doc_id"])


@query("select k, rank, round(1 / (k + rank), 9) as share from (select unnest([1, 10, 60, 100]) as k), (select unnest(range(1, 21)) as rank)")
def ret20_rrf_sensitivity(spark, sf):
    ks = spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 10, 60, 100)))).alias("k"))
    return ks.select("k", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("rank")).withColumn("share", F.round(1 / (F.col("k") + F.col("rank")), 9))


@query("select tf, k1, round(tf * (k1 + 1) / (tf + k1), 9) as weight from (select unnest([0.5, 1.2, 1.5, 2.0])::double as k1), (select unnest(range(1, 31)) as tf)")
def ret20_tf_saturation(spark, sf):
    ks = spark.range(1).select(F.explode(F.array(*map(F.lit, (0.5, 1.2, 1.5, 2.0)))).alias("k1"))
    one = ks.select("k1", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("tf"))
    return one.select("tf", "k1", F.round(F.col("tf") * (F.col("k1") + 1) / (F.col("tf") + F.col("k1")), 9).alias("weight"))


# ---- filters -------------------------------------------------------------------------------------------------------


@query("select doc_id from documents where lang = 'en' and source <> 'src0' and n_chars >= 200 and n_chars < 5000 and lang in ('en', 'de') and source not in ('src1')")
def flt1_metadata_filter(spark, sf):
    cond = [("lang", "eq", "en"), ("source", "ne", "src0"), ("n_chars", "gte", 200), ("n_chars", "lt", 5000), ("lang", "in", ["en", "de"]), ("source", "nin", ["src1"])]
    return table(spark, sf, "documents").where(filters.metadata_filter(cond)).select("doc_id")


@query("select event_id from events where json_extract_string(props, '$.k') is not null and json_extract_string(props, '$.k') <> '69' and json_extract_string(props, '$.k') <= '80'")
def flt2_map_filter(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("meta"))
    return e.where(filters.metadata_filter([("k", "ne", "69"), ("k", "lte", "80")], "meta")).select("event_id")


@query("select lang, count(*) as n, sum(n_chars)::bigint as chars from documents where n_chars <= 3000 group by lang")
def flt3_filter_chunks(spark, sf):
    return table(spark, sf, "documents").where(filters.metadata_filter([("n_chars", "lte", 3000)])).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"with {VEC_CTE}, r as (select *, row_number() over (partition by query_id order by score desc, id) as rank, max(score) over (partition by query_id) as best from sims where id <> query_id) select query_id, id, rank from r where score >= 0.5 or (best < 0.5 and rank <= 3)")
def flt4_score_threshold(spark, sf):
    v = vectors(spark, sf)
    found = dense.above_threshold(v, vector_queries(spark, sf), 0.5, 4).where("id <> query_id")
    return filters.above_or_top(found, 0.5, 3, id="id").select("query_id", "id", "rank")


@query("select quality >= 1 as relevant, count(*) as n from labels group by 1")
def flt5_relevance_threshold(spark, sf):
    return table(spark, sf, "labels").groupBy((F.col("quality") >= 1).alias("relevant")).agg(F.count("*").alias("n"))


@query("select doc_id from documents where doc_id in (select doc_id from labels where toxic = 1)")
def flt6_candidate_subset(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def flt7_exclusion(spark, sf):
    return filters.excluded(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("select conv_id, turn, regexp_matches(lower(text), '\\b(latest|current|newest|recent|now|today)\\b') as recent from conversations")
def flt8_recency_words(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lower("text").rlike("\\b(latest|current|newest|recent|now|today)\\b").alias("recent"))


# ---- metrics: relevant are the vectors with the query's label --------------------------------------------------------

JUDGED = VEC_CTE + ", j as (select query_id, id as doc_id, rank, score, (label = qlabel)::int * (1 + (id % 2)) as rel from top10), nrel as (select query_id, count(*) as n from sims where label = qlabel group by query_id)"


def judged_results(spark, sf):
    """The found rows with their relevance, from their own labels alone: no judgement is written out for a row that isn't found."""
    v, q = vectors(spark, sf), vector_queries(spark, sf)
    found = dense.vector_search(v, q).join(v.select("id", "label"), "id").join(q.select("query_id", "qlabel"), "query_id")
    rel = F.when(F.col("label") == F.col("qlabel"), 1 + F.col("id") % 2).otherwise(0)
    return found.select("query_id", F.col("id").alias("doc_id"), "score", "rank", rel.cast("int").alias("rel"))


def relevant_counts(spark, sf):
    """query_id, n: how many rows carry the query's label, counted by label."""
    n = vectors(spark, sf).groupBy(F.col("label").alias("qlabel")).agg(F.count("*").alias("n"))
    return vector_queries(spark, sf).join(n, "qlabel").select("query_id", "n")


def ideal_order(spark, sf, k=10):
    """query_id, doc_id, place of the first ``k`` relevant rows by id, ranked by label."""
    first = vectors(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("place") <= k)
    return vector_queries(spark, sf).join(first, F.col("label") == F.col("qlabel")).select("query_id", F.col("id").alias("doc_id"), "place")


@query(f"with {JUDGED} select query_id, sum((rank <= 5 and rel >= 1)::int) / 5 as p5, sum((rank <= 5 and rel >= 1)::int) / greatest(sum((rank <= 5)::int), 1) as p5_retrieved, sum((rank <= 10 and rel >= 2)::int) / 10 as p10_graded from j group by query_id")
def evl1_precision(spark, sf):
    j = judged_results(spark, sf)
    return j.groupBy("query_id").agg(metrics.precision(5).alias("p5"), metrics.precision(5, divisor="retrieved").alias("p5_retrieved"), metrics.precision(10, 2, "at_least_one").alias("p10_graded"))


@query(f"with {JUDGED} select query_id, round(sum((rank <= 5 and rel >= 1)::int) / max(n), 6) as r5, round(sum((rel >= 1)::int) / max(n), 6) as r10 from j join nrel using (query_id) group by query_id")
def evl2_recall(spark, sf):
    j, n = judged_results(spark, sf), relevant_counts(spark, sf)
    return j.join(n, "query_id").groupBy("query_id").agg(F.round(metrics.recall(5, F.col("n")), 6).alias("r5"), F.round(metrics.recall(10, F.col("n")), 6).alias("r10"))


@query(f"with {JUDGED} select query_id, coalesce(1 / min(case when rel >= 2 then rank end), 0) as rr, coalesce(1 / min(case when rel >= 2 and rank <= 3 then rank end), 0) as rr3 from j group by query_id")
def evl3_reciprocal_rank(spark, sf):
    return judged_results(spark, sf).groupBy("query_id").agg(metrics.reciprocal_rank(threshold=2).alias("rr"), metrics.reciprocal_rank(3, 2).alias("rr3"))


@query(f"with {JUDGED} select query_id, round(sum(rel / log2(rank + 1)), 6) as dcg from j group by query_id")
def evl4_dcg_linear(spark, sf):
    return judged_results(spark, sf).groupBy("query_id").agg(F.round(metrics.dcg("rank", 10, False), 6).alias("dcg"))


@query(f"with {JUDGED}, i as (select *, row_number() over (partition by query_id order by rel desc, rank) as ideal from j) select query_id, round(case when sum((pow(2, rel) - 1) / log2(ideal + 1)) = 0 then 1 else sum((pow(2, rel) - 1) / log2(rank + 1)) / sum((pow(2, rel) - 1) / log2(ideal + 1)) end, 6) as ndcg from i group by query_id")
def evl5_ndcg_exponential(spark, sf):
    return metrics.with_ideal(judged_results(spark, sf)).groupBy("query_id").agg(F.round(metrics.ndcg_retrieved(10), 6).alias("ndcg"))


@query(f"""with {JUDGED}, ideal as (select query_id, id as doc_id, row_number() over (partition by query_id order by id) as place from sims where label = qlabel), b as (select query_id, sum(case when place = 1 then 2.0 else 1.0 end / log2(place + 1)) as best from ideal where place <= 10 group by query_id),
  o as (select query_id, sum(case when place = 1 then 2.0 when place > 1 then 1.0 else 0.0 end / log2(rank + 1)) as dcg from j left join ideal using (query_id, doc_id) group by query_id) select query_id, round(dcg / best, 6) as ndcg from o join b using (query_id)""")
def evl6_ndcg_by_ideal_order(spark, sf):
    j, ideal = judged_results(spark, sf), ideal_order(spark, sf)
    later = j.where("rel > 0").join(ideal, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(11).alias("place"))
    return metrics.ndcg_by_ideal_order(j, ideal.union(later), 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"with {JUDGED}, h as (select *, (rel >= 1)::int as hit, sum((rel >= 1)::int) over (partition by query_id order by rank) as s from j) select query_id, round(coalesce(sum(hit * s / rank) / nullif(sum(hit), 0), 0), 6) as ap from h group by query_id")
def evl7_average_precision(spark, sf):
    return metrics.average_precision_retrieved(judged_results(spark, sf)).select("query_id", F.round("ap", 6).alias("ap"))


@query(f"""with {JUDGED}, i as (select *, row_number() over (partition by query_id order by rel desc, rank) as ideal, (rel >= 1)::int as hit, sum((rel >= 1)::int) over (partition by query_id order by rank) as s from j)
  select query_id, sum((rank <= 5)::int * hit) / 5 as precision, round(sum((rank <= 5)::int * hit) / max(n), 6) as recall, round(coalesce(sum(hit * s / rank) / nullif(sum(hit), 0), 0), 6) as ap, round(case when sum((pow(2, rel) - 1) / log2(ideal + 1)) = 0 then 1 else sum((pow(2, rel) - 1) / log2(rank + 1)) / sum((pow(2, rel) - 1) / log2(ideal + 1)) end, 6) as ndcg from i join nrel using (query_id) group by query_id""")
def evl8_context_metrics(spark, sf):
    j, n = judged_results(spark, sf), relevant_counts(spark, sf)
    one = metrics.with_ideal(j).join(n, "query_id").groupBy("query_id").agg(metrics.precision(5).alias("precision"), F.round(metrics.recall(5, F.col("n")), 6).alias("recall"), F.round(metrics.ndcg_retrieved(10), 6).alias("ndcg"))
    return one.join(metrics.average_precision_retrieved(j).select("query_id", F.round("ap", 6).alias("ap")), "query_id")


@query(f"with {JUDGED} select qlabel as pipeline, round(avg(p), 6) as precision, count(*) as n from (select query_id, sum((rank <= 5 and rel >= 1)::int) / 5 as p from j group by query_id) join (select distinct query_id, qlabel from sims) using (query_id) group by qlabel")
def evl9_macro_means(spark, sf):
    per = judged_results(spark, sf).groupBy("query_id").agg(metrics.precision(5).alias("p"))
    return per.join(vector_queries(spark, sf), "query_id").groupBy(F.col("qlabel").alias("pipeline")).agg(F.round(F.avg("p"), 6).alias("precision"), F.count("*").alias("n"))


@query(f"with {JUDGED}, a as (select 'p5' as metric, avg(p) as v from (select sum((rank <= 5 and rel >= 1)::int) / 5 as p from j group by query_id)), b as (select 'p5' as metric, avg(p) as v from (select sum((rel >= 1)::int) / 10 as p from j group by query_id)) select metric, round(b.v - a.v, 6) as delta, case when round(b.v - a.v, 6) < -0.03 then 'REGRESSION' when round(b.v - a.v, 6) > 0.03 then 'IMPROVEMENT' else 'stable' end as verdict from a join b using (metric)")
def evl15_compare_pipelines(spark, sf):
    j = judged_results(spark, sf)
    mean = lambda k: j.groupBy("query_id").agg(metrics.precision(k).alias("p")).agg(F.avg("p").alias("value")).select(F.lit("p5").alias("metric"), "value")
    return metrics.compared(mean(5), mean(10))


# ---- vector scalars --------------------------------------------------------------------------------------------------

PAIRS = "(select a.vec_id as id, list_transform(a.embedding, lambda x: x::double) as a, list_transform(b.embedding, lambda x: x::double) as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def neighbours(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b")), "id")


@query("select vec_id, list_transform(embedding, lambda x: round(2 * x::double / sqrt(list_dot_product(list_transform(embedding, lambda y: 2 * y::double), list_transform(embedding, lambda y: 2 * y::double))), 6)) as unit from embeddings")
def vec1_normalize(spark, sf):
    twice = F.transform("embedding", lambda x: x.cast("double") * 2)
    return table(spark, sf, "embeddings").select("vec_id", V.rounded(V.normalized(twice), 6).alias("unit"))


@query(f"select id, round(greatest(-1, least(1, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))))), 6) as cosine from {PAIRS}")
def vec2_cosine(spark, sf):
    return neighbours(spark, sf).select("id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query(f"select id, round(list_dot_product(a, b), 6) as dot, round(list_distance(a, b), 6) as euclid, round(1 / (1 + list_distance(a, b)), 6) as nearness, round(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) as cosine_distance from {PAIRS}")
def vec3_distances(spark, sf):
    a, b = F.col("a"), F.col("b")
    return neighbours(spark, sf).select("id", F.round(V.dot(a, b), 6).alias("dot"), F.round(V.euclidean(a, b), 6).alias("euclid"), F.round(V.nearness(a, b), 6).alias("nearness"), F.round(1 - V.cosine(a, b), 6).alias("cosine_distance"))


@query(f"select id, abs(list_distance(a, b) - sqrt(2 - 2 * list_dot_product(a, b))) < 1e-3 as holds from {PAIRS}")
def vec4_unit_identity(spark, sf):
    a, b = F.col("a"), F.col("b")
    return neighbours(spark, sf).select("id", (F.abs(V.euclidean(a, b) - F.sqrt(2 - 2 * V.dot(a, b))) < 1e-3).alias("holds"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), t as (select list_transform(list_zip(a.v, b.v, c.v), lambda z: z[1] - z[2] + z[3]) as w from e a, e b, e c where a.vec_id = 0 and b.vec_id = 1 and c.vec_id = 2),
  s as (select vec_id, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) as cosine from e, t) select * from s order by cosine desc, vec_id limit 10""")
def vec5_analogy(spark, sf):
    e = table(spark, sf, "embeddings")
    one = e.where("vec_id < 3").groupBy().agg(F.map_from_entries(F.collect_list(F.struct("vec_id", "embedding"))).alias("m"))
    target = one.select(V.analogy(F.element_at("m", F.lit(0).cast("long")), F.element_at("m", F.lit(1).cast("long")), F.element_at("m", F.lit(2).cast("long"))).alias("w"))
    s = e.join(F.broadcast(target)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("w")), 6).alias("cosine"))
    return s.orderBy(F.desc("cosine"), "vec_id").limit(10)


@query("""with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (select label, unnest(v) as x, generate_subscripts(v, 1) as i, vec_id from e), g as (select label, i, sum(x) as t, count(*) as n from s group by all),
  m as (select s.label, vec_id, (sum(x * t) - sum(x * x)) / greatest(max(n) - 1, 1) as mean from s join g using (label, i) group by all) select label, vec_id, round(mean, 6) as mean from (select *, row_number() over (partition by label order by round(mean, 9), vec_id) as r from m) where r = 1""")
def vec6_outlier(spark, sf):
    """The row of each label least similar to its others: mean of dot products = (v . (sum - v)) / (n - 1), without pairs."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    total = e.groupBy("label", "i").agg(F.sum("x").alias("t"), F.count("*").alias("n"))
    mean = e.join(total, ["label", "i"]).groupBy("label", "vec_id").agg(((F.sum(F.col("x") * F.col("t")) - F.sum(F.col("x") * F.col("x"))) / F.greatest(F.max("n") - 1, F.lit(1))).alias("mean"))
    low = mean.groupBy("label").agg(F.min(F.struct(F.round("mean", 9).alias("m"), "vec_id", "mean")).alias("b"))
    return low.select("label", "b.vec_id", F.round("b.mean", 6).alias("mean"))


@query(f"select case when c > 0.95 then 'near-identical' when c > 0.8 then 'very similar' when c > 0.5 then 'related' when c > 0.1 then 'weak' else 'unrelated' end as band, count(*) as n from (select list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) as c from {PAIRS}) group by band")
def vec7_similarity_bands(spark, sf):
    return neighbours(spark, sf).groupBy(V.similarity_band(V.cosine(F.col("a"), F.col("b"))).alias("band")).agg(F.count("*").alias("n"))


@query(f"select id, round(list_dot_product(c, b) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(b, b))), 6) as cosine, round(list_dot_product(c, b), 5) as dot, abs(list_dot_product(c, b) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(b, b))) - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))) < 1e-6 as invariant from (select *, list_transform(a, lambda x: x * 7) as c from {PAIRS})")
def vec8_magnitude(spark, sf):
    """A vector seven times as long: the dot product follows, the cosine stays."""
    a, b = F.transform("a", lambda x: x.cast("double")), F.col("b")
    c = F.transform(a, lambda x: x * 7)
    return neighbours(spark, sf).select("id", F.round(V.cosine(c, b), 6).alias("cosine"), F.round(V.dot(c, b), 5).alias("dot"), (F.abs(V.cosine(c, b) - V.cosine(a, b)) < 1e-6).alias("invariant"))
