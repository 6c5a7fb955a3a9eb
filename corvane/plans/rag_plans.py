"""Grounding, reranking, query understanding, routing, cost, numerics, approximate search and streams over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import embeddings as E
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import ann, cost, dense, numerics
from corvane.operators import grounding as G
from corvane.operators import query as Q
from corvane.plans.registry import query, table
from corvane.plans.retrieval_plans import BOTH, VEC_CTE, both_lists, vector_queries, vectors
from corvane.plans.text_plans import ANSWERS, WORDS, answers
from corvane.sources.tables import kept, written
from corvane.streaming.windows import event_windows, sessions


def cw(column, least=3):
    return f"list_distinct(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]{{{least},}}'))"


def ent(claim, context, least=4):
    c, x = cw(claim, least), cw(context, least)
    return f"case when len({c}) > 0 then len(list_intersect({c}, {x})) / len({c}) else 0 end"


CLAIMS = "list_filter(list_transform(string_split(regexp_replace(regexp_replace({a}, '\\[Chunk\\d+\\]|\\[unsupported\\]|\\[source:[^\\]]+\\]', '', 'g'), '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))), lambda s: length(s) > {n})"
DIALOG = "(select conv_id, turn, text as answer, lag(text) over (partition by conv_id order by turn) as context from conversations)"


def dialog(spark, sf):
    """Every turn as an answer with the turn before as its context."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("answer"), F.lag("text").over(w).alias("context")).where("context is not null")


@query(f"select conv_id, turn, round({ent('answer', 'context')}, 6) as score from {DIALOG} where context is not null")
def grd1_entailment(spark, sf):
    return dialog(spark, sf).select("conv_id", "turn", F.round(G.entailment(F.col("answer"), F.col("context")), 6).alias("score"))


def grounded_sql(threshold, n, none, verdict):
    return f"""with c as (select conv_id, turn, context, {CLAIMS.format(a='answer', n=n)} as cl from {DIALOG} where context is not null), j as (select conv_id, turn, len(cl) as n_claims, len(list_filter(cl, lambda s: {ent('s', 'context')} >= {threshold})) as n_supported from c),
  s as (select *, case when n_claims > 0 then round(n_supported / n_claims, 6) else {none} end as score from j) select conv_id, turn, n_claims, n_supported, score, {verdict} as verdict from s"""


@query(grounded_sql(0.3, 15, 1.0, "case when score >= 0.8 then 'grounded' when score >= 0.5 then 'partial' else 'hallucinated' end"))
def grd2_answer_grounding(spark, sf):
    g = G.grounded_answers(dialog(spark, sf), ["conv_id", "turn"], "answer", "context")
    return g.withColumn("verdict", G.graded(F.col("score"), 0.8, 0.5, ("grounded", "partial", "hallucinated")))


@query(f"select conv_id, turn, len(t) as n_tags, len(list_distinct(t)) as n_sources, round(len(list_filter(t, lambda x: x <> 'unsupported')) / greatest(len(t), 1), 6) as supported from (select conv_id, turn, regexp_extract_all(answer, '\\[source:([^\\]]+)\\]', 1) as t from {ANSWERS})")
def grd3_attribution(spark, sf):
    return G.attribution(answers(spark, sf), ["conv_id", "turn"], "answer")


@query("""with v as (select conv_id, text, count(*) as n, min(turn) as first, sum(count(*)) over (partition by conv_id) as total from conversations group by conv_id, text), b as (select *, row_number() over (partition by conv_id order by n desc, first) as r from v)
  select conv_id, round(n / total, 6) as agreement, case when n / total >= 0.8 then 'consistent' when n / total >= 0.6 then 'mixed' else 'inconsistent' end as verdict from b where r = 1""")
def grd4_self_consistency(spark, sf):
    w = Window.partitionBy("conv_id")
    v = table(spark, sf, "conversations").groupBy("conv_id", "text").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    b = v.withColumns({"share": F.col("n") / F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "first"))}).where("r = 1")
    return b.select("conv_id", F.round("share", 6).alias("agreement"), G.graded(F.col("share"), 0.8, 0.6, ("consistent", "mixed", "inconsistent")).alias("verdict"))


@query(grounded_sql(0.3, 20, 0.0, "case when score >= 0.8 then 'pass' else 'fail' end"))
def grd5_faithfulness(spark, sf):
    g = G.grounded_answers(dialog(spark, sf), ["conv_id", "turn"], "answer", "context", 0.30, 20, 0.0)
    return g.withColumn("verdict", F.when(F.col("score") >= 0.8, "pass").otherwise("fail"))


@query(grounded_sql(0.25, 15, 1.0, "case when score >= 0.7 then 'PASS' when score >= 0.4 then 'WARN' else 'FAIL' end"))
def grd6_pipeline_faithfulness(spark, sf):
    g = G.grounded_answers(dialog(spark, sf), ["conv_id", "turn"], "answer", "context", 0.25)
    return g.withColumn("verdict", G.graded(F.col("score"), 0.7, 0.4, ("PASS", "WARN", "FAIL")))


@query(f"select conv_id, turn, unnest({CLAIMS.format(a='answer', n=15)}) as claim from {ANSWERS}")
def grd7_extract_claims(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", F.explode(G.claims(F.col("answer"))).alias("claim"))


@query(f"""with c as (select conv_id, turn, context, {CLAIMS.format(a='answer', n=15)} as cl from {DIALOG} where context is not null), e as (select conv_id, turn, context, unnest(cl) as claim, generate_subscripts(cl, 1) - 1 as claim_no from c),
  cx as (select conv_id, turn, claim_no, claim, list_filter(list_transform(string_split(regexp_replace(context, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda y: trim(regexp_replace(y, '^\\s+|\\s+$', '', 'g'))), lambda y: length(y) > 0) as ctx from e),
  m as (select conv_id, turn, claim_no, list_max(list_transform(ctx, lambda x, i: {{v: round({ent('claim', 'x')}, 9), o: -i, t: x}})) as b from cx) select conv_id, turn, claim_no, case when b.v > 0 then b.t end as match, round(case when b.v > 0 then b.v else 0 end, 6) as score from m""")
def grd8_best_context_match(spark, sf):
    return G.best_match(dialog(spark, sf), ["conv_id", "turn"], "answer", "context")


@query(grounded_sql(0.3, 15, 1.0, "case when score >= 0.8 then 'pass' when score >= 0.5 then 'warn' else 'fail' end"))
def grd9_hallucination_check(spark, sf):
    g = G.grounded_answers(dialog(spark, sf), ["conv_id", "turn"], "answer", "context")
    return g.withColumn("verdict", G.graded(F.col("score"), 0.8, 0.5, ("pass", "warn", "fail")))


STOPLIST = ("the", "and", "that", "with", "this", "are", "was", "for")
STOP_SQL = "list_filter(" + cw("answer") + ", lambda t: t not in (" + ", ".join(f"'{w}'" for w in STOPLIST) + "))"


@query(f"select conv_id, turn, case when len({STOP_SQL}) = 0 then true else len(list_intersect({STOP_SQL}, {cw('context')})) / len({STOP_SQL}) >= 0.35 end as entailed from {DIALOG} where context is not null")
def grd10_lexical_entailment(spark, sf):
    claim = T.content_words(F.col("answer"), 3, STOPLIST)
    return dialog(spark, sf).select("conv_id", "turn", F.when(F.size(claim) == 0, True).otherwise(G.containment(claim, T.content_words(F.col("context"))) >= 0.35).alias("entailed"))


@query(f"select verdict, count(*) as n from (select case when s >= 0.6 then 'supported' when s >= 0.25 then 'weak' else 'not_in_context' end as verdict from (select {ent('answer', 'context', 3)} as s from {DIALOG} where context is not null)) group by verdict")
def grd11_verify_claims(spark, sf):
    s = G.entailment(F.col("answer"), F.col("context"), 3)
    return dialog(spark, sf).groupBy(G.graded(s, 0.6, 0.25, ("supported", "weak", "not_in_context")).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"select conv_id, turn, contains(answer, '[source:doc0]') as cites_doc0, regexp_matches(lower(answer), 'not sure|unclear|may be|cannot') as uncertain from {ANSWERS}")
def grd12_citation_usage(spark, sf):
    a = F.col("answer")
    return answers(spark, sf).select("conv_id", "turn", a.contains("[source:doc0]").alias("cites_doc0"), F.lower(a).rlike("not sure|unclear|may be|cannot").alias("uncertain"))


# ---- reranking: the candidates of the lexical list, their cosine taken from the pairing of documents and vectors -------

CAND = BOTH + f""", cand as (select b.query_id, b.doc_id, b.rank, q.text as query, d.text as doc, coalesce(list_dot_product(v, qv.q), 0) as cosine from bm25_top b join benchmark q on q.item_id = b.query_id join documents d using (doc_id) left join qv using (query_id) left join vecs on vecs.id = doc_id),
  parts as (select *, case when len({cw('query')}) > 0 then len(list_intersect({cw('query')}, {cw('doc')})) / len({cw('query')}) else 0.5 end as overlap, len(string_split_regex(doc, '\\s+')) as len from cand)"""


def candidates(spark, sf):
    lex, _ = both_lists(spark, sf)
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("doc"))
    v = vectors(spark, sf)
    j = lex.join(q, "query_id").join(d, "doc_id").join(v.select(F.col("id").alias("query_id"), F.col("vector").alias("qv")), "query_id", "left").join(v.select(F.col("id").alias("doc_id"), "vector"), "doc_id", "left")
    cos = F.coalesce(V.dot(F.col("vector"), V.normalized(F.col("qv"))), F.lit(0.0))
    return j.select("query_id", "doc_id", "rank", "doc", cos.alias("cosine"), G.term_overlap(F.col("query"), F.col("doc")).alias("overlap"))


@query(f"with {CAND} select query_id, doc_id, round(overlap, 6) as overlap from parts")
def rrk1_term_overlap(spark, sf):
    return candidates(spark, sf).select("query_id", "doc_id", F.round("overlap", 6).alias("overlap"))


@query(f"with {CAND} select query_id, doc_id, round(greatest(0, least(1, 0.5 * cosine + 0.35 * overlap + 0.15 * least(1, len / 80))), 6) as score from parts")
def rrk2_cross_encoder_score(spark, sf):
    return candidates(spark, sf).select("query_id", "doc_id", F.round(G.cross_encoder_score(F.col("cosine"), F.col("overlap"), F.col("doc")), 6).alias("score"))


SCORED = CAND + ", scored as (select *, round(greatest(0, least(1, 0.45 * cosine + 0.4 * overlap + 0.15 * least(1, len / 100))), 6) as score from parts)"


@query(f"with {SCORED} select query_id, doc_id, score from scored")
def rrk3_rerank_score(spark, sf):
    return candidates(spark, sf).select("query_id", "doc_id", F.round(G.rerank_score(F.col("cosine"), F.col("overlap"), F.col("doc")), 6).alias("score"))


@query(f"with {SCORED} select query_id, doc_id, score, rank as old_rank, r as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from scored) where r <= 5")
def rrk4_rerank(spark, sf):
    c = candidates(spark, sf).withColumn("score", F.round(G.rerank_score(F.col("cosine"), F.col("overlap"), F.col("doc")), 6))
    return G.reranked(c, "score", 5).select("query_id", "doc_id", "score", "old_rank", "rank")


@query(f"with {SCORED} select query_id, doc_id, score, r as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from scored where score >= 0.3) where r <= 5")
def rrk5_threshold_rerank(spark, sf):
    c = candidates(spark, sf).withColumn("score", F.round(G.rerank_score(F.col("cosine"), F.col("overlap"), F.col("doc")), 6))
    return G.reranked(c, "score", 5, 0.3).select("query_id", "doc_id", "score", "rank")


@query("select doc_id, lang || ' ' || source || ' ' || text as document from documents")
def rrk6_structured_document(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "lang", "source", "text").alias("document"))


POINT = CAND + ", point as (select *, greatest(1, least(10, trunc(round(10 * (0.5 * cosine + 0.5 * overlap) + 1, 9))::int)) as score from parts)"


@query(f"with {POINT} select query_id, doc_id, score, case when score >= 8 then 'directly relevant' when score >= 5 then 'partly relevant' else 'hardly relevant' end as reason from point")
def rrk7_pointwise_judge(spark, sf):
    s = G.pointwise_score(F.round(F.col("cosine"), 12), F.round(F.col("overlap"), 12))
    return candidates(spark, sf).select("query_id", "doc_id", s.alias("score"), G.pointwise_reason(s).alias("reason"))


@query(f"with {POINT} select query_id, doc_id, score / 10 as score, r as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from point where score >= 4) where r <= 5")
def rrk8_pointwise_rerank(spark, sf):
    c = candidates(spark, sf).withColumn("score", G.pointwise_score(F.col("cosine"), F.col("overlap")))
    return G.reranked(c, "score", 5, 4).select("query_id", "doc_id", (F.col("score") / 10).alias("score"), "rank")


@query(f"with {POINT} select query_id, doc_id, row_number() over (partition by query_id order by score desc, rank) as place from point")
def rrk9_listwise(spark, sf):
    c = candidates(spark, sf).withColumn("score", G.pointwise_score(F.col("cosine"), F.col("overlap")))
    return c.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")).alias("place"))


@query(f"""with {SCORED}, j as (select s.query_id, doc_id, rank, row_number() over (partition by s.query_id order by score desc, doc_id) as new_rank, coalesce(quality, 0) as rel from scored s left join labels using (doc_id))
  select query_id, sum((rank <= 5)::int * rel) / 5 as before, sum((new_rank <= 5)::int * rel) / 5 as after from j group by query_id""")
def rrk10_two_stage(spark, sf):
    c = candidates(spark, sf).withColumn("score", F.round(G.rerank_score(F.col("cosine"), F.col("overlap"), F.col("doc")), 6))
    c = c.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    j = c.join(table(spark, sf, "labels"), "doc_id", "left").withColumn("rel", F.coalesce("quality", F.lit(0)))
    at5 = lambda r: (F.sum(F.when(F.col(r) <= 5, F.col("rel")).otherwise(0)) / 5)
    return j.groupBy("query_id").agg(at5("rank").alias("before"), at5("new_rank").alias("after"))


@query(f"select conv_id, turn, round(case when len({cw('context')}) = 0 then 1 else greatest(0, least(1, 0.5 * len(list_intersect({cw('context')}, {cw('answer')})) / len({cw('context')}) + 0.5 * 0.5)) end, 6) as relevance from {DIALOG} where context is not null")
def evl12_answer_relevance(spark, sf):
    return dialog(spark, sf).select("conv_id", "turn", F.round(G.answer_relevance(F.col("context"), F.col("answer"), F.lit(0.5)), 6).alias("relevance"))


@query(f"select conv_id, turn, round(len(list_filter(cl, lambda s: {ent('s', 'context')} >= 0.4)) / greatest(len(cl), 1), 6) as faithfulness from (select conv_id, turn, context, {CLAIMS.format(a='answer', n=0)} as cl from {DIALOG} where context is not null)")
def evl11_lexical_faithfulness(spark, sf):
    ok = F.filter(G.claims(F.col("answer"), 0), lambda s: G.entailment(s, F.col("context")) >= 0.4)
    return dialog(spark, sf).select("conv_id", "turn", F.round(F.size(ok) / F.greatest(F.size(G.claims(F.col("answer"), 0)), F.lit(1)), 6).alias("faithfulness"))


# ---- queries -----------------------------------------------------------------------------------------------------------

PHRASES = ("what is bgp?", "How do I configure it and what then?", "Compare A vs B and C", "CVE-2024-12345 fixed in 5.2.1?", "which are not affected", "calculate 4 * 12 total", "is our gateway currently down? why?", "latest version 6.2 ticket", "explain the protocol")


def phrased(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("turn") % len(PHRASES) + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(phrase, F.lit(" "), "text").alias("q"))


PHRASED = "(select conv_id, turn, [" + ", ".join(f"'{p}'" for p in PHRASES) + f"][turn % {len(PHRASES)} + 1] || ' ' || text as q from conversations)"


def type_sql(low="lower(q)"):
    rows = []
    for name, (patterns, _) in Q.TYPES.items():
        flag = "(?i)" if name == "exact_term" else ""
        rows.append("when " + " or ".join(f"regexp_matches({low}, '{flag}{p}')" for p in patterns) + f" then '{name}'")
    return "case " + " ".join(rows) + " else 'general' end"


ASKED = "list_transform(list_filter(list_transform(string_split(q, '?'), lambda p: trim(p)), lambda p: length(p) > 0), lambda p: p || '?')"
CUT = "regexp_extract(q, '(?s)^(.*?)\\s+and\\s+(.*)$', ['a', 'b'])"
SUB_QUESTIONS = f"case when contains(q, '?') then case when len({ASKED}) > 1 then {ASKED} else []::varchar[] end when contains(lower(q), ' and ') and query_type in ('multi_hop', 'comparative') and regexp_matches(q, '(?s)^(.*?)\\s+and\\s+(.*)$') then [trim(({CUT}).a) || '?', 'And ' || trim(({CUT}).b) || '?'] else []::varchar[] end"
IDENTIFIERS = "list_concat(regexp_extract_all(q, '(?i)CVE-\\d{4}-\\d+'), list_concat(regexp_extract_all(q, '(?i)CSC[a-z]{2}\\d+'), list_concat(regexp_extract_all(q, '\\b\\d+\\.\\d+\\.\\d+\\b'), regexp_extract_all(q, '(?i)\\bN[0-9]K-[A-Z0-9-]+\\b'))))"


@query(f"""with t as (select *, {type_sql()} as query_type, len({WORDS.replace('text', 'q')}) as word_count from {PHRASED}), c as (select *, round(least(1.0, (word_count <= 4)::int * 0.3 + (word_count >= 20)::int * 0.2 + ((length(lower(q)) - length(replace(lower(q), ' and ', ''))) / 5 >= 2)::int * 0.3
  + regexp_matches(lower(q), '\\band\\s+what\\b|\\band\\s+how\\b')::int * 0.4 + regexp_matches(q, '\\?.*\\?')::int * 0.4 + (query_type = 'multi_hop')::int * 0.3 + (query_type = 'comparative')::int * 0.2), 6) as complexity from t)
  select conv_id, turn, query_type, complexity::double as complexity, query_type not in ('exact_term', 'negation') and complexity >= 0.1 as needs_rewrite, word_count, case query_type when 'exact_term' then 'PASSTHROUGH' when 'negation' then 'PASSTHROUGH' when 'comparative' then 'DECOMPOSE' when 'multi_hop' then 'DECOMPOSE' when 'procedural' then 'HYDE' when 'factual' then 'HYDE' else 'MULTI_QUERY' end as technique, array_to_string({SUB_QUESTIONS}, ' | ') as sub_questions, array_to_string({IDENTIFIERS}, ' ') as exact_terms from c""")
def qry1_analyze_query(spark, sf):
    a = Q.analysis(F.col("q"))
    return phrased(spark, sf).select("conv_id", "turn", *[a[k].alias(k) for k in ("query_type", "complexity", "needs_rewrite", "word_count", "technique")], F.array_join(a["sub_questions"], " | ").alias("sub_questions"), F.array_join(a["exact_terms"], " ").alias("exact_terms"))


@query(f"with t as (select *, {type_sql()} as k from {PHRASED}) select conv_id, turn, round(least(1.0, (len({WORDS.replace('text', 'q')}) <= 4)::int * 0.3 + contains(lower(q), ' and ')::int * 0.3 + regexp_matches(q, '\\?.*\\?')::int * 0.4 + (k in ('multi_hop', 'comparative'))::int * 0.2), 6)::double as complexity from t")
def qry2_optimizer_analysis(spark, sf):
    q = F.col("q")
    return phrased(spark, sf).select("conv_id", "turn", Q.optimizer_complexity(q, Q.query_type(q)).alias("complexity"))


@query(f"with v as (select list(distinct w) as v from (select unnest({cw('text')}) as w from benchmark)) select conv_id, turn, round(case when len(w) = 0 then 0.5 else 1 - len(list_intersect(w, v)) / len(w) end, 6) as gap from (select conv_id, turn, list_filter({cw('q')}, lambda t: t not in ({', '.join(repr(w) for w in Q.GAP_STOPWORDS)})) as w from {PHRASED}), v")
def qry3_vocabulary_gap(spark, sf):
    """The query's words against a vocabulary table, by a join: no vocabulary is collected."""
    vocab = table(spark, sf, "benchmark").select(F.explode(T.content_words(F.col("text"))).alias("w")).distinct().withColumn("known", F.lit(1))
    q = phrased(spark, sf).select("conv_id", "turn", F.explode_outer(T.content_words(F.col("q"), 3, Q.GAP_STOPWORDS)).alias("w"))
    g = q.join(vocab, "w", "left").groupBy("conv_id", "turn").agg(F.count("w").alias("n"), F.count("known").alias("k"))
    return g.select("conv_id", "turn", F.round(F.when(F.col("n") == 0, 0.5).otherwise(1 - F.col("k") / F.greatest("n", F.lit(1))), 6).alias("gap"))


def any_sql(parts, low="lower(q)"):
    return "(" + " or ".join(f"contains({low}, '{p}')" for p in parts) + ")"


@query(f"select conv_id, turn, {any_sql(Q.NEEDS['needs_retrieval'])} as needs_retrieval, {any_sql(Q.NEEDS['needs_realtime'])} as needs_realtime, {any_sql(Q.NEEDS['needs_tool'])} or regexp_matches(lower(q), '{Q.ARITHMETIC}') as needs_tool, not {any_sql(Q.NOT_GENERAL)} as is_general from {PHRASED}")
def qry4_classify_query(spark, sf):
    return phrased(spark, sf).select("conv_id", "turn", *[c.alias(k) for k, c in Q.needs(F.col("q")).items()])


@query(f"""with s as (select conv_id, turn, len(list_filter(regexp_extract_all(q, '\\b(202[3-9]|203\\d)\\b', 1), lambda y: make_date(y::int, 1, 1) > date '2024-04-01')) + {any_sql(Q.RECENCY)}::int + len(regexp_extract_all(q, '\\b\\d+\\.\\d+(?:\\.\\d+)?\\b')) as soft, regexp_matches(q, '(?i)CVE-\\d{{4}}-\\d+')::int + regexp_matches(q, '(?i)CSC[a-z]{{2}}\\d+')::int + {any_sql(Q.PRIVATE)}::int as hard from {PHRASED})
  select conv_id, turn, soft + hard as n_signals, case when hard > 0 then 'critical' when soft >= 2 then 'high' when soft = 1 then 'medium' else 'low' end as risk from s""")
def qry5_cutoff_risk(spark, sf):
    r = Q.cutoff_risk(F.col("q"), F.make_date(F.lit(2024), F.lit(4), F.lit(1)))
    return phrased(spark, sf).select("conv_id", "turn", r["n_signals"].alias("n_signals"), r["risk"].alias("risk"))


#: Letters beyond ASCII are letters at a word's edge, too; DuckDB's patterns don't take them for such.
EDGED = "regexp_replace(lower(q), '[^\\x00-\\x7F×≤≥]', 'x', 'g')"
SIGNALS = "list_filter([" + ", ".join("case when " + " or ".join(f"regexp_matches({EDGED}, '(?i){p}')" for p in pats) + f" then '{k}' end" for k, (_, pats) in Q.ROUTES.items()) + "], lambda x: x is not null)"
ROUTE_SQL = """case when len(s) = 0 then 'parametric' when len(list_filter(s, lambda x: x not in ('arithmetic', 'negation_filter', 'constraint_filter'))) = 0 then 'tool' when list_has_any(s, ['knowledge_cutoff', 'private_data']) and list_contains(s, 'realtime_data') then 'hybrid'
  when list_contains(s, 'realtime_data') then case when list_has_any(s, ['arithmetic', 'negation_filter', 'constraint_filter']) then 'hybrid' else 'realtime-rag' end when list_has_any(s, ['knowledge_cutoff', 'private_data']) then 'static-rag' else 'parametric' end"""


@query(f"select conv_id, turn, array_to_string({SIGNALS}, ',') as signals from {PHRASED}")
def qry6_route_signals(spark, sf):
    return phrased(spark, sf).select("conv_id", "turn", F.array_join(Q.route_signals(F.col("q")), ",").alias("signals"))


@query(f"select conv_id, turn, {ROUTE_SQL} as route from (select conv_id, turn, {SIGNALS} as s from {PHRASED})")
def qry7_route(spark, sf):
    return phrased(spark, sf).select("conv_id", "turn", Q.route_signals(F.col("q")).alias("s")).select("conv_id", "turn", Q.route(F.col("s")).alias("route"))


STATIC, LIVE = "r in ('static-rag', 'hybrid')", "r in ('realtime-rag', 'hybrid')"
PRIVATE = f"({STATIC} and (list_contains(s, 'private_data') or {any_sql(('our', 'internal'))}))"
PUBLIC = f"({STATIC} and list_contains(s, 'knowledge_cutoff'))"
FAULT, NODE, TICKET = (f"({LIVE} and {any_sql(w)})" for w in (("fault", "alert", "alarm", "active"), ("up", "down", "status", "reachable"), ("ticket", "incident")))


def steps_sql(pairs):
    return "list_filter([" + ", ".join(f"case when {c} then '{name}' end" for name, c in pairs) + "], lambda x: x is not null)"


STEPS = steps_sql([("private knowledge base", PRIVATE), ("public documentation since 2024", PUBLIC), ("primary knowledge base", f"{STATIC} and not {PRIVATE} and not {PUBLIC}"), ("live: faults", FAULT), ("live: node health", NODE), ("live: incidents", TICKET), ("live: system data", f"{LIVE} and not {FAULT} and not {NODE} and not {TICKET}")])
TOOLS = steps_sql([("arithmetic", "list_contains(s, 'arithmetic')"), ("set difference", "list_contains(s, 'negation_filter')"), ("constraint filter", "list_contains(s, 'constraint_filter')")])
CONFIDENCE = "case when len(s) <= 1 then 'high' when len(s) <= 3 then 'medium' else 'low' end"


@query(f"select conv_id, turn, {CONFIDENCE} as confidence, array_to_string({STEPS}, '; ') as retrieval, array_to_string({TOOLS}, '; ') as tools from (select *, {ROUTE_SQL} as r from (select conv_id, turn, q, {SIGNALS} as s from {PHRASED}))")
def qry8_route_plan(spark, sf):
    p = phrased(spark, sf).select("conv_id", "turn", "q", Q.route_signals(F.col("q")).alias("s"))
    plan = Q.route_plan(F.col("q"), F.col("s"), Q.route(F.col("s")))
    return p.select("conv_id", "turn", plan["confidence"].alias("confidence"), F.array_join(plan["retrieval"], "; ").alias("retrieval"), F.array_join(plan["tools"], "; ").alias("tools"))


@query("select event_id, coalesce(tier, 'medium') as tier from events left join (values ('view', 'small'), ('click', 'small'), ('purchase', 'large')) t(event_type, tier) using (event_type)")
def qry9_model_routing(spark, sf):
    tiers = spark.createDataFrame([("view", "small"), ("click", "small"), ("purchase", "large")], "event_type string, tier string")
    return table(spark, sf, "events").join(tiers, "event_type", "left").select("event_id", F.coalesce("tier", F.lit("medium")).alias("tier"))


@query(f"with e as (select a.vec_id as id, list_transform(list_zip(a.embedding, b.embedding), lambda z: 0.3 * z[1]::double + 0.7 * z[2]::double) as f from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select id, list_transform(f, lambda x: round(x / sqrt(list_dot_product(f, f)), 6)) as fused from e")
def qry10_hyde_fusion(spark, sf):
    e = table(spark, sf, "embeddings")
    j = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b")), "id")
    f = F.zip_with("a", "b", lambda x, y: 0.3 * x.cast("double") + 0.7 * y.cast("double"))
    return j.select("id", f.alias("f")).select("id", V.rounded(V.normalized(F.col("f")), 6).alias("fused"))


@query(f"select conv_id, turn, unnest(['Explain: ' || q, 'Details about ' || q, q || ' overview']) as variant from {PHRASED}")
def qry11_paraphrases(spark, sf):
    return phrased(spark, sf).select("conv_id", "turn", F.explode(Q.paraphrases(F.col("q"))).alias("variant"))


@query(f"select conv_id, turn, unnest(case when contains(q, ' and ') then [trim(q[1:strpos(q, ' and ') - 1]), trim(q[strpos(q, ' and ') + 5:])] else [trim(q)] end) as part from {PHRASED}")
def qry12_decompose(spark, sf):
    return phrased(spark, sf).select("conv_id", "turn", F.explode(Q.decomposed(F.col("q"))).alias("part"))


@query(f"with {VEC_CTE}, v as (select query_id, id, rank, 1 as variant from top10 where rank <= 5 union all select query_id, id, row_number() over (partition by query_id order by label, id), 2 from top10) select query_id, count(distinct id) as n_unique, round(sum(1 / (60 + rank)), 9) as mass from v group by query_id")
def ret19_multi_query(spark, sf):
    found = dense.vector_search(vectors(spark, sf), vector_queries(spark, sf)).join(vectors(spark, sf).select("id", "label"), "id")
    two = found.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("label", "id")).alias("rank"))
    both = found.where("rank <= 5").select("query_id", "id", "rank").union(two)
    return both.groupBy("query_id").agg(F.countDistinct("id").alias("n_unique"), F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("mass"))


# ---- cost --------------------------------------------------------------------------------------------------------------

PRICES = "(values " + ", ".join(str(p) for p in cost.PRICES) + ") p(model, input, output, cache_write, cache_read, win)"


def prices(spark):
    return spark.createDataFrame(cost.PRICES, cost.PRICE_SCHEMA)


USAGE = "(select conv_id, turn, case when role = 'user' then 'small' when role = 'system' then 'other' else 'large' end as model, length(text) * 10 as n_in, length(text) as n_out from conversations)"


@query(f"select conv_id, turn, round((n_in * coalesce(input, 0) + n_out * coalesce(output, 0)) / 1000000, 6) as cost from {USAGE} left join {PRICES} using (model)")
def cst1_estimate_cost(spark, sf):
    n = F.length("text")
    u = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "small").when(F.col("role") == "system", "other").otherwise("large").alias("model"), (n * 10).alias("n_in"), n.alias("n_out"))
    return cost.estimated_cost(u, prices(spark)).select("conv_id", "turn", "cost")


GRID = "(select unnest([500, 2000, 8000, 30000]) as n_in), (select unnest([0, 1000, 4000]) as cached)"


def grid(spark):
    g = spark.range(1).select(F.explode(F.array(*map(F.lit, (500, 2000, 8000, 30000)))).alias("n_in"))
    return prices(spark).join(g.select("n_in", F.explode(F.array(*map(F.lit, (0, 1000, 4000)))).alias("cached")), F.lit(True))


ONE = "(greatest(n_in - cached - cached // 2, 0) * input + 400 * output + cached * cache_write + cached // 2 * cache_read) / 1000000"


@query(f"select model, n_in, cached, round({ONE}, 9) as cost from {PRICES}, {GRID}")
def cst2_cost_per_query(spark, sf):
    c = cost.query_cost(F.col("n_in"), F.lit(400), F.col("cached"), F.floor(F.col("cached") / 2))
    return grid(spark).select("model", "n_in", "cached", F.round(c, 9).alias("cost"))


@query(f"select model, n_in, cached, round({ONE} * 1000 * 30, 6) as monthly, round({ONE} * 1000, 6) as per_thousand from {PRICES}, {GRID}")
def cst3_monthly_cost(spark, sf):
    c = cost.query_cost(F.col("n_in"), F.lit(400), F.col("cached"), F.floor(F.col("cached") / 2))
    return grid(spark).select("model", "n_in", "cached", F.round(cost.monthly(c, F.lit(1000)), 6).alias("monthly"), F.round(c * 1000, 6).alias("per_thousand"))


@query(f"select model, n_in, cached, round(case when n_in >= 1024 then (30 * n_in * cache_write + (30000 - 30) * n_in * cache_read) / 1000000 else 30000 * n_in * input / 1000000 end + 30000 * (cached * input + 400 * output) / 1000000, 6) as plan from {PRICES}, {GRID}")
def cst4_cached_plan(spark, sf):
    c = cost.cached_plan_cost(F.col("n_in"), F.col("cached"), F.lit(400), F.lit(1000))
    return grid(spark).select("model", "n_in", "cached", F.round(c, 6).alias("plan"))


@query(f"select model, ceil(round((cache_write - input) / (input - cache_read), 9))::bigint as reads from {PRICES}")
def cst5_break_even(spark, sf):
    return prices(spark).select("model", cost.break_even().alias("reads"))


@query("select lang, round(sum(length(text) // 4) * 0.06 / 1000000, 9) as cost, count(*) * 1024 * 4 as bytes from documents group by lang")
def cst6_embedding_cost(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang").agg(F.sum(F.floor(F.length("text") / 4)).alias("t"), F.count("*").alias("n"))
    return d.select("lang", F.round(F.col("t") * 0.06 / cost.MILLION, 9).alias("cost"), cost.storage_bytes(F.col("n"), F.lit(1024)).alias("bytes"))


@query("with l as (select lang, avg(length(text) // 4 + 1) as t, sum(length(text)) / sum(length(text) // 4 + 1) as cpt from documents group by lang) select lang, round(t / (select t from l where lang = 'en'), 6) as ratio, round(cpt, 6) as chars_per_token, floor(4000 / t)::bigint as fits from l")
def cst7_language_efficiency(spark, sf):
    t = F.floor(F.length("text") / 4) + 1
    l = table(spark, sf, "documents").groupBy("lang").agg(F.avg(t).alias("t"), (F.sum(F.length("text")) / F.sum(t)).alias("cpt"))  # noqa: E741
    base = l.where("lang = 'en'").select(F.col("t").alias("base"))
    return l.join(F.broadcast(base), F.lit(True)).select("lang", F.round(F.col("t") / F.col("base"), 6).alias("ratio"), F.round("cpt", 6).alias("chars_per_token"), F.floor(4000 / F.col("t")).alias("fits"))


@query(f"select model, fill, round(fill * input / 1000000, 6) as per_call, round(fill * input / 1000000 * 500, 6) as per_day from {PRICES}, (select unnest([10000, 100000, 500000]) as fill) where fill <= win")
def cst8_context_fill(spark, sf):
    f = spark.createDataFrame([(10000,), (100000,), (500000,)], "fill int")
    c = F.col("fill") * F.col("input") / cost.MILLION
    return prices(spark).join(f, F.col("fill") <= F.col("window")).select("model", "fill", F.round(c, 6).alias("per_call"), F.round(c * 500, 6).alias("per_day"))


@query("select l_orderkey, sum(l_quantity * l_linenumber) as total from lineitem group by l_orderkey")
def cst9_weighted_sum(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") * F.col("l_linenumber")).alias("total"))


# ---- numerics ----------------------------------------------------------------------------------------------------------


@query("select w, count(*) as freq from (select unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: length(x) > 0)) as w from benchmark) group by w")
def agg13_word_frequencies(spark, sf):
    v = numerics.word_frequencies(table(spark, sf, "benchmark"))
    return v.select(F.regexp_replace(F.array_join("symbols", ""), "</w>$", "").alias("w"), "freq")


PAIR = """with w as (select w, count(*) as freq from (select unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: length(x) > 0)) as w from benchmark) group by w), s as (select list_append(string_split(w, ''), '</w>') as s, freq from w)
  select a, b, sum(freq)::bigint as freq from (select unnest(s[:-2]) as a, unnest(s[2:]) as b, freq from s) group by a, b"""


@query(PAIR)
def agg14_pair_statistics(spark, sf):
    return numerics.pair_statistics(numerics.word_frequencies(table(spark, sf, "benchmark")))


@query()
def bpe2_train(spark, sf):
    vocabulary = written(numerics.word_frequencies(table(spark, sf, "benchmark")), "vocabulary")
    rules = numerics.train_bpe(vocabulary, settle=lambda v: written(v, "vocabulary"))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rules)], "rank int, a string, b string")


@query("with p as (select user_id, event_type, count(*) / sum(count(*)) over (partition by user_id) as p from events group by user_id, event_type) select user_id, round(-sum(p * ln(p + 1e-10)), 6) as entropy, max(p) as top from p group by user_id")
def smp4_entropy(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return c.groupBy("user_id").agg(F.round(numerics.entropy(F.col("p")), 6).alias("entropy"), F.max("p").alias("top"))


@query("with p as (select lang, source, count(*) / sum(count(*)) over (partition by lang) as p from documents group by lang, source), k as (select * from (select *, row_number() over (partition by lang order by p desc, source) as r from p) where r <= 3) select lang, source, round(p / sum(p) over (partition by lang), 6) as q from k")
def smp2_top_k(spark, sf):
    p = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    return numerics.top_k_renormalised(p, "p", 3, "lang", "source").select("lang", "source", F.round("q", 6).alias("q"))


@query("select t, label, round(exp(t2 / t) / sum(exp(t2 / t)) over (partition by t), 6) as p from (select label, count(*) / 100.0 as t2 from embeddings group by label), (select unnest([0.5, 1.0, 2.0])::double as t)")
def smp3_temperature(spark, sf):
    z = table(spark, sf, "embeddings").groupBy("label").agg((F.count("*") / 100.0).alias("z")).select("label", "z", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0)))).alias("t"))
    return z.select("t", "label", F.round(numerics.softmax(F.col("z") / F.col("t"), "t"), 6).alias("p"))


@query("select pos, i, round(case when i % 2 = 0 then sin(pos / pow(10000, i / 8)) else cos(pos / pow(10000, (i - 1) / 8)) end, 6) as pe from (select unnest(range(0, 32)) as pos), (select unnest(range(0, 8)) as i)")
def tfm3_sinusoidal(spark, sf):
    g = spark.range(32).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    return g.select("pos", "i", F.round(numerics.sinusoidal(F.col("pos"), F.col("i"), 8), 6).alias("pe"))


@query("select h, i, j, round(-pow(2, -8 * (h + 1) / 4) * abs(i - j), 6) as bias from (select unnest(range(0, 4)) as h), (select unnest(range(0, 6)) as i), (select unnest(range(0, 6)) as j)")
def tfm3_alibi(spark, sf):
    s = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    g = spark.range(4).select(F.col("id").alias("h"), s(5).alias("i")).select("h", "i", s(5).alias("j"))
    return g.select("h", "i", "j", F.round(numerics.alibi(F.col("i"), F.col("j"), F.col("h"), 4), 6).alias("bias"))


@query("select event_id, round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 6) as gelu, round(x / (1 + exp(-x)) * 2, 6) as swiglu from (select event_id, value / 100 as x from events)")
def tfm4_activations(spark, sf):
    x = F.col("value") / 100
    return table(spark, sf, "events").select("event_id", F.round(numerics.gelu(x), 6).alias("gelu"), F.round(numerics.swiglu(x, F.lit(2.0)), 6).alias("swiglu"))


MODELS = [("small", 32000, 2048, 16, 512, 5632, False), ("base", 50257, 768, 12, 768, 3072, True), ("large", 128256, 8192, 80, 1024, 28672, False)]


@query("select name, v * d + l * (2 * d * d + 2 * d * kv + 2 * d * ff + 2 * d) + d + case when tied then 0 else v * d end as n from (values " + ", ".join(f"('{m[0]}', " + ", ".join(f"{x}::bigint" for x in m[1:6]) + f", {str(m[6]).lower()})" for m in MODELS) + ") m(name, v, d, l, kv, ff, tied)")
def tfm5_parameters(spark, sf):
    m = spark.createDataFrame(MODELS, "name string, v long, d long, l long, kv long, ff long, tied boolean")
    return m.select("name", numerics.parameters(*[F.col(c) for c in ("v", "d", "l", "kv", "ff", "tied")]).alias("n"))


@query("select l, n, 2::bigint * l * 8 * n * 128 * 2 as bytes from (select unnest([16, 32, 80]) as l), (select unnest([1024, 8192, 131072]) as n)")
def tfm6_kv_cache(spark, sf):
    many = lambda *x: F.explode(F.array(*map(F.lit, x)).cast("array<long>"))
    g = spark.range(1).select(many(16, 32, 80).alias("l")).select("l", many(1024, 8192, 131072).alias("n"))
    return g.select("l", "n", numerics.kv_cache_bytes(F.col("l"), F.lit(1), F.lit(8), F.col("n")).alias("bytes"))


@query("select n, t, (select count(*) from (select unnest(range(0, n, t)) as q), (select unnest(range(0, n, t)) as k) where k <= least(q + t, n) - 1) as loads from (select unnest([64, 256]) as n), (select unnest([16, 32]) as t)")
def tfm8_tile_loads(spark, sf):
    return spark.createDataFrame([(n, t, numerics.tile_loads(n, t)) for n in (64, 256) for t in (16, 32)], "n int, t int, loads long")


# ---- approximate search, embeddings, streams ------------------------------------------------------------------------------


def vector_index(spark, sf, kind):
    """A kept index of the embeddings table: graphs, ivf or pq."""
    build = {"graphs": ann.build_graphs, "ivf": ann.build_ivf, "pq": ann.build_pq}[kind]
    return kept(spark, kind, [f"{sf}/embeddings.parquet"], lambda: build(vectors(spark, sf)))


@query()
def ret8_graph_search(spark, sf):
    return ann.graph_lookup(vector_index(spark, sf, "graphs"), vector_queries(spark, sf))


@query()
def ret10_ivf_search(spark, sf):
    return ann.ivf_lookup(vector_index(spark, sf, "ivf"), vector_queries(spark, sf), probe=10)


@query()
def ret11_pq_search(spark, sf):
    return ann.pq_lookup(vector_index(spark, sf, "pq"), vector_queries(spark, sf))


@query()
def ret22_ann_recall(spark, sf):
    """Mean recall of the top ten by index; inverted lists with the default four cells and with ten."""
    q = vector_queries(spark, sf)
    exact = dense.vector_search(vectors(spark, sf), q)
    ivf = vector_index(spark, sf, "ivf")
    kinds = {"graph": ann.graph_lookup(vector_index(spark, sf, "graphs"), q), "ivf 4": ann.ivf_lookup(ivf, q), "ivf 10": ann.ivf_lookup(ivf, q, probe=10), "pq": ann.pq_lookup(vector_index(spark, sf, "pq"), q)}
    out = None
    for name, found in kinds.items():
        r = ann.recall(found, exact, 10).agg(F.avg("recall").alias("recall")).select(F.lit(name).alias("index"), "recall")
        out = r if out is None else out.union(r)
    return out


@query()
def emb1_md5_embedding(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", E.embedder(E.md5_embedding, dims=32)("text").alias("embedding"))


@query()
def emb3_topic_embedding(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", E.embedder(E.topic_embedding, dims=32)("text").alias("embedding"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def str1_tumbling_windows(spark, sf):
    return event_windows(table(spark, sf, "events"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w <= interval '30 minutes' and ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as id from g)
  select user_id, min(ts) as start, count(*) as n from s group by user_id, id""")
def str2_sessions(spark, sf):
    return sessions(table(spark, sf, "events"))
