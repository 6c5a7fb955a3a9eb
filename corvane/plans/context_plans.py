"""Chunking, context packing, history, windows and joins over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunking as C
from corvane.operators import context as X
from corvane.operators import dense, lexical
from corvane.plans.registry import query, table
from corvane.plans.retrieval_plans import BM25_CTE, VEC_CTE, benchmark_queries, lexical_index, vector_queries, vectors
from corvane.plans.text_plans import SENT, WORDS


def docs(spark, sf):
    return table(spark, sf, "documents")


def exploded(frame, chunks, *keys):
    return frame.select(*keys, F.posexplode(chunks).alias("idx", "content"))


@query("select doc_id, i as idx, i * 1440 as start_char, least(i * 1440 + 1600, length(text)) as end_char, text[i * 1440 + 1:i * 1440 + 1600] as content from documents, unnest(range(0, (length(text) - 1) // 1440 + 1)) as t(i) where length(trim(text)) > 0")
def chk1_by_characters(spark, sf):
    d = docs(spark, sf).select("doc_id", F.posexplode(C.by_characters(F.col("text"))).alias("idx", "c"))
    return d.select("doc_id", "idx", "c.start_char", "c.end_char", "c.content")


@query(f"""with p as (select doc_id, {WORDS} as w from documents), f as (select doc_id, list_reduce(list_prepend({{n: 0::bigint, fresh: 0, now: []::varchar[], done: []::varchar[]}}, list_transform(w, lambda x: {{n: greatest(1, length(x) // 4)::bigint, fresh: 1, now: [x], done: []::varchar[]}})),
  lambda a, x: case when a.n + x.n >= 400 then {{n: coalesce(list_sum(list_transform(list_concat(a.now, x.now)[-least(greatest(1, (len(a.now) + 1) * 40 // 400), len(a.now)):], lambda y: greatest(1, length(y) // 4))) * (len(a.now) > 0)::int, 0)::bigint, fresh: 0,
    now: case when len(a.now) > 0 then list_concat(a.now, x.now)[-least(greatest(1, (len(a.now) + 1) * 40 // 400), len(a.now)):] else []::varchar[] end, done: list_append(a.done, array_to_string(list_concat(a.now, x.now), ' '))}} else {{n: a.n + x.n, fresh: 1, now: list_concat(a.now, x.now), done: a.done}} end) as r from p where len(w) > 0),
  c as (select doc_id, case when r.fresh = 1 then list_append(r.done, array_to_string(r.now, ' ')) else r.done end as c from f) select doc_id, unnest(c) as content, generate_subscripts(c, 1) - 1 as idx from c""")
def chk2_by_tokens(spark, sf):
    return exploded(docs(spark, sf), C.by_tokens(F.col("text")), "doc_id")


FOLD = """list_reduce(list_prepend({{n: 0::bigint, now: []::varchar[], done: []::varchar[]}}, list_transform(s, lambda x: {{n: greatest(1, length(x) // 4)::bigint, now: [x], done: []::varchar[]}})),
  lambda a, x: case when a.n + x.n > {target} and len(a.now) > 0 then {{n: x.n + {carry_n}, now: list_concat({carry}, x.now), done: list_append(a.done, array_to_string(a.now, ' '))}} else {{n: a.n + x.n, now: list_concat(a.now, x.now), done: a.done}} end)"""


def fold_sql(sentences, target, overlap):
    carry = "a.now[-1:]" if overlap else "[]::varchar[]"
    carry_n = "coalesce(greatest(1, length(a.now[-1]) // 4), 0)" if overlap else "0"
    fold = FOLD.format(target=target, carry=carry, carry_n=carry_n)
    return f"with p as (select doc_id, {sentences} as s from documents), f as (select doc_id, {fold} as r from p where len(s) > 0) select doc_id, idx - 1 as idx, content from (select doc_id, unnest(list_append(r.done, array_to_string(r.now, ' '))) as content, generate_subscripts(list_append(r.done, array_to_string(r.now, ' ')), 1) as idx from f)"


@query(fold_sql(SENT, 300, 1))
def chk3_by_sentences(spark, sf):
    return exploded(docs(spark, sf), C.by_sentences(F.col("text")), "doc_id")


LOOSE_FULL = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))), lambda s: length(s) > 0)"


@query(fold_sql(LOOSE_FULL, 300, 0))
def chk4_without_overlap(spark, sf):
    return exploded(docs(spark, sf), C.pack_sentences(T.sentences(F.col("text"), T.SENTENCE_END), 300, 0), "doc_id")


@query()
def chk5_by_paragraphs(spark, sf):
    return exploded(docs(spark, sf), C.chunk_udf(C.paragraph_chunks)(F.regexp_replace("text", "\\n", "\n\n")), "doc_id")


@query()
def chk6_semantic(spark, sf):
    from corvane.functions.embeddings import hashed_embedding

    d = docs(spark, sf).select("doc_id", F.posexplode(C.semantic_udf(hashed_embedding)("text")).alias("idx", "c"))
    return d.select("doc_id", "idx", "c.content", F.round("c.topic_break_score", 6).alias("topic_break_score"))


@query()
def chk7_recursive(spark, sf):
    return exploded(docs(spark, sf), C.chunk_udf(C.recursive_chunks, separators=C.SEPARATORS["plain"])("text"), "doc_id")


@query("select doc_id, count(*) as n, sum(length(c))::bigint as chars from (select doc_id, trim(text[i * 1080 + 1:i * 1080 + 1200]) as c from documents, unnest(range(0, (length(text) - 1) // 1080 + 1)) as t(i) where length(trim(text)) > 0) where length(c) > 0 group by doc_id")
def chk8_hard_split(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(C.hard_split(F.col("text"))).alias("c")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("c")).alias("chars"))


@query(f"""with p as (select doc_id, {SENT} as s from documents), f as (select doc_id, list_reduce(list_prepend([]::varchar[], list_transform(s, lambda x: [x])), lambda a, x: case when len(a) > 0 and greatest(1, (length(a[-1]) + 1 + length(x[1])) // 4) <= 100
  then list_append(a[:-2], a[-1] || chr(10) || x[1]) else list_append(a, x[1]) end) as r from p where len(s) > 0) select doc_id, unnest(r) as content, generate_subscripts(r, 1) - 1 as idx from f""")
def chk9_merge_small(spark, sf):
    return exploded(docs(spark, sf), C.merge_small(T.sentences(F.col("text")), 100), "doc_id")


@query()
def chk10_hierarchical(spark, sf):
    d = docs(spark, sf).select("doc_id", F.explode(C.hierarchy_udf()("text")).alias("h"))
    return d.select("doc_id", "h.parent_idx", "h.child_idx", "h.child")


@query()
def chk11_context_aware(spark, sf):
    d = docs(spark, sf).select("doc_id", F.explode(C.hierarchy_udf()("text")).alias("h"))
    return d.select(F.concat_ws(":", "doc_id", "h.parent_idx", "h.child_idx", F.lit("ctx")).alias("chunk_id"), C.with_context(F.col("h.child"), F.col("h.parent")).alias("content"))


@query(f"select doc_id, unnest(list_transform(range(0, greatest(len({WORDS}), 1), 270), lambda i: array_to_string({WORDS}[i + 1:i + 300], ' '))) as content from documents where len({WORDS}) > 0")
def chk12_word_windows(spark, sf):
    w = T.words(F.col("text"))
    cut = T.bound(w, lambda a: F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.size(a), F.lit(270)), lambda i: F.array_join(F.slice(a, i, 300), " "))))
    return docs(spark, sf).select("doc_id", F.explode(cut).alias("content"))


@query("""with b as (select doc_id, unnest(list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+'), lambda s: trim(s)), lambda s: length(s) > 0)) as s from documents)
  select doc_id, case when regexp_matches(s, '^```') then 'code_block' when regexp_matches(s, '^#{1,6}\\s') then 'heading' when regexp_matches(s, '^[\\-\\*\\+]\\s|^\\d+\\.\\s') then 'list' when regexp_matches(s, '^\\w+:\\s*$|^\\w+:\\s+\\S') then 'yaml_block' else 'paragraph' end as chunk_type, greatest(1, length(s) // 4) as token_count, length(s) as char_count from b""")
def chk13_blocks(spark, sf):
    d = docs(spark, sf).select("doc_id", F.explode(C.blocks(F.regexp_replace("text", "\\n", "\n\n"))).alias("b"))
    return d.select("doc_id", "b.chunk_type", "b.token_count", "b.char_count")


@query()
def chk14_dispatch(spark, sf):
    p = table(spark, sf, "pages")
    return exploded(p, C.dispatched_udf()("html", T.content_type(F.col("html"))), "page_id")


@query()
def chk15_ingest_report(spark, sf):
    """Kind, chunks, flags and sizes of every page, in one pass."""
    p = table(spark, sf, "pages").withColumn("kind", T.content_type_of_file(F.col("html"), F.col("url")))
    c = p.select("page_id", "kind", F.posexplode(C.dispatched_udf()("html", "kind")).alias("idx", "content"))
    flags = T.structure_flags(F.col("content"))
    return c.select("page_id", "kind", "idx", "content", *[v.alias(k) for k, v in flags.items()]).groupBy("kind").agg(F.count("*").alias("n_chunks"), F.countDistinct("page_id").alias("n_pages"), F.count("has_code").alias("with_code"))


@query(f"select doc_id, unnest(list_transform(range(0, len({WORDS}), 750), lambda i: array_to_string({WORDS}[i + 1:i + 750], ' '))) as content from documents where len({WORDS}) > 0")
def chk16_word_slices(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(C.by_words(F.col("text"))).alias("content"))


@query("select doc_id, count(*) as n, min(t) as least, max(t) as most, max(t) - min(t) as spread from (select doc_id, greatest(1, length(text[i * 800 + 1:i * 800 + 800]) // 4) as t from documents, unnest(range(0, (length(text) - 1) // 800 + 1)) as x(i) where length(trim(text)) > 0) group by doc_id")
def chk17_split_comparison(spark, sf):
    d = docs(spark, sf).select("doc_id", F.explode(C.by_characters(F.col("text"), 800, 0)).alias("c")).select("doc_id", T.approx_tokens(F.col("c.content")).alias("t"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("t").alias("least"), F.max("t").alias("most"), (F.max("t") - F.min("t")).alias("spread"))


CHUNKS_SQL = "(select doc_id, lang, text[i * 1440 + 1:i * 1440 + 1600] as content from documents, unnest(range(0, (length(text) - 1) // 1440 + 1)) as t(i) where length(trim(text)) > 0)"


@query(f"""select lang, count(*) as n, round(avg(t), 6) as mean, round(stddev_pop(t), 6) as std, min(t) as least, max(t) as most, round(avg(e), 6) as ends, round(avg(b), 6) as starts, round((avg(e) + avg(b)) / 2, 6) as quality
  from (select lang, greatest(1, length(content) // 4) as t, regexp_matches(content, '[.!?]\\s*$')::int as e, regexp_matches(content, '^\\s*[A-Z\\d]')::int as b from {CHUNKS_SQL}) group by lang""")
def agg5_chunk_quality(spark, sf):
    return C.quality(docs(spark, sf).select("lang", F.explode(C.by_characters(F.col("text"))).alias("c")).select("lang", "c.content"), ["lang"])


@query(f"select round(avg(child), 6) as child, round(avg(parent), 6) as parent, round(avg(parent) / avg(child), 6) as ratio from (select greatest(1, length(content) // 4) as child, greatest(1, length(text) // 4) as parent from {CHUNKS_SQL} c join documents using (doc_id))")
def agg6_index_stats(spark, sf):
    d = docs(spark, sf).select(T.approx_tokens(F.col("text")).alias("p"), F.explode(C.by_characters(F.col("text"))).alias("c")).select("p", T.approx_tokens(F.col("c.content")).alias("t"))
    return d.agg(F.round(F.avg("t"), 6).alias("child"), F.round(F.avg("p"), 6).alias("parent"), F.round(F.avg("p") / F.avg("t"), 6).alias("ratio"))


@query("select lang, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share, round(avg(length(text) / greatest(1, length(text) // 4)), 6) as chars_per_token from documents group by lang")
def agg7_corpus_profile(spark, sf):
    d = docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text") / T.approx_tokens(F.col("text"))), 6).alias("chars_per_token"))
    return d.select("lang", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), "chars_per_token")


@query(f"select sum(t)::bigint as total, round(avg(t), 6) as mean, min(t) as least, max(t) as most, 120000 // floor(avg(t))::bigint as fit from (select greatest(1, length(content) // 4) as t from {CHUNKS_SQL})")
def agg8_chunk_summary(spark, sf):
    t = docs(spark, sf).select(F.explode(C.by_characters(F.col("text"))).alias("c")).select(T.approx_tokens(F.col("c.content")).alias("t"))
    return t.agg(F.sum("t").alias("total"), F.round(F.avg("t"), 6).alias("mean"), F.min("t").alias("least"), F.max("t").alias("most"), F.floor(F.lit(120000) / F.floor(F.avg("t"))).alias("fit"))


@query("select user_id, event_type, round(n / total, 6) as share from (select user_id, event_type, count(*) as n, sum(count(*)) over (partition by user_id) as total, row_number() over (partition by user_id order by count(*) desc, min(event_id)) as r from events group by user_id, event_type) where r = 1")
def agg10_majority_vote(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    w = Window.partitionBy("user_id")
    r = c.withColumns({"total": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "first"))}).where("r = 1")
    return r.select("user_id", "event_type", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("select count(*) as n, sum((event_type = 'purchase')::int)::bigint as supported, sum((event_type <> 'purchase' and value > 50)::int)::bigint as contradicted from events")
def agg12_verdict_counts(spark, sf):
    e = table(spark, sf, "events")
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return e.agg(F.count("*").alias("n"), flag(F.col("event_type") == "purchase").alias("supported"), flag((F.col("event_type") != "purchase") & (F.col("value") > 50)).alias("contradicted"))


@query("select round(sum(frac * coalesce(m, 1.5)), 6) as mix from (select lang, count(*) / sum(count(*)) over () as frac from documents group by lang) left join (values ('en', 1.0), ('de', 1.3), ('fr', 1.25)) v(lang, m) using (lang)")
def agg15_language_mix(spark, sf):
    m = spark.createDataFrame([("en", 1.0), ("de", 1.3), ("fr", 1.25)], "lang string, m double")
    share = docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n")).withColumn("frac", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return share.join(m, "lang", "left").agg(F.round(F.sum(F.col("frac") * F.coalesce("m", F.lit(1.5))), 6).alias("mix"))


@query("select conv_id, count(*) as turns, sum(case when role <> 'assistant' then t else 0 end)::bigint as input, sum(case when role = 'assistant' then t else 0 end)::bigint as output, round(sum(t * case when role = 'assistant' then 15 else 3 end) / 1e6, 9) as cost from (select *, greatest(1, length(text) // 4) as t from conversations) group by conv_id")
def agg16_session_totals(spark, sf):
    t, out = T.approx_tokens(F.col("text")), F.col("role") == "assistant"
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.when(~out, t).otherwise(0)).alias("input"), F.sum(F.when(out, t).otherwise(0)).alias("output"), F.round(F.sum(t * F.when(out, 15).otherwise(3)) / 1e6, 9).alias("cost"))


@query(f"with {VEC_CTE} select count(distinct id) as unique_docs, count(*) as listed from top10")
def agg18_unique_docs(spark, sf):
    return dense.vector_search(vectors(spark, sf), vector_queries(spark, sf)).agg(F.countDistinct("id").alias("unique_docs"), F.count("*").alias("listed"))


@query(f"with {VEC_CTE} select query_id, label as parent, id, round(score, 6) as score from (select *, row_number() over (partition by query_id, label order by score desc, id) as r from top10) where r = 1")
def agg19_best_child(spark, sf):
    found = dense.vector_search(vectors(spark, sf), vector_queries(spark, sf)).join(vectors(spark, sf).select("id", "label"), "id")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "id"))).where("r = 1")
    return best.select("query_id", F.col("label").alias("parent"), "id", F.round("score", 6).alias("score"))


@query(f"with {VEC_CTE} select query_id, label as parent, id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, id) as rank from (select *, row_number() over (partition by query_id, label order by score desc, id) as r from (select * from top10 where rank <= 5)) where r = 1")
def ret18_hierarchical_search(spark, sf):
    found = dense.vector_search(vectors(spark, sf), vector_queries(spark, sf), 5).drop("rank").join(vectors(spark, sf).select("id", "label"), "id")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "id"))).where("r = 1")
    return best.select("query_id", F.col("label").alias("parent"), "id", F.round("score", 6).alias("score"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).alias("rank"))


# ---- windows, packing, history ---------------------------------------------------------------------------------------


@query(f"with {VEC_CTE} select query_id, id, rank, row_number() over (partition by query_id order by label, id) as new_rank, rank - row_number() over (partition by query_id order by label, id) as moved from top10")
def win2_rank_change(spark, sf):
    found = dense.vector_search(vectors(spark, sf), vector_queries(spark, sf)).join(vectors(spark, sf).select("id", "label"), "id")
    new = F.row_number().over(Window.partitionBy("query_id").orderBy("label", "id"))
    return found.select("query_id", "id", "rank", new.alias("new_rank"), (F.col("rank") - new).alias("moved"))


@query("select conv_id, turn, running from (select conv_id, turn, sum(greatest(1, length(text) // 4)) over (partition by conv_id order by turn)::bigint as running from conversations) where running <= 150")
def win3_prefix_cut(spark, sf):
    return X.prefix_within(table(spark, sf, "conversations"), T.approx_tokens(F.col("text")), 150, ["conv_id"], [F.col("turn")]).select("conv_id", "turn", "running")


@query("select conv_id, turn, running from (select conv_id, turn, sum(greatest(1, length(text) // 4)) over (partition by conv_id order by turn desc)::bigint as running from conversations) where running <= 150")
def win4_history_suffix(spark, sf):
    return X.history_suffix(table(spark, sf, "conversations"), T.approx_tokens(F.col("text")), 150).select("conv_id", "turn", "running")


@query("select vec_id, round(list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(p, lambda x: x::double)), 6) as similarity from (select vec_id, embedding, lag(embedding) over (partition by label order by vec_id) as p from embeddings) where p is not null")
def win5_adjacent_similarity(spark, sf):
    from corvane.functions.vectors import dot

    e = table(spark, sf, "embeddings").withColumn("p", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("p is not null")
    return e.select("vec_id", F.round(dot(F.col("embedding"), F.col("p")), 6).alias("similarity"))


@query("select conv_id, turn, sum(t) over (partition by conv_id order by turn)::bigint as total, round(100 * sum(t) over (partition by conv_id order by turn) / 200000, 6) as pct from (select *, greatest(1, length(text) // 4) as t from conversations)")
def win6_cumulative_tokens(spark, sf):
    s = F.sum(T.approx_tokens(F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", s.alias("total"), F.round(100 * s / 200000, 6).alias("pct"))


@query("with p as (select lang, source, count(*) / sum(count(*)) over (partition by lang) as p from documents group by lang, source), c as (select *, coalesce(sum(p) over (partition by lang order by p desc, source rows between unbounded preceding and 1 preceding), 0) as before from p) select lang, source, round(p, 6) as p from c where round(before, 9) < 0.95")
def win7_nucleus(spark, sf):
    p = docs(spark, sf).groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    before = F.coalesce(F.sum("p").over(Window.partitionBy("lang").orderBy(F.desc("p"), "source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return p.withColumn("before", before).where(F.round("before", 9) < 0.95).select("lang", "source", F.round("p", 6).alias("p"))


@query(f"with {VEC_CTE} select query_id, id, case when rank <= 5 then rank else 16 - rank end as place from top10")
def win8_middle_out(spark, sf):
    found = dense.vector_search(vectors(spark, sf), vector_queries(spark, sf))
    n = F.count("*").over(Window.partitionBy("query_id"))
    return found.select("query_id", "id", X.middle_out(F.col("rank"), n).alias("place"))


@query("select user_id, event_id, round(exp(value - max(value) over w) / sum(exp(value - mx)) over w, 9) as p from (select *, max(value) over (partition by user_id) as mx from events) window w as (partition by user_id)")
def win10_softmax(spark, sf):
    w = Window.partitionBy("user_id")
    e = table(spark, sf, "events").withColumn("z", F.col("value") - F.max("value").over(w))
    return e.select("user_id", "event_id", F.round(F.exp("z") / F.sum(F.exp("z")).over(w), 9).alias("p"))


@query("""with o as (select conv_id, list({c: greatest(1, length(text) // 4)::bigint, id: turn} order by -(turn % 5), turn) as s from conversations group by conv_id), f as (select conv_id, list_reduce(list_prepend({u: 0::bigint, ids: []::bigint[]}, list_transform(s, lambda x: {u: x.c, ids: [x.id]})), lambda a, x: case when a.u + x.u <= 120 then {u: a.u + x.u, ids: list_concat(a.ids, x.ids)} else a end) as r from o)
  select conv_id, array_to_string(r.ids, ',') as ids, r.u as used from f""")
def ctx2_first_fit(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.approx_tokens(F.col("text")).alias("t"), (F.col("turn") % 5).alias("score"))
    return X.first_fit(c, 120, "conv_id", "turn", "t", "score").select("conv_id", F.array_join("ids", ",").alias("ids"), "used")


@query(f"with {VEC_CTE} select query_id, id, rank from top10 where rank <= 5")
def ctx1_fixed_k(spark, sf):
    return dense.vector_search(vectors(spark, sf), vector_queries(spark, sf), 5).select("query_id", "id", "rank")


@query("""with t as (select conv_id, role as tier, turn, greatest(1, length(text) // 4)::bigint as c, case role when 'system' then 60 when 'user' then 80 else 40 end as b from conversations), o as (select conv_id, tier, b, list({c: c, id: turn} order by turn) as s from t group by all),
  f as (select conv_id, tier, list_reduce(list_prepend({u: 0::bigint, ids: []::bigint[], b: b}, list_transform(s, lambda x: {u: x.c, ids: [x.id], b: b})), lambda a, x: case when a.u + x.u <= a.b then {u: a.u + x.u, ids: list_concat(a.ids, x.ids), b: a.b} else a end) as r from o) select conv_id, tier, array_to_string(r.ids, ',') as ids, r.u as used from f""")
def ctx4_hierarchical(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws("|", "conv_id", "role").alias("key"), "role", "turn", T.approx_tokens(F.col("text")).alias("t"), (-F.col("turn")).alias("score"))
    out = None
    for tier, budget in (("system", 60), ("user", 80), ("assistant", 40)):
        part = X.first_fit(c.where(F.col("role") == tier), budget, "key", "turn", "t", "score")
        out = part if out is None else out.unionByName(part)
    k = F.split("key", "\\|")
    return out.select(k[0].cast("long").alias("conv_id"), k[1].alias("tier"), F.array_join("ids", ",").alias("ids"), "used")


@query("select conv_id, case when max((role = 'system')::int) = 1 and count(*) > 8 then 'hierarchical' when avg(turn / 10) < 0.3 then 'threshold' when count(*) > 4 then 'dynamic' else 'fixed_k' end as strategy from conversations group by conv_id")
def ctx5_select_strategy(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.avg(F.col("turn") / 10).alias("m"), F.max(F.col("role") == "system").alias("s"))
    return g.select("conv_id", X.chosen_strategy(F.col("n"), F.col("m"), F.col("s") & (F.col("n") > 8), 0.3, 4).alias("strategy"))


RECALL_SQL = "(list_value(0.80, 0.75, 0.70, 0.63, 0.58, 0.55, 0.57, 0.60, 0.65, 0.75))"


@query(f"with g as (select n, p, p / greatest(n - 1, 1) * 9 as x from (select unnest(range(1, 21)) as n), unnest(range(0, n)) as t(p)) select n, p, round(case when n <= 1 then 0.8 else {RECALL_SQL}[floor(x)::int + 1] + (x - floor(x)) * ({RECALL_SQL}[least(floor(x)::int + 2, 10)] - {RECALL_SQL}[floor(x)::int + 1]) end, 6) as recall from g")
def ctx7_estimated_recall(spark, sf):
    g = spark.range(1, 21).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") - 1)).alias("p"))
    return g.select("n", "p", F.round(X.estimated_recall(F.col("p"), F.col("n")), 6).alias("recall"))


@query("select i, round(0.6 + 0.2 * cos(2 * pi() * i / 20), 6) as attention, round(avg(0.6 + 0.2 * cos(2 * pi() * i / 20)) over (), 6) as expected from (select unnest(range(0, 21)) as i)")
def ctx8_attention(spark, sf):
    a = X.attention_by_position(F.col("i") / 20)
    return spark.range(21).select(F.col("id").alias("i")).select("i", F.round(a, 6).alias("attention"), F.round(F.avg(a).over(Window.partitionBy()), 6).alias("expected"))


@query(f"""with {VEC_CTE}, o as (select query_id, score, rank - 1 as p from top10 union all select query_id + 1000000, score, case when rank <= 5 then rank else 16 - rank end - 1 from top10), x as (select query_id, score, p / 9 * 9 as x from o)
  select query_id % 1000000 as query_id, case when query_id >= 1000000 then 'middle_out' else 'relevance' end as ordering, round(sum(score * ({RECALL_SQL}[floor(x)::int + 1])) / greatest(sum(score), 0.001) * 100, 6) as efficiency from x group by all""")
def ctx9_compare_orderings(spark, sf):
    found = dense.vector_search(vectors(spark, sf), vector_queries(spark, sf))
    n = F.lit(10)
    one = found.select("query_id", "score", F.lit("relevance").alias("ordering"), (F.col("rank") - 1).alias("p"))
    two = found.select("query_id", "score", F.lit("middle_out").alias("ordering"), (X.middle_out(F.col("rank"), n) - 1).alias("p"))
    rec = F.sum(F.col("score") * X.estimated_recall(F.col("p"), n)) / F.greatest(F.sum("score"), F.lit(0.001)) * 100
    return one.union(two).groupBy("query_id", "ordering").agg(F.round(rec, 6).alias("efficiency"))


@query("select conv_id, sum(t)::bigint as total, round(sum(t) / 400 * 100, 6) as pct, case when sum(t) > 400 then 'over' when sum(t) > 340 then 'near' else 'safe' end as state from (select conv_id, greatest(1, length(text) // 4) as t from conversations) group by conv_id")
def ctx10_validate(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(T.approx_tokens(F.col("text"))).alias("total"))
    return g.select("conv_id", "total", F.round(X.utilisation(F.col("total"), F.lit(400)), 6).alias("pct"), F.when(F.col("total") > 400, "over").when(F.col("total") > 340, "near").otherwise("safe").alias("state"))


@query("select total, floor(total * 0.05)::bigint as system, floor(total * 0.6)::bigint as documents, floor(total * 0.15)::bigint as history, floor(total * 0.05)::bigint as question, floor(total * 0.15)::bigint as answer, greatest(1, floor(total * 0.6)::bigint // 300) as max_chunks from (select unnest([8000, 32000, 128000, 200000]) as total)")
def ctx12_budget_split(spark, sf):
    t = spark.createDataFrame([(8000,), (32000,), (128000,), (200000,)], "total int")
    parts = X.budget_split(F.col("total"))
    return t.select("total", *[v.alias(k) for k, v in parts.items()], F.greatest(F.lit(1), F.floor(parts["documents"] / 300)).alias("max_chunks"))


@query(f"""with {BM25_CTE}, e as (select query_id, rank, '[' || rank::varchar || '] (source: ' || source || ')' || chr(10) || d.text as e from bm25_top join documents d using (doc_id)), b as (select query_id, rank, e, sum(length(e)) over (partition by query_id order by rank) as run from e)
  select query_id, count(*) as n, max(run)::bigint as chars, md5(string_agg(e, chr(10) || chr(10) order by rank)) as context from b where run <= 16000 group by query_id""")
def prm1_rag_context(spark, sf):
    """The found documents of every query, best first, while they fit 16,000 characters."""
    found = lexical.index_search(lexical_index(spark, sf), benchmark_queries(spark, sf)).join(docs(spark, sf).select("doc_id", "source", "text"), "doc_id")
    e = found.withColumn("e", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (source: "), "source", F.lit(")\n"), "text"))
    fits = X.prefix_within(e, F.length("e"), 16000, ["query_id"], [F.col("rank")]).groupBy("query_id").agg(F.count("*").alias("n"), F.max("running").alias("chars"), F.array_sort(F.collect_list(F.struct("rank", "e"))).alias("parts"))
    return fits.select("query_id", "n", "chars", F.md5(F.array_join(F.transform("parts", lambda x: x["e"]), "\n\n")).alias("context"))


@query("select conv_id, 'Answer from the sources.' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('[' || turn::varchar || '] (source: ' || role || ')' || chr(10) || text, chr(10) || chr(10) order by turn) || chr(10) || chr(10) || 'Question: why' as prompt from conversations group by conv_id")
def prm3_prompt(spark, sf):
    return X.prompt("Answer from the sources.", table(spark, sf, "conversations"), F.lit("why"), "conv_id", "turn", "role", "text")


@query("""with q as (select item_id, text, list_distinct(string_split_regex(lower(text), '\\s+')) as q from benchmark), p as (select item_id, q, list_filter(list_transform(string_split(text, '.'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 0) as s from q), e as (select item_id, q, unnest(s) as s, generate_subscripts(s, 1) as pos from p),
  r as (select *, row_number() over (partition by item_id order by len(list_intersect(list_distinct(string_split_regex(lower(s), '\\s+')), q)) / greatest(len(q), 1) desc, pos) as r from e) select item_id, string_agg(s, '. ' order by pos) || '.' as extract from r where r <= 2 group by item_id""")
def cmp1_relevant_sentences(spark, sf):
    b = table(spark, sf, "benchmark")
    return X.relevant_sentences(b, "item_id", "text", F.array_distinct(F.split(F.lower("text"), "\\s+")), 2)


@query("select conv_id, turn, sum(greatest(1, length(text) // 4)) over (partition by conv_id order by turn desc) <= 100 as kept from conversations")
def his2_hybrid_history(spark, sf):
    return X.hybrid_history(table(spark, sf, "conversations"), T.approx_tokens(F.col("text")), 400).select("conv_id", "turn", "kept")


@query("select conv_id, count(*) as sent, max(run)::bigint as chars from (select conv_id, sum(length(text)) over (partition by conv_id order by turn desc) as run from conversations) where run <= 600 group by conv_id")
def his3_characters_sent(spark, sf):
    return X.history_suffix(table(spark, sf, "conversations"), F.length("text"), 600).groupBy("conv_id").agg(F.count("*").alias("sent"), F.max("running").alias("chars"))


# ---- joins and sets --------------------------------------------------------------------------------------------------


@query("select c.conv_id, c.turn, p.text as parent from conversations c join conversations p on p.conv_id = c.conv_id and p.turn = 0")
def jon3_child_parent(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn").join(c.where("turn = 0").select("conv_id", F.col("text").alias("parent")), "conv_id")


@query("select doc_id, text is not null as known, coalesce(quality, 0) as rel from documents left join labels using (doc_id)")
def jon5_labels_left(spark, sf):
    return docs(spark, sf).select("doc_id", F.col("text").isNotNull().alias("known")).join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "known", F.coalesce("quality", F.lit(0)).alias("rel"))


@query("select label, vec_id, round((list_dot_product(v, t) - list_dot_product(v, v)) / (n - 1), 6) as mean from (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings) join (select label, list(s order by i) as t, max(n) as n from (select label, i, sum(x) as s, count(*) as n from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i) group by label) using (label) where n > 1")
def jon9_mean_similarity(spark, sf):
    """Mean similarity of each row to the others of its label through the label's vector sum: no pairs are made."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    t = e.groupBy("label", "i").agg(F.sum("x").alias("t"), F.count("*").alias("n"))
    g = e.join(t, ["label", "i"]).groupBy("label", "vec_id").agg((F.sum(F.col("x") * F.col("t")) - F.sum(F.col("x") * F.col("x"))).alias("s"), F.max("n").alias("n")).where("n > 1")
    return g.select("label", "vec_id", F.round(F.col("s") / (F.col("n") - 1), 6).alias("mean"))


@query("select doc_id from documents where lang = 'en' union select doc_id from labels where quality = 0")
def set1_union(spark, sf):
    return docs(spark, sf).where("lang = 'en'").select("doc_id").union(table(spark, sf, "labels").where("quality = 0").select("doc_id")).distinct()


@query("select count(*) as both from (select doc_id from documents where lang = 'en' intersect select doc_id from labels where quality = 0)")
def set2_intersection(spark, sf):
    return docs(spark, sf).where("lang = 'en'").join(table(spark, sf, "labels").where("quality = 0"), "doc_id", "left_semi").agg(F.count("*").alias("both"))


@query("select doc_id from documents where lang = 'en' except select doc_id from labels where quality = 0")
def set3_difference(spark, sf):
    return docs(spark, sf).where("lang = 'en'").select("doc_id").exceptAll(table(spark, sf, "labels").where("quality = 0").select("doc_id"))


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 20")
def top1_longest(spark, sf):
    return docs(spark, sf).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id) as r from events) where r <= 3")
def top5_most_recent(spark, sf):
    return table(spark, sf, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))).where("r <= 3").select("user_id", "event_id")
