"""Text scalars over whole tables."""

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.registry import query, table

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TOKENS = f"list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) > 1 and t not in ({STOP}))"
SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z\\d])', '\\1\x01\\2', 'g'), '\x01'), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))), lambda s: length(s) > 0)"
LOOSE = "list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g')))"
WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 0)"


@query(f"select doc_id, array_to_string({TOKENS}, ' ') as tokens, len({TOKENS}) as n_tokens from documents")
def txt1_tokenize(spark, sf):
    t = T.tokenize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n_tokens"))


@query("select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{4,}'))) as n_words from documents")
def txt2_content_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.content_words(F.col("text"), 4)).alias("n_words"))


@query(f"select doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{3,}}'), lambda t: t not in ({STOP})))) as n_words from documents")
def txt3_content_words_without_stopwords(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.content_words(F.col("text"), 3, T.STOPWORDS)).alias("n_words"))


@query("select item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda t: regexp_matches(t, '^[a-z]{4,}$'))))[1:8], ' ') as topic from benchmark")
def txt4_topic_keywords(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.topic_keywords(F.col("text")).alias("topic"))


@query(f"select doc_id, len({SENT}) as n_sentences, {SENT}[1] as first from documents")
def txt5_sentences(spark, sf):
    s = T.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.try_element_at(s, F.lit(1)).alias("first"))


@query(f"select doc_id, len(list_filter({LOOSE}, lambda s: length(s) > 15)) as n_sentences from documents")
def txt6_loose_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"), T.SENTENCE_END, 15)).alias("n_sentences"))


@query("select doc_id, len(list_filter(list_transform(string_split(text, '.'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 20)) as n_sentences from documents")
def txt7_dot_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.dot_sentences(F.col("text"))).alias("n_sentences"))


@query("select doc_id, len(list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda s: trim(s)), lambda s: length(s) > 0)) as n_paragraphs from documents")
def txt8_paragraphs(spark, sf):
    spaced = F.regexp_replace("text", "\\n", "\n\n")  # the table's paragraphs stand on lines of their own
    return table(spark, sf, "documents").select("doc_id", F.size(T.paragraphs(spaced)).alias("n_paragraphs"))


@query(f"select doc_id, len({WORDS}) as n_words, {WORDS}[1] as first from documents")
def txt9_words(spark, sf):
    w = T.words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).alias("n_words"), F.try_element_at(w, F.lit(1)).alias("first"))


@query("select doc_id, greatest(1, length(text) // 4) as n_tokens from documents")
def txt10_approx_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("n_tokens"))


@query(f"select doc_id, cast(floor(len({WORDS}) / 0.75) as integer) as n_tokens from documents")
def txt11_word_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_tokens(F.col("text")).alias("n_tokens"))


@query(f"select doc_id, length(text) as n_chars, len({WORDS}) as n_words, greatest(1, length(text) // 4) as n_tokens, round(length(text) / greatest(1, length(text) // 4), 2) as chars_per_token from documents")
def txt12_token_profile(spark, sf):
    text, n = F.col("text"), T.approx_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(text).alias("n_chars"), F.size(T.words(text)).alias("n_words"), n.alias("n_tokens"), F.round(F.length(text) / n, 2).alias("chars_per_token"))


@query(f"select doc_id, unnest(list_transform(range(0, len({WORDS}), 75), lambda i: array_to_string({WORDS}[i + 1:i + 75], ' '))) as slice from documents")
def txt13_token_slices(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.token_slices(F.col("text"), 100)).alias("slice"))


@query("""with s as (select page_id, html as t from pages), p as (select page_id,
  3 * (regexp_matches(t, '(?m)^#{1,6}\\s'))::int + 2 * contains(t, '```')::int + (regexp_matches(t, '(?m)^\\s*[-*]\\s'))::int as m,
  3 * (regexp_matches(t, '(?m)^(def |class )'))::int + (regexp_matches(t, '(?m)^\\s{4}\\w'))::int + (contains(t, '#') and contains(t, 'def '))::int as p,
  2 * (regexp_matches(t, '(?m)^\\w[\\w_-]+:\\s*$'))::int + 2 * (regexp_matches(t, '(?m)^  \\w[\\w_-]+:'))::int + 2 * (regexp_matches(t, '^\\s*---'))::int as y from s)
  select page_id, case when greatest(m, p, y) = 0 then 'plain' when m = greatest(m, p, y) then 'markdown' when p = greatest(m, p, y) then 'python' else 'yaml' end as content_type from p""")
def txt14_content_type(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.content_type(F.col("html")).alias("content_type"))


@query("""with s as (select page_id, url || ['.md', '.py', '.yaml', '', '.txt'][page_id % 5 + 1] as f, html as t from pages), p as (select page_id, f,
  3 * (regexp_matches(t, '(?m)^#{1,6}\\s'))::int + 2 * contains(t, '```')::int + (regexp_matches(t, '(?m)^\\s*[-*]\\s'))::int as m,
  4 * (regexp_matches(t, '(?m)^(def |class )'))::int + 2 * (contains(t, 'import ') and contains(t, 'def '))::int as p,
  3 * (regexp_matches(t, '(?m)^\\w[\\w_-]+:\\s*$'))::int + 2 * (regexp_matches(t, '^\\s*---'))::int as y from s)
  select page_id, case when f like '%.md' then 'markdown' when f like '%.py' then 'python' when f like '%.yaml' or f like '%.yml' then 'yaml' when f like '%.json' then 'json' when f like '%.txt' then 'plain'
  when greatest(m, p, y) = 0 then 'plain' when m = greatest(m, p, y) then 'markdown' when p = greatest(m, p, y) then 'python' else 'yaml' end as content_type from p""")
def txt15_content_type_of_file(spark, sf):
    name = F.concat("url", F.element_at(F.array(*map(F.lit, (".md", ".py", ".yaml", "", ".txt"))), (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, sf, "pages").select("page_id", T.content_type_of_file(F.col("html"), name).alias("content_type"))


@query("""select page_id, case when contains(html, '```') or regexp_matches(html, '(?m)^\\s{4}\\w') then true end as has_code, case when regexp_matches(html, '(?m)^\\s*\\d+\\.\\s') then true end as has_steps,
  case when contains(html, '|') and regexp_matches(html, '\\|[-─]+\\|') then true end as has_table, nullif(regexp_extract(html, '(?m)^#{1,6}\\s+(.+)$', 1), '') as section_heading from pages""")
def txt16_enrich_metadata(spark, sf):
    return table(spark, sf, "pages").select("page_id", *[c.alias(k) for k, c in T.structure_flags(F.col("html")).items()])


@query("select doc_id, regexp_matches(text, '[.!?]\\s*$') as ends, regexp_matches(text, '^\\s*[A-Z\\d]') as starts from documents")
def txt17_boundary_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.ends_sentence(F.col("text")).alias("ends"), T.starts_sentence(F.col("text")).alias("starts"))


ANSWERS = "(select conv_id, turn, text || ' [source:doc' || (turn % 3)::varchar || '] Then more. [source:doc' || (conv_id % 2)::varchar || '] [Chunk7]' as answer from conversations)"


def answers(spark, sf):
    tag = lambda c: F.concat(F.lit(" [source:doc"), c.cast("string"), F.lit("]"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", tag(F.col("turn") % 3), F.lit(" Then more."), tag(F.col("conv_id") % 2), F.lit(" [Chunk7]")).alias("answer"))


@query(f"""select tag, count(*) as n, count(distinct (conv_id, turn)) as n_answers from (select conv_id, turn, unnest(regexp_extract_all(answer, '\\[source:([^\\]]+)\\]', 1)) as tag from {ANSWERS}) group by tag""")
def txt18_parse_citations(spark, sf):
    each = answers(spark, sf).select("conv_id", "turn", F.explode(T.sentences(F.col("answer"), T.SENTENCE_END)).alias("s"))
    tags = each.select("conv_id", "turn", F.explode(F.regexp_extract_all("s", F.lit(T.CITATION), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("conv_id", "turn").alias("n_answers"))


@query(f"select conv_id, turn, regexp_replace(answer, '\\[Chunk\\d+\\]|\\[unsupported\\]|\\[source:[^\\]]+\\]', '', 'g') as clean from {ANSWERS}")
def txt19_strip_citations(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", T.strip_citations(F.col("answer")).alias("clean"))


@query("""with r as (select item_id, text, case when item_id % 2 = 0 then '1. ' || text || chr(10) || '2) second try' else text end as reply from benchmark)
  select item_id, unnest(case when len(regexp_extract_all(reply, '(?m)^\\d+[.)]\\s*(.+)$', 1)) > 0 then list_transform(regexp_extract_all(reply, '(?m)^\\d+[.)]\\s*(.+)$', 1), lambda x: trim(x)) else [text] end) as item from r""")
def txt20_numbered_list(spark, sf):
    reply = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("1. "), F.regexp_replace("text", "\\n", "\n"), F.lit("\n2) second try"))).otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.explode(T.numbered_items(reply, F.col("text"))).alias("item"))


@query("select event_id, event_type, cast(json_extract_string(props, '$.page') as varchar) as page, coalesce(nullif(regexp_extract(props, '\\d+'), '')::int, 5) as score from events")
def txt21_json_reply(spark, sf):
    e = table(spark, sf, "events").withColumn("reply", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    return e.select("event_id", "event_type", T.json_reply(F.col("reply"), "page string").page.alias("page"), T.digit_score(F.col("props")).alias("score"))


@query(f"select doc_id, coalesce(nullif(regexp_extract(text, '\\b\\d+\\b'), ''), {WORDS}[-1]) as token from documents")
def txt22_key_token(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.key_token(F.col("text")).alias("token"))


@query("""with t as (select *, case when doc_id % 3 = 0 then text || ' CVE-2024-1234 and 1.2.3 on n9k-abc' else text end as s from documents)
  select doc_id, array_to_string(list_concat(regexp_extract_all(s, '(?i)CVE-\\d{4}-\\d+'), list_concat(regexp_extract_all(s, '(?i)CSC[a-z]{2}\\d+'), list_concat(regexp_extract_all(s, '\\b\\d+\\.\\d+\\.\\d+\\b'), regexp_extract_all(s, '(?i)\\bN[0-9]K-[A-Z0-9-]+\\b')))), ' ') as ids from t""")
def txt24_identifiers(spark, sf):
    s = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" CVE-2024-1234 and 1.2.3 on n9k-abc"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.identifiers(s), " ").alias("ids"))


@query(f"""select lang, count(*) as n, round(avg(length(text)), 6) as chars, round(avg(len({WORDS})), 6) as words, round(sum(length(text)) / sum(greatest(1, length(text) // 4)), 6) as chars_per_token,
  round(sum(len({WORDS})) / sum(greatest(1, length(text) // 4)), 6) as words_per_token from documents group by lang""")
def txt25_token_density(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.length("text").alias("c"), F.size(T.words(F.col("text"))).alias("w"), T.approx_tokens(F.col("text")).alias("t"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("chars"), F.round(F.avg("w"), 6).alias("words"), F.round(F.sum("c") / F.sum("t"), 6).alias("chars_per_token"), F.round(F.sum("w") / F.sum("t"), 6).alias("words_per_token"))
