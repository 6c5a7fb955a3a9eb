"""Keyword retrieval: an inverted index as tables, TF-IDF and BM25 as joins on terms.

Documents are tokenised once. A search over plain documents keeps only the queries' terms before anything is shuffled; an index
keeps the postings, sorted by term, so that later searches read those of their terms. The query side is as small as the
queries are; whether it is broadcast is left to the optimizer's size check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import STOPWORDS, tokenize
from corvane.sources.tables import written

#: Stands for the document itself among its terms; no token is empty.
WHOLE = ""


def exploded(docs: DataFrame, id: str, text: str, stopwords, head: bool) -> DataFrame:
    """id, dl, term of every token; with ``head`` a row WHOLE for the document, too."""
    tokens = docs.select(id, tokenize(F.col(text), stopwords).alias("t"))
    every = F.concat(F.array(F.lit(WHOLE)), F.coalesce("t", F.array().cast("array<string>"))) if head else F.col("t")
    return tokens.select(id, F.coalesce(F.size("t"), F.lit(0)).alias("dl"), F.explode(every).alias("term"))


def postings(docs: DataFrame, id: str = "doc_id", text: str = "text", stopwords=STOPWORDS) -> DataFrame:
    """id, dl, term, tf: one row per distinct term of a document."""
    return exploded(docs, id, text, stopwords, False).groupBy(id, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text", stopwords=STOPWORDS) -> DataFrame:
    """One row: n documents and their average length in terms (0 without documents)."""
    return docs.select(F.coalesce(F.size(tokenize(F.col(text), stopwords)), F.lit(0)).alias("dl")).agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_weight(tf: Column, dl: Column, avgdl: Column, idf: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.greatest(avgdl, F.lit(1.0))))


def query_terms(queries: DataFrame, id: str = "query_id", text: str = "text", stopwords=STOPWORDS) -> DataFrame:
    """id, term, qtf."""
    return queries.select(id, F.explode(tokenize(F.col(text), stopwords)).alias("term")).groupBy(id, "term").agg(F.count("*").alias("qtf"))


def top_k(scores: DataFrame, k: int, query: str = "query_id", id: str = "doc_id", score: str = "score") -> DataFrame:
    """Adds rank from 1 by falling score, ties by id, and keeps the first ``k`` of every query."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(id))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- an index that is kept -----------------------------------------------------------------------------------------------


@dataclass
class LexicalIndex:
    """postings (doc_id, dl, term, tf; a row WHOLE per document), terms (term, df) and stats (n, avgdl) as tables."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"postings": self.postings, "terms": self.terms, "stats": self.stats}


def summaries(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df) and (n, avgdl) of a postings table with a row WHOLE per document."""
    whole = F.col("term") == WHOLE
    n = F.count_if(whole)
    return term_stats(posts.where(~whole)), posts.agg(n.alias("n"), (F.coalesce(F.sum(F.when(whole, F.col("dl"))), F.lit(0)) / F.greatest(n, F.lit(1))).alias("avgdl"))


def index_of(posts: DataFrame) -> LexicalIndex:
    terms, stats = summaries(posts)
    return LexicalIndex(posts, written(terms, "terms"), written(stats, "stats"))


def marked_postings(docs: DataFrame, stopwords) -> DataFrame:
    posts = exploded(docs, "doc_id", "text", stopwords, True).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    return posts.repartition("term").sortWithinPartitions("term", "doc_id")


def build_index(docs: DataFrame, stopwords=STOPWORDS) -> LexicalIndex:
    """Tokenises ``docs`` (doc_id, text) once and writes the index; the files are sorted by term, so a search skips most of them."""
    return index_of(written(marked_postings(docs, stopwords), "postings"))


def append_to_index(index: LexicalIndex, docs: DataFrame, stopwords=STOPWORDS) -> LexicalIndex:
    """Adds documents to the postings and counts the statistics anew; nothing is looked up, so no document may be added twice."""
    return index_of(written(marked_postings(docs, stopwords), "postings", path=index.postings._kept_at, append=True))


def of_terms(posts: DataFrame, terms: DataFrame, most: int = 5000) -> DataFrame:
    """The postings of these terms: by a pushed filter while there are at most ``most`` of them, else by a join."""
    some = terms.limit(most + 1).collect()
    if len(some) <= most:
        return posts.where(F.col("term").isin([r["term"] for r in some]))
    return posts.join(terms, "term", "left_semi").select(posts.columns)


def index_scores(index: LexicalIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75, stopwords=STOPWORDS) -> DataFrame:
    """bm25_scores() from a kept index."""
    terms = query_terms(queries, stopwords=stopwords)
    wanted = terms.select("term").distinct()
    return scored(terms, of_terms(index.postings, wanted), of_terms(index.terms, wanted), index.stats, k1, b)


def index_search(index: LexicalIndex, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    return top_k(index_scores(index, queries, **options), k)


# ---- searches over plain documents ---------------------------------------------------------------------------------------


def scored(terms: DataFrame, posts: DataFrame, dfs: DataFrame, stats: DataFrame, k1: float, b: float) -> DataFrame:
    idf = dfs.join(F.broadcast(stats)).withColumn("idf", bm25_idf(F.col("n"), F.col("df")))
    hits = terms.join(idf, "term").join(posts, "term")
    part = F.col("qtf") * bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"), k1, b)
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def postings_of_terms(docs: DataFrame, terms: DataFrame, stopwords) -> DataFrame:
    """Postings of the given terms alone, with a row WHOLE per document; other tokens go before they are grouped."""
    wanted = terms.select("term").distinct().union(terms.sparkSession.createDataFrame([(WHOLE,)], "term string"))
    tokens = exploded(docs, "doc_id", "text", stopwords, True).join(wanted, "term", "left_semi")
    return tokens.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, stopwords=STOPWORDS) -> DataFrame:
    """query_id, doc_id, score of every document with a term of the query; repeated query terms count repeatedly."""
    terms = query_terms(queries, stopwords=stopwords)
    posts = postings_of_terms(docs, terms, stopwords)
    return scored(terms, posts, *summaries(posts), k1, b)


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    return top_k(bm25_scores(docs, queries, **options), k)


def tfidf_scores(docs: DataFrame, queries: DataFrame, stopwords=STOPWORDS) -> DataFrame:
    """query_id, doc_id, score: each distinct query term's share of the document times ln((n + 1) / (df + 1)) + 1."""
    terms = query_terms(queries, stopwords=stopwords)
    posts = postings_of_terms(docs, terms, stopwords)
    dfs, stats = summaries(posts)
    idf = dfs.join(F.broadcast(stats)).withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    part = F.col("tf") / F.greatest("dl", F.lit(1)) * F.col("idf")
    return terms.join(idf, "term").join(posts, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
