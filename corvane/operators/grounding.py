"""Checks of an answer against its context by shares of shared words, and reranking scores made of the same parts.

Empty denominators keep each operator's own convention, named in its docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import CITATION, content_words, sentences, strip_citations


def containment(a: Column, b: Column, empty: float | bool | None = 0.0) -> Column:
    """Share of array ``a``'s words that ``b`` has; ``empty`` where ``a`` has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))).otherwise(F.lit(empty))


def entailment(claim: Column, context: Column, least: int = 4) -> Column:
    """Share of the claim's words of at least ``least`` characters found in the context; 0 for none."""
    return containment(content_words(claim, least), content_words(context, least))


def claims(answer: Column, longer_than: int = 15) -> Column:
    """Sentences longer than so many characters, without citation tags."""
    return sentences(strip_citations(answer), "(?<=[.!?])\\s+", longer_than)


def graded(share: Column, good: float, fair: float, names: tuple[str, str, str]) -> Column:
    return F.when(share >= good, names[0]).when(share >= fair, names[1]).otherwise(names[2])


def grounded_answers(answers: DataFrame, id: list[str], answer: str, context: str, threshold: float = 0.30, longer_than: int = 15, none: float = 1.0) -> DataFrame:
    """id, n_claims, n_supported, score: share of claims whose entailment reaches ``threshold``; ``none`` without claims."""
    judged = F.transform(claims(F.col(answer), longer_than), lambda c: F.when(entailment(c, F.col(context)) >= threshold, 1).otherwise(0))
    one = answers.select(*id, judged.alias("j")).select(*id, F.size("j").alias("n_claims"), F.aggregate("j", F.lit(0), lambda a, x: a + x).alias("n_supported"))
    return one.withColumn("score", F.when(F.col("n_claims") > 0, F.round(F.col("n_supported") / F.greatest("n_claims", F.lit(1)), 6)).otherwise(F.lit(none)))


def best_match(answers: DataFrame, id: list[str], answer: str, context: str) -> DataFrame:
    """id, claim, match, score: of every claim the context sentence with the largest entailment, the first on ties; (0, null) without one."""
    ctx = sentences(F.col(context), "(?<=[.!?])\\s+", 0)
    rows = answers.select(*id, F.posexplode(claims(F.col(answer))).alias("claim_no", "claim"), ctx.alias("ctx"))
    scored = F.transform("ctx", lambda s, i: F.struct(F.round(entailment(F.col("claim"), s), 9).alias("score"), (-i).alias("o"), s.alias("match")))
    best = rows.withColumn("b", F.array_max(scored))
    hit = F.coalesce(F.col("b.score"), F.lit(0.0)) > 0
    return best.select(*id, "claim_no", F.when(hit, F.col("b.match")).alias("match"), F.round(F.when(hit, F.col("b.score")).otherwise(0.0), 9).alias("score"))


def attribution(answers: DataFrame, id: list[str], answer: str) -> DataFrame:
    """id, n_tags, n_sources, supported share of an answer's tagged sentences ("unsupported" tags count against it)."""
    tags = F.concat(F.regexp_extract_all(F.col(answer), F.lit(CITATION), F.lit(1)), F.transform(F.regexp_extract_all(F.col(answer), F.lit("\\[unsupported\\]"), F.lit(0)), lambda x: F.lit("unsupported")))
    one = answers.select(*id, tags.alias("t"))
    good = F.size(F.filter("t", lambda x: x != "unsupported"))
    return one.select(*id, F.size("t").alias("n_tags"), F.size(F.array_distinct("t")).alias("n_sources"), F.round(good / F.greatest(F.size("t"), F.lit(1)), 6).alias("supported"))


# ---- reranking -----------------------------------------------------------------------------------------------------------


def term_overlap(query: Column, doc: Column, stopwords=(), empty: float = 0.5) -> Column:
    """Share of the query's words found in the document; ``empty`` for a query without words."""
    return containment(content_words(query, 3, stopwords), content_words(doc, 3, stopwords), empty)


def clipped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def cross_encoder_score(cosine: Column, overlap: Column, doc: Column) -> Column:
    return clipped(0.50 * cosine + 0.35 * overlap + 0.15 * F.least(F.lit(1.0), F.size(F.split(doc, "\\s+")) / 80))


def rerank_score(cosine: Column, overlap: Column, doc: Column) -> Column:
    return clipped(0.45 * cosine + 0.40 * overlap + 0.15 * F.least(F.lit(1.0), F.size(F.split(doc, "\\s+")) / 100))


def pointwise_score(cosine: Column, overlap: Column) -> Column:
    """1 to 10, whole numbers, cut towards zero."""
    return F.greatest(F.lit(1), F.least(F.lit(10), (10 * (0.5 * cosine + 0.5 * overlap) + 1).cast("int")))


def pointwise_reason(score: Column) -> Column:
    return F.when(score >= 8, "directly relevant").when(score >= 5, "partly relevant").otherwise("hardly relevant")


def reranked(candidates: DataFrame, score: str, top: int, threshold: float = 0.0, query: str = "query_id", id: str = "doc_id") -> DataFrame:
    """Candidates with score >= threshold, the best ``top``, with old_rank and rank."""
    w = Window.partitionBy(query).orderBy(F.desc(score), id)
    kept = candidates.where(F.col(score) >= threshold).withColumnRenamed("rank", "old_rank")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def answer_relevance(query: Column, answer: Column, cosine: Column, stopwords=()) -> Column:
    """Half overlap, half cosine, within 0 and 1; 1 for a query without words."""
    q = content_words(query, 3, stopwords)
    return F.when(F.size(q) == 0, F.lit(1.0)).otherwise(clipped(0.5 * containment(q, content_words(answer, 3, stopwords)) + 0.5 * cosine))
