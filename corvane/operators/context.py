"""Filling, ordering and trimming a context window; conversation history. Budgets are tokens unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_within(frame: DataFrame, cost: Column, budget: int, by: list[str], order: list[Column]) -> DataFrame:
    """Rows in order while their running cost is within the budget; stops at the first that isn't."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= budget)


def history_suffix(turns: DataFrame, cost: Column, budget: int, by: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last turns whose costs together are within the budget."""
    return prefix_within(turns, cost, budget, [by], [F.desc(turn)])


def hybrid_history(turns: DataFrame, cost: Column, budget: int, reserve: int = 300, by: str = "conv_id", turn: str = "turn") -> DataFrame:
    """All turns with kept: within budget - reserve from the end; the others are for a summary."""
    w = Window.partitionBy(by).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("kept", F.sum(cost).over(w) <= budget - reserve)


def first_fit(items: DataFrame, budget: int, by: str, id: str, cost: str, score: str) -> DataFrame:
    """by, ids, used: by falling score every item that still fits; one that doesn't is passed over."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("o"), F.col(id).alias("id"), F.col(cost).cast("long").alias("c"))))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ids"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["c"] <= budget
        return F.struct(F.when(fits, a["used"] + x["c"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["ids"], F.array(x["id"].cast("long")))).otherwise(a["ids"]).alias("ids"))

    return items.groupBy(by).agg(ordered.alias("s")).select(by, F.aggregate("s", zero, step).alias("r")).select(by, "r.ids", "r.used")


def threshold_fit(items: DataFrame, budget: int, by: str, id: str, cost: str, score: str, threshold: float = 0.7, fallback: int = 1) -> DataFrame:
    """first_fit() of the items with score >= threshold; where none has, of the ``fallback`` best."""
    w = Window.partitionBy(by)
    ranked = items.withColumns({"__best": F.max(score).over(w), "__r": F.row_number().over(w.orderBy(F.desc(score), id))})
    kept = ranked.where((F.col(score) >= threshold) | ((F.col("__best") < threshold) & (F.col("__r") <= fallback)))
    return first_fit(kept.drop("__best", "__r"), budget, by, id, cost, score)


# Shares of the budget by tier.
TIER_SHARES = {"core": 0.50, "supporting": 0.33, "general": 0.17}


def selected(items: DataFrame, strategy: str, budget: int, by: str, id: str, cost: str, score: str, tier: str, most: int = 10, threshold: float = 0.7, fallback: int = 1) -> DataFrame:
    """by, ids, used of the items one strategy picks: the ``most`` best (fixed_k), what fits (dynamic), all from ``threshold`` on or the
    ``fallback`` best (threshold), or what fits each tier's share of the budget (hierarchical)."""
    w = Window.partitionBy(by)
    packed = lambda rows: rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("o"), F.col(id).cast("long").alias("id")))), lambda x: x["id"]).alias("ids"), F.sum(cost).cast("long").alias("used"))
    if strategy == "fixed_k":
        return packed(items.withColumn("__r", F.row_number().over(w.orderBy(F.desc(score), id))).where(F.col("__r") <= most))
    if strategy == "dynamic":
        return first_fit(items, budget, by, id, cost, score)
    if strategy == "threshold":
        ranked = items.withColumns({"__best": F.max(score).over(w), "__r": F.row_number().over(w.orderBy(F.desc(score), id))})
        return packed(ranked.where((F.col(score) >= threshold) | ((F.col("__best") < threshold) & (F.col("__r") <= fallback))))
    if strategy != "hierarchical":
        raise ValueError(f"unknown strategy {strategy!r}")
    parts = [first_fit(items.where(F.col(tier) == t), int(budget * share), by, id, cost, score) for t, share in TIER_SHARES.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy(by).agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"), F.sum("used").alias("used"))


def by_strategy(items: DataFrame, strategies: DataFrame, budget: int, by: str, id: str, cost: str, score: str, tier: str, **options) -> DataFrame:
    """by, strategy, ids, used: every group's items picked by the strategy named for it in ``strategies`` (by, strategy)."""
    out = None
    for name in ("fixed_k", "dynamic", "threshold", "hierarchical"):
        own = items.join(strategies.where(F.col("strategy") == name), by)
        part = selected(own, name, budget, by, id, cost, score, tier, **options).select(by, F.lit(name).alias("strategy"), "ids", "used")
        out = part if out is None else out.unionByName(part)
    return out


def trimmed(items: DataFrame, limit: int, by: str, order: str, cost: Column, fixed: Column | int = 0) -> DataFrame:
    """Items in order without the last ones, so that together with ``fixed`` they stay under ``limit``."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("running", F.sum(cost).over(w) + fixed).where(F.col("running") < limit)


def budget_plan(window: Column, system: Column, few_shot: Column, documents: Column, history: Column, question: Column, chunk: Column) -> dict[str, Column]:
    """How many chunks fit, tokens per query, share of the window in per cent, and whether that is within 85 of them."""
    total = system + few_shot + documents + history + question
    return {"max_chunks": F.greatest(F.lit(1), F.floor(documents / chunk).cast("long")), "total": total, "utilisation": F.round(total / window * 100, 6), "is_safe": total <= window * 0.85}


def filling(items: DataFrame, by: str, cost: str, score: str, budget: int) -> DataFrame:
    """by, n, tokens, utilisation (per cent of the budget), average_score (0 without items)."""
    t = F.coalesce(F.sum(cost), F.lit(0))
    return items.groupBy(by).agg(F.count(cost).alias("n"), t.alias("tokens"), F.round(utilisation(t, F.lit(budget)), 6).alias("utilisation"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("average_score"))


def middle_out(rank: Column, n: Column) -> Column:
    """Place from 1 of a rank so that the best stand at both ends: the first half in order, then the rest backwards; up to two stay."""
    half = F.ceil(n / 2)
    return F.when((n <= 2) | (rank <= half), rank).otherwise(n + half + 1 - rank).cast("int")


# Estimated recall at ten places from the first to the last of a window.
RECALL_BY_POSITION = (0.80, 0.75, 0.70, 0.63, 0.58, 0.55, 0.57, 0.60, 0.65, 0.75)


def estimated_recall(position: Column, total: Column) -> Column:
    """Linear interpolation of the table at position / (total - 1) (position from 0); 0.80 for a single document."""
    table = F.array(*map(F.lit, RECALL_BY_POSITION))
    x = position / F.greatest(total - 1, F.lit(1)) * (len(RECALL_BY_POSITION) - 1)
    lo = F.floor(x).cast("int")
    hi = F.least(lo + 1, F.lit(len(RECALL_BY_POSITION) - 1))
    a, b = F.element_at(table, lo + 1), F.element_at(table, hi + 1)
    return F.when(total <= 1, F.lit(0.80)).otherwise(a + (x - lo) * (b - a))


def attention_by_position(f: Column) -> Column:
    return 0.60 + 0.20 * F.cos(2 * F.pi() * f)


def utilisation(used: Column, budget: Column) -> Column:
    return used / F.greatest(budget, F.lit(1)) * 100


def chosen_strategy(n: Column, mean_score: Column, tiers: Column, threshold: float = 0.7, most: int = 10) -> Column:
    """hierarchical if any tier isn't general, threshold if the mean score is low, dynamic for many chunks, else fixed_k."""
    return F.when(tiers, "hierarchical").when(mean_score < threshold, "threshold").when(n > most, "dynamic").otherwise("fixed_k")


def budget_split(total: Column) -> dict[str, Column]:
    """Shares of a window: system 5, documents 60, history 15, question 5, answer 15 per cent."""
    return {k: F.floor(total * v).cast("long") for k, v in (("system", 0.05), ("documents", 0.60), ("history", 0.15), ("question", 0.05), ("answer", 0.15))}


def prompt(system: str, chunks: DataFrame, question: Column, by: str, order: str, source: str, content: str) -> DataFrame:
    """by, prompt: numbered sources in order, then the question."""
    entry = F.format_string("[%d] (source: %s)\n%s", F.col(order).cast("int"), F.col(source).cast("string"), F.col(content))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e")))), lambda x: x["e"]), "\n\n")
    return chunks.groupBy(by).agg(listed.alias("context"), F.first(question).alias("q")).select(by, F.concat(F.lit(system + "\n\nContext:\n"), "context", F.lit("\n\nQuestion: "), "q").alias("prompt"))


def rag_messages(system: str, chunks: DataFrame, history: DataFrame, question: Column, by: str, few_shot: str = "") -> DataFrame:
    """by, system, messages: the earlier turns, then one with the documents, examples and the question.

    chunks: by, rank, source, content, score; history: by, turn, role, text.
    """
    entry = F.format_string("[Doc %d] Source: %s | Relevance: %.2f\n%s\n", F.col("rank").cast("int"), F.col("source").cast("string"), F.col("score").cast("double"), F.col("content"))
    context = chunks.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]), "\n").alias("context"), F.first(question).alias("q"))
    turns = history.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("turns"))
    last = F.struct(F.lit("user").alias("role"), F.concat(F.lit("CONTEXT DOCUMENTS:\n"), "context", F.lit(few_shot), F.lit("\nQUESTION: "), "q").alias("content"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return context.join(turns, by, "left").select(by, F.lit(system).alias("system"), F.concat(F.coalesce("turns", none), F.array(last)).alias("messages"))


def section_tokens(sections: dict[str, Column]) -> dict[str, Column]:
    """Words over 0.75 of every section, rounded down, and their total."""
    from corvane.functions.text import word_tokens

    each = {k: word_tokens(v) for k, v in sections.items()}
    return each | {"total": sum(each.values(), F.lit(0))}


def relevant_sentences(docs: DataFrame, id: str, text: str, terms: Column, most: int = 3, stopwords=()) -> DataFrame:
    """id, extract: the ``most`` sentences (split at full stops) with the largest share of the query's words, in their order.

    ``terms``: array of lower-cased words. Punctuation stays at the words, as blanks alone separate them.
    """
    from corvane.functions.text import among, dot_sentences

    parts = docs.select(id, terms.alias("q"), F.posexplode(dot_sentences(F.col(text), 0)).alias("pos", "s"))
    own = F.filter(F.array_distinct(F.split(F.lower("s"), "\\s+")), lambda w: ~among(w, stopwords))
    scored = parts.withColumn("score", F.size(F.array_intersect(own, "q")) / F.greatest(F.size("q"), F.lit(1)))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy(id).orderBy(F.desc("score"), "pos"))).where(F.col("r") <= most)
    return best.groupBy(id).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), ". "), F.lit(".")).alias("extract"))
