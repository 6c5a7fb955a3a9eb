"""Understanding, rewriting and routing of queries: rule tables compiled to Column ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import IDENTIFIERS, content_words, identifiers, words

# Signals of the query types in order of precedence, and the rewriting each asks for.
TYPES = {
    "exact_term": (IDENTIFIERS, "NONE"),
    "negation": ((r"\bnot\s+\w+\b", r"\bexcept\b", r"\bexcluding\b", r"\bnone\b"), "FILTER"),
    "comparative": ((r"\bdifference between\b", r"\bcompare\b", r"\bvs\.?\b", r"\bversus\b", r"\bpros and cons\b"), "DECOMPOSE"),
    "multi_hop": ((r"\band (what|how|why)\b", r"\bwhich\b.{0,30}\band\b", r"\bthen\b"), "DECOMPOSE"),
    "procedural": ((r"\bhow (do|to|can)\b", r"\bsteps? to\b", r"\bprocedure\b", r"\bconfigure\b"), "HYDE+EXPAND"),
    "factual": ((r"\bwhat is\b", r"\bhow many\b", r"\bwhat are the\b", r"\bdefine\b"), "HYDE"),
    "general": ((r"\bexplain\b", r"\bwhat is a\b", r"\bhow does .{0,20} work\b"), "MULTI_QUERY"),
}
TECHNIQUES = {"NONE": "PASSTHROUGH", "FILTER": "PASSTHROUGH", "DECOMPOSE": "DECOMPOSE", "HYDE+EXPAND": "HYDE", "HYDE": "HYDE", "MULTI_QUERY": "MULTI_QUERY"}


def any_of(text: Column, patterns, flags: str = "") -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(flags + p)
    return out


def query_type(query: Column, compat: bool = False) -> Column:
    """The first type with a signal, else general. Identifiers are found in either case; with ``compat`` they are looked for
    in the lower-cased query as written, which misses all but version numbers."""
    low = F.lower(query)
    out = F.lit("general")
    for name, (patterns, _) in reversed(TYPES.items()):
        out = F.when(any_of(low, patterns, "(?i)" if name == "exact_term" and not compat else ""), name).otherwise(out)
    return out


def complexity(query: Column, kind: Column) -> Column:
    """Additive, at most 1: short or long, several "and", chained questions, several question marks, hard types."""
    low, n = F.lower(query), F.size(words(query))
    ands = (F.length(low) - F.length(F.regexp_replace(low, " and ", ""))) / 5
    add = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    total = add(n <= 4, 0.3) + add(n >= 20, 0.2) + add(ands >= 2, 0.3) + add(low.rlike(r"\band\s+what\b|\band\s+how\b"), 0.4) + add(query.rlike(r"\?.*\?"), 0.4) + add(kind == "multi_hop", 0.3) + add(kind == "comparative", 0.2)
    return F.round(F.least(F.lit(1.0), total), 6)


def optimizer_complexity(query: Column, kind: Column) -> Column:
    low, n = F.lower(query), F.size(words(query))
    add = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), add(n <= 4, 0.3) + add(low.contains(" and "), 0.3) + add(query.rlike(r"\?.*\?"), 0.4) + add(kind.isin("multi_hop", "comparative"), 0.2)), 6)


def sub_questions(query: Column, kind: Column) -> Column:
    """Several questions by their marks, or a comparison or chain cut once at "and"; else none."""
    parts = F.filter(F.transform(F.split(query, "\\?"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    asked = F.transform(parts, lambda p: F.concat(p, F.lit("?")))
    cut = F.split(query, "\\s+and\\s+", 2)
    two = F.array(F.concat(F.trim(cut[0]), F.lit("?")), F.concat(F.lit("And "), F.trim(F.try_element_at(cut, F.lit(2))), F.lit("?")))
    none = F.array().cast("array<string>")
    by_and = F.lower(query).contains(" and ") & kind.isin("multi_hop", "comparative") & (F.size(cut) == 2)
    return F.when(query.contains("?"), F.when(F.size(asked) > 1, asked).otherwise(none)).when(by_and, two).otherwise(none)


def technique(kind: Column) -> Column:
    out = F.lit("MULTI_QUERY")
    for name, (_, rewrite) in TYPES.items():
        out = F.when(kind == name, TECHNIQUES[rewrite]).otherwise(out)
    return out


def analysis(query: Column, compat: bool = False) -> dict[str, Column]:
    kind = query_type(query, compat)
    hard = complexity(query, kind)
    return {"query_type": kind, "complexity": hard, "needs_rewrite": ~kind.isin("exact_term", "negation") & (hard >= 0.1), "sub_questions": sub_questions(query, kind), "exact_terms": identifiers(query), "word_count": F.size(words(query)), "technique": technique(kind)}


# Words that say nothing about a vocabulary gap.
GAP_STOPWORDS = ("what", "how", "does", "the", "and", "for", "with", "are", "can", "will")


def vocabulary_gap(query: Column, vocabulary: Column) -> Column:
    """1 less the share of the query's words in the vocabulary; 0.5 without words."""
    q = content_words(query, 3, GAP_STOPWORDS)
    return F.when(F.size(q) == 0, F.lit(0.5)).otherwise(1 - F.size(F.array_intersect(q, vocabulary)) / F.greatest(F.size(q), F.lit(1)))


# Substrings that flag what a query needs.
NEEDS = {
    "needs_retrieval": ("our", "internal", "runbook", "latest", "current", "version", "cve-", "csc", "customer", "tenant"),
    "needs_realtime": ("right now", "active", "currently", "live", "fault", "alert"),
    "needs_tool": ("calculate", "total", "sum", "how many", "count"),
}
NOT_GENERAL = ("our", "internal", "specific", "latest", "cve", "current", "customer")
ARITHMETIC = r"\d+\s*[×x\*]\s*\d+|\d+\s*[+\-]\s*\d+"


def has_any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def needs(query: Column) -> dict[str, Column]:
    low = F.lower(query)
    out = {k: has_any(low, v) for k, v in NEEDS.items()}
    out["needs_tool"] = out["needs_tool"] | low.rlike(ARITHMETIC)
    return out | {"is_general": ~has_any(low, NOT_GENERAL)}


# What a model trained up to a date can't know.
RECENCY = ("latest", "current", "newest", "today", "now", "recent")
PRIVATE = ("our", "we ", "my org", "my company", "internal", "runbook", "ticket", "incident", "sla", "customer", "tenant")


def cutoff_risk(query: Column, cutoff: Column) -> dict[str, Column]:
    """n_signals and risk: critical with an advisory or private data, high from two signals, medium with one, else low."""
    low = F.lower(query)
    years = F.size(F.filter(F.regexp_extract_all(query, F.lit(r"\b(202[3-9]|203\d)\b"), F.lit(1)), lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(1)) > cutoff))
    versions = F.size(F.regexp_extract_all(query, F.lit(r"\b\d+\.\d+(?:\.\d+)?\b"), F.lit(0)))
    flag = lambda c: F.when(c, 1).otherwise(0)
    always = flag(query.rlike(r"(?i)CVE-\d{4}-\d+")) + flag(query.rlike(r"(?i)CSC[a-z]{2}\d+")) + flag(has_any(low, PRIVATE))
    n = years + flag(has_any(low, RECENCY)) + versions + always
    return {"n_signals": n, "risk": F.when(always > 0, "critical").when(n >= 2, "high").when(n == 1, "medium").otherwise("low")}


# Routing categories, their route and their patterns in order.
ROUTES = {
    "knowledge_cutoff": ("static-rag", (r"\b(latest|current|newest|recent|now|today)\b", r"\b202[4-9]\b|\b203\d\b", r"CVE-\d{4}-\d+", r"CSC[a-z]{2}\d+", r"\bv?\d+\.\d+(?:\.\d+)?\b")),
    "private_data": ("static-rag", (r"\b(our|my|we|internal|runbook|sla|customer|tenant|incident|ticket)\b", r"\b(acme|customer\s+\w+|client)\b", r"\b(naming convention|change window|escalation|on-?call)\b", r"\b(post-?mortem|outage|root cause)\b")),
    "realtime_data": ("realtime-rag", (r"\b(current(ly)?|right now|live|active|status|fault|alert|alarm)\b", r"\b(up|down|reachable|unreachable|connected|disconnected)\b", r"\b(metric|latency|throughput|utilization|cpu|memory)\b", r"\b(open ticket|active incident|current change)\b")),
    "arithmetic": ("tool", (r"\b(calculate|compute|total|sum|how many|count|average|percentage|ratio)\b", r"\b\d+\s*[×x\*]\s*\d+", r"\b\d+\s*[+\-]\s*\d+", r"\b(bandwidth|capacity|throughput)\s+\w+\s+\d+")),
    "negation_filter": ("tool", (r"\bnot\s+(affected|running|using|configured|in)\b", r"\b(except|excluding|without|other than)\b", r"\bwhich\s+\w+\s+are\s+not\b", r"\b(exclude|filter out|remove)\b")),
    "constraint_filter": ("tool", (r"\b(support(?:s)?\s+\w+\s+and)\b", r"\b(price|cost|budget)\s*[<>≤≥]\s*\$?\d+", r"\ball\s+\w+\s+that\s+(have|support|are)\b", r"\bwhich\s+\w+\s+(have|support|include)\s+both\b")),
    "general_knowledge": ("parametric", (r"\bwhat\s+is\s+(bgp|ospf|vxlan|vlan|tcp|udp|http|dns|dhcp|nat)\b", r"\bhow\s+does\s+(spanning tree|routing|switching|encapsulation)\b", r"\bexplain\s+(the\s+)?(concept|protocol|algorithm|mechanism)\b")),
}


def route_signals(query: Column) -> Column:
    """Categories with a matching pattern, in the table's order."""
    low = F.lower(query)
    return F.array_compact(F.array(*[F.when(any_of(low, p, "(?i)"), k) for k, (_, p) in ROUTES.items()]))


def route(signals: Column) -> Column:
    of = lambda r: F.arrays_overlap(signals, F.array(*[F.lit(k) for k, (x, _) in ROUTES.items() if x == r]))
    static, live, tool, plain = of("static-rag"), of("realtime-rag"), of("tool"), of("parametric")
    return F.when(tool & ~static & ~live & ~plain, "tool").when(static & live, "hybrid").when(live, F.when(tool, "hybrid").otherwise("realtime-rag")).when(static, "static-rag").otherwise("parametric")


def route_plan(query: Column, signals: Column, routed: Column) -> dict[str, Column]:
    """Retrieval steps, tools and confidence (high up to one signal, medium up to three, else low)."""
    low, has = F.lower(query), lambda c: F.array_contains(signals, c)
    static, live = routed.isin("static-rag", "hybrid"), routed.isin("realtime-rag", "hybrid")
    private = static & (has("private_data") | has_any(low, ("our", "internal")))
    public = static & has("knowledge_cutoff")
    fault, node, ticket = (live & has_any(low, w) for w in (("fault", "alert", "alarm", "active"), ("up", "down", "status", "reachable"), ("ticket", "incident")))
    steps = F.array_compact(F.array(F.when(private, "private knowledge base"), F.when(public, "public documentation since 2024"), F.when(static & ~private & ~public, "primary knowledge base"), F.when(fault, "live: faults"), F.when(node, "live: node health"), F.when(ticket, "live: incidents"), F.when(live & ~fault & ~node & ~ticket, "live: system data")))
    tools = F.array_compact(F.array(F.when(has("arithmetic"), "arithmetic"), F.when(has("negation_filter"), "set difference"), F.when(has("constraint_filter"), "constraint filter")))
    n = F.size(signals)
    return {"retrieval": steps, "tools": tools, "confidence": F.when(n <= 1, "high").when(n <= 3, "medium").otherwise("low")}


def paraphrases(query: Column, n: int = 3) -> Column:
    """The template paraphrases used when no model writes them."""
    made = F.array(F.concat(F.lit("Explain: "), query), F.concat(F.lit("Details about "), query), F.concat(query, F.lit(" overview")))
    return F.slice(made, 1, n)


def decomposed(query: Column) -> Column:
    """Cut once at " and "; without one the query alone."""
    return F.transform(F.split(query, " and ", 2), lambda p: F.trim(p))


def command(text: Column) -> Column:
    """exit, stats, help or clear of a typed line, else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("exit", "quit", "q", "/exit", "/quit"), "exit").when(t.isin("stats", "/stats"), "stats").when(t.isin("help", "/help", "?"), "help").when(t.isin("clear", "/clear"), "clear")
