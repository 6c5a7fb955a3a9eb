"""Text scalars as Column expressions: everything here stays inside one row and one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without discriminative power for keyword search.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "to", "of", "and", "or", "in", "on", "at", "by", "for", "with",
    "as", "this", "that", "it", "its", "from", "into", "has", "have",
    "had", "will", "can", "should", "may", "might", "not", "no",
)
SENTENCE_END = "(?<=[.!?])\\s+"
SENTENCE_START = "(?<=[.!?])\\s+(?=[A-Z\\d])"


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row: a lambda's parameter isn't inlined."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def among(value: Column, words) -> Column:
    return value.isin(*words) if words else F.lit(False)


def tokenize(text: Column, stopwords=STOPWORDS) -> Column:
    """Lower-cased ASCII letter and digit runs of two characters or more, without ``stopwords``; order and repeats kept."""
    parts = F.split(F.lower(text), "[^a-zA-Z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~among(t, stopwords))


def content_words(text: Column, least: int = 3, stopwords=()) -> Column:
    """Distinct lower-cased Unicode words of at least ``least`` characters, in order of first appearance."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"(?U)\\b\\w{{{least},}}\\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~among(t, stopwords)))


def topic_keywords(text: Column, most: int = 8) -> Column:
    """The first ``most`` distinct words of four or more ASCII letters in alphabetical order, joined by blanks."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?U)\\b[a-zA-Z]{4,}\\b"), F.lit(0))))
    return F.array_join(F.slice(found, 1, most), " ")


def sentences(text: Column, pattern: str = SENTENCE_START, longer_than: int = 0) -> Column:
    return F.filter(F.transform(F.split(text, pattern), lambda s: F.trim(F.regexp_replace(s, "^\\s+|\\s+$", ""))), lambda s: F.length(s) > longer_than)


def dot_sentences(text: Column, longer_than: int = 20) -> Column:
    return F.filter(F.transform(F.split(text, "\\."), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: F.length(s) > longer_than)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\\n\\s*\\n"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: F.length(s) > 0)


def words(text: Column) -> Column:
    """Runs of non-blank characters; none for blank text."""
    return F.filter(F.split(text, "\\s+"), lambda w: F.length(w) > 0)


def wrapped(text: Column, width: int) -> Column:
    """Lines of whole words, as many to a line as fit ``width``; a longer word has a line of its own."""
    none = F.array().cast("array<string>")

    def step(a: Column, w: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        fits = last.isNotNull() & (F.length(last) + 1 + F.length(w) <= width)
        return F.when(fits, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, w)))).otherwise(F.concat(a, F.array(w)))

    return F.aggregate(words(text), none, step)


def approx_tokens(text: Column) -> Column:
    """One token per four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def word_tokens(text: Column) -> Column:
    """Words over 0.75, rounded down: the estimate without a tokenizer."""
    return F.floor(F.size(words(text)) / F.lit(0.75)).cast("int")


def token_slices(text: Column, most: int) -> Column:
    """Slices of ``int(most * 0.75)`` words joined by blanks."""
    step = max(1, int(most * 0.75))
    return bound(words(text), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.size(w), F.lit(step)), lambda i: F.array_join(F.slice(w, i, step), " "))).otherwise(F.array().cast("array<string>")))


# Signals of a text's kind and their weights.
CONTENT_SIGNALS = {
    "markdown": (("(?m)^#{1,6}\\s", 3), ("```", 2), ("(?m)^\\s*[-*]\\s", 1)),
    "python": (("(?m)^(def |class )", 3), ("(?m)^\\s{4}\\w", 1)),
    "yaml": (("(?m)^\\w[\\w_-]+:\\s*$", 2), ("(?m)^  \\w[\\w_-]+:", 2), ("^\\s*---", 2)),
}
EXTENSIONS = {".md": "markdown", ".py": "python", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".txt": "plain"}


def content_type(text: Column, compat: bool = False) -> Column:
    """markdown, python, yaml or plain by the signals' sum; ties go to the earlier of these.

    Text without any signal is plain; with ``compat`` it is markdown, the first name, as an arg-max over zeros gives it.
    """
    score = {k: sum((F.when(text.rlike(p), w).otherwise(0) for p, w in v), F.lit(0)) for k, v in CONTENT_SIGNALS.items()}
    score["python"] = score["python"] + F.when(text.contains("#") & text.contains("def "), 1).otherwise(0)
    return _best(score, compat)


def _best(score: dict[str, Column], compat: bool) -> Column:
    top = F.greatest(*score.values())
    out = F.lit("markdown" if compat else "plain")
    for k in reversed(score):
        out = F.when((score[k] == top) & (top > 0), k).otherwise(out)
    return out


def content_type_of_file(text: Column, filename: Column, compat: bool = False) -> Column:
    """The extension's kind, else that of the signals with their second set of weights."""
    heading, fence, item = (p for p, _ in CONTENT_SIGNALS["markdown"])
    score = {
        "markdown": sum((F.when(text.rlike(p), w).otherwise(0) for p, w in ((heading, 3), (fence, 2), (item, 1))), F.lit(0)),
        "python": F.when(text.rlike("(?m)^(def |class )"), 4).otherwise(0) + F.when(text.contains("import ") & text.contains("def "), 2).otherwise(0),
        "yaml": F.when(text.rlike("(?m)^\\w[\\w_-]+:\\s*$"), 3).otherwise(0) + F.when(text.rlike("^\\s*---"), 2).otherwise(0),
    }
    by_name = F.coalesce(*[F.when(filename.endswith(e), k) for e, k in EXTENSIONS.items()])
    return F.coalesce(by_name, _best(score, compat))


def structure_flags(text: Column) -> dict[str, Column]:
    """has_code, has_steps, has_table (true or null) and section_heading (first heading or null)."""
    only = lambda c: F.when(c, True)
    return {
        "has_code": only(text.contains("```") | text.rlike("(?m)^\\s{4}\\w")),
        "has_steps": only(text.rlike("(?m)^\\s*\\d+\\.\\s")),
        "has_table": only(text.contains("|") & text.rlike("\\|[-─]+\\|")),
        "section_heading": F.nullif(F.regexp_extract(text, "(?m)^#{1,6}\\s+(.+)$", 1), F.lit("")),
    }


def ends_sentence(text: Column) -> Column:
    return text.rlike("[.!?]\\s*\\z")


def starts_sentence(text: Column) -> Column:
    return text.rlike("\\A\\s*[A-Z\\d]")


CITATION = "\\[source:([^\\]]+)\\]"


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, "\\[Chunk\\d+\\]|\\[unsupported\\]|\\[source:[^\\]]+\\]", "")


def numbered_items(text: Column, fallback: Column) -> Column:
    """Items of a numbered list, or the fallback alone."""
    found = F.regexp_extract_all(text, F.lit("(?m)^\\d+[.)]\\s*(.+)$"), F.lit(1))
    return F.when(F.size(found) > 0, F.transform(found, lambda x: F.trim(x))).otherwise(F.array(fallback))


def json_reply(text: Column, schema: str) -> Column:
    """A model's JSON reply with its code fence removed; null where it isn't JSON of that schema."""
    return F.from_json(F.trim(F.regexp_replace(text, "```(?:json)?", "")), schema)


def digit_score(text: Column, default: int = 5) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, "\\d+", 0), F.lit("")).cast("int"), F.lit(default))


def key_token(text: Column) -> Column:
    """The first standalone number, else the last word."""
    return F.coalesce(F.nullif(F.regexp_extract(text, "\\b\\d+\\b", 0), F.lit("")), F.try_element_at(words(text), F.lit(-1)))


# Identifiers that a rewrite must not touch.
IDENTIFIERS = ("CVE-\\d{4}-\\d+", "CSC[a-z]{2}\\d+", "\\b\\d+\\.\\d+\\.\\d+\\b", "\\bN[0-9]K-[A-Z0-9-]+\\b")


def identifiers(text: Column) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)) for p in IDENTIFIERS]))
