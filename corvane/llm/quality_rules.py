"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

Everything is made of DataFrame functions. Per document the base measures are computed inside one row (no shuffle of
words), the sketches are merged map-side, and the thresholds come back by a join on (lang, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.store import settled

SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOL = "[#*$%&|<>]"


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda parameter is evaluated once, an inlined expression per use."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS, -1), "")


def repeated_words(hashes: Column, window: int = 5) -> Column:
    """Words lying in a ``window``-word run that occurs at least twice in the array, the first occurrence included."""
    n = F.size(hashes)
    runs = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(hashes, i, window))))

    def covered(runs: Column) -> Column:
        def starts(pairs: Column) -> Column:
            kept = F.filter(pairs, lambda p, i: ((i > 0) & (pairs[F.greatest(i - 1, F.lit(0))]["h"] == p["h"])) | ((i < F.size(pairs) - 1) & (pairs[F.least(i + 1, F.size(pairs) - 1)]["h"] == p["h"])))
            return F.sort_array(F.transform(kept, lambda p: p["i"]))

        pairs = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            bound(pairs, starts),
            zero,
            lambda a, s: F.struct((a["n"] + window - F.greatest(a["end"] - s, F.lit(0))).alias("n"), (s + window).alias("end")),
            lambda a: a["n"],
        )

    return F.coalesce(bound(runs, lambda r: F.when(F.size(F.array_distinct(r)) < F.size(r), covered(r))), F.lit(0)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base measures of every whole text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    filled = lambda lines: F.filter(lines, lambda x: x.rlike(WORD))
    repeats = lambda lines: F.when(F.size(F.array_distinct(lines)) < F.size(lines), bound(filled(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))))
    one = docs.select(
        "doc_id",
        "lang",
        "source",
        words(text).alias("w"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.coalesce(bound(F.split(text, "\n", -1), repeats), F.lit(0)).cast("long").alias("n_dup_lines"),
    )
    return one.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        bound(F.transform("w", lambda x: F.xxhash64(x)), repeated_words).alias("n_repeat_words"),
    )


#: Ratio judged -> (sides beyond which it is far, the least number of words or characters that one event makes).
RATIOS = {"r_symbols": ("high", 1), "r_dup": ("high", 1), "r_repeat": ("high", 10), "r_length": ("both", 0)}
#: Quantiles and their distance from the median in standard deviations of a normal distribution.
QUANTILES = {0.75: 0.6745, 0.9: 1.2816}


def ratios(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({
        "r_symbols": F.col("n_symbols") / n,
        "r_dup": F.col("n_dup_lines") / n,
        "r_repeat": F.col("n_repeat_words") / n,
        "r_length": F.col("word_chars") / n,
    })


def limits_of(sketches, spread: float) -> dict[str, Column]:
    """high_<ratio> and low_<ratio> of one set of sketches; ``sketches``: a function from a measure's name to its sketch."""
    q = lambda r, p: F.kll_sketch_get_quantile_double(sketches(r), F.lit(p))
    out = {}
    for r, (sides, unit) in RATIOS.items():
        event = F.lit(float(unit)) / F.greatest(q("n_words", 0.5), F.lit(1.0))
        for name, sign in (("high", 1), ("low", -1)):
            if sides in (name, "both"):
                scale = F.greatest(event, *[sign * (q(r, p if sign > 0 else 1 - p) - q(r, 0.5)) / z for p, z in QUANTILES.items()])
                out[f"{name}_{r}"] = q(r, 0.5) + sign * spread * scale
    return out


def thresholds(measured: DataFrame, spread: float = 6.0, weight: int = 200) -> DataFrame:
    """lang, source, high_<ratio>, low_<ratio> from KLL sketches: the median and ``spread`` times the scale on that side.

    The scale is the larger of two estimates from quantiles and of one event in a document of the group's median length, so
    nothing but the data sets it. Only documents that pass the base rules feed the sketches. They are built per (lang,
    source) and merged per language; a group's limits are the mean of its own, weighing its number of documents, and its
    language's, weighing ``weight`` documents: a small group leans on its language, alike at every size.
    """
    measures = ["n_words", *RATIOS]
    fed = ratios(measured.where(~F.col("base_failed"))).select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), *[F.col(m).cast("double").alias(m) for m in measures])
    group = fed.groupBy("lang", "source").agg(*[F.kll_sketch_agg_double(m).alias(m) for m in measures])
    lang = group.groupBy("lang").agg(*[F.kll_merge_agg_double(m).alias(m) for m in measures])
    own = group.select("lang", "source", F.kll_sketch_get_n_double("n_words").alias("n"), *[c.alias(k) for k, c in limits_of(F.col, spread).items()])
    base = lang.select("lang", *[c.alias(f"lang_{k}") for k, c in limits_of(F.col, spread).items()])
    mean = lambda k: ((F.col("n") * F.col(k) + weight * F.col(f"lang_{k}")) / (F.col("n") + weight)).alias(k)
    return own.join(base, "lang").select("lang", "source", *[mean(k) for k in limits_of(F.col, spread)])


def quality_rules(docs: DataFrame, spread: float = 6.0, weight: int = 200) -> DataFrame:
    """doc_id, lang, source, base measures, base_failed, kept of every row of ``docs`` (doc_id, text, lang, source).

    Null and empty texts have no words and fail the base rule; null lang or source count as empty ones. Repeated rows are
    judged alike and all stay. A document is dropped if it fails the base rule or any ratio lies beyond its group's limits;
    a group without a document that passes the base rule has none. An empty table gives an empty result; further columns of
    ``docs`` are ignored.
    """
    n = F.col("n_words")
    measured = settled(measures(docs).withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)), "quality-measures")
    limits = thresholds(measured, spread, weight)
    keyed = ratios(measured).withColumns({"lang_": F.coalesce("lang", F.lit("")), "source_": F.coalesce("source", F.lit(""))})
    joined = keyed.join(limits.withColumnsRenamed({"lang": "lang_", "source": "source_"}), ["lang_", "source_"], "left")
    far = F.lit(False)
    for k in limits.columns[2:]:
        side, r = k.split("_", 1)
        far = far | F.coalesce(F.col(r) > F.col(k) if side == "high" else F.col(r) < F.col(k), F.lit(False))
    return joined.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"))
