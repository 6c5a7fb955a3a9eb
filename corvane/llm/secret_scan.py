"""Secret scans: fixed base patterns, and sliding-window Shannon entropy over candidate strings.

DataFrame functions only. A window's entropy comes from running counts: with f(c) = c log2 c and S the sum of f over the
characters' counts, a window of w characters has entropy log2(w) - S / w, and moving it by one character changes two terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.quality_rules import bound

#: Kind -> (pattern as Spark takes it, group whose length is judged, least length).
BASE_KINDS = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
ENTROPY_KIND = "entropy"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character class of a candidate: (pattern of the whole string, least entropy of a window in bits). The first that fits counts.
CLASSES = {
    "hex": ("(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+", 3.0),
    "upper": ("(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+", 3.4),
    "lower": ("(?=.*[0-9])(?=.*[a-z])[a-z0-9]+", 3.4),
    "mixed": ("(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+", 3.7),
}
#: Strings that are no secrets although they look random: counting runs, placeholders, UUIDs, paths of several words.
ALLOWED = (
    "(?i)example|placeholder|changeme|your[_-]|xxxx|0123456789|123456789|abcdefgh|deadbeef",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^(?:[A-Za-z]+|[0-9]{1,4})(?:[/_-](?:[A-Za-z]+|[0-9]{1,4}))+$",
)
WINDOW = 20


FOUND = "array<struct<start:int,end:int,part:string>>"
STRETCH = 128


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, part>> of the leftmost non-overlapping matches; part is ``group`` of the match.

    Places are running sums of the lengths of gaps and matches. They are folded in stretches of ``STRETCH`` matches and the
    stretches put one behind another, as growing one array match by match takes the square of their number.
    """
    p, none = F.lit(pattern), F.array().cast(FOUND)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(a["found"], F.array(one)).alias("found"))

    def folded(rows: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), none.alias("found"))
        stretches = F.transform(F.sequence(F.lit(0), F.size(rows) - 1, F.lit(STRETCH)), lambda i: F.aggregate(F.slice(rows, i + 1, STRETCH), zero, step))
        return F.when(F.size(rows) <= STRETCH, F.aggregate(rows, zero, step, lambda a: a["found"])).otherwise(bound(stretches, placed))

    def placed(parts: Column) -> Column:
        begins = F.aggregate(parts, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["at"])))
        moved = lambda x, b: F.transform(x["found"], lambda m: F.struct((m["start"] + b).alias("start"), (m["end"] + b).alias("end"), m["part"].alias("part")))
        return bound(begins, lambda b: F.flatten(F.transform(parts, lambda x, i: moved(x, b[i]))))

    hits = F.regexp_extract_all(text, p, F.lit(0))
    parts = hits if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    rows = F.zip_with(F.zip_with(hits, parts, lambda h, g: F.struct(h.alias("hit"), g.alias("part"))), F.split(text, pattern, -1), lambda x, gap: F.struct(x["hit"].alias("hit"), x["part"].alias("part"), gap.alias("gap")))
    return F.when(text.rlike(pattern), bound(F.filter(rows, lambda x: x["hit"].isNotNull()), folded)).otherwise(none)


def hot_region(string: Column, least: Column, window: int = WINDOW) -> Column:
    """struct<low, high, peak>: from the first to past the last character of windows with at least ``least`` bits; low -1: none."""
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c).cast("int"))

    def scan(codes: Column) -> Column:
        zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(-1).alias("low"), F.lit(-1).alias("high"), F.lit(0.0).alias("peak"))

        def step(a: Column, code: Column) -> Column:
            i = a["i"]
            gone = F.when(i >= window, F.element_at(codes, F.greatest(i - window + 1, F.lit(1)))).otherwise(F.lit(-1))

            def moved(z: Column) -> Column:
                code, gone = z["code"], z["gone"]
                added = F.element_at(a["n"], code + 1)
                s = a["s"] + F.element_at(f, added + 2) - F.element_at(f, added + 1)
                here = F.when(gone >= 0, F.element_at(a["n"], F.greatest(gone, F.lit(0)) + 1) + (gone == code).cast("int")).otherwise(F.lit(0))
                s = F.when(gone >= 0, s + F.element_at(f, F.greatest(here - 1, F.lit(0)) + 1) - F.element_at(f, here + 1)).otherwise(s)
                n = F.transform(a["n"], lambda c, j: c + (j == code).cast("int") - (j == gone).cast("int"))
                bits = F.when(i + 1 >= window, F.lit(math.log2(window)) - s / window).otherwise(F.lit(0.0))
                hot = (i + 1 >= window) & (bits >= least)
                return F.struct(
                    n.alias("n"), s.alias("s"), (i + 1).alias("i"),
                    F.when(hot & (a["low"] < 0), i + 1 - window).otherwise(a["low"]).alias("low"),
                    F.when(hot, i + 1).otherwise(a["high"]).alias("high"),
                    F.greatest(a["peak"], bits).alias("peak"),
                )

            return bound(F.struct(code.alias("code"), gone.alias("gone")), moved)

        return F.aggregate(codes, zero, step, lambda a: F.struct(a["low"].alias("low"), a["high"].alias("high"), a["peak"].alias("peak")))

    return bound(codes, scan)


def entropy_spans(text: Column) -> Column:
    """array<struct<start, end>> of candidate regions whose windows reach their class's entropy and that no allow-list entry names."""
    def level_of(s: Column) -> Column:
        out = F.lit(None).cast("double")
        for pattern, bits in reversed(CLASSES.values()):
            out = F.when(s.rlike(f"^(?:{pattern})$"), F.lit(bits)).otherwise(out)
        for pattern in ALLOWED:
            out = F.when(s.rlike(pattern), F.lit(None).cast("double")).otherwise(out)
        return out

    judged = F.transform(located(text, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), m["part"].alias("part"), level_of(m["part"]).alias("least")))
    hot = F.transform(F.filter(judged, lambda m: m["least"].isNotNull()), lambda m: F.struct(m["start"].alias("start"), hot_region(m["part"], m["least"]).alias("r")))
    return F.transform(F.filter(hot, lambda m: m["r"]["low"] >= 0), lambda m: F.struct((m["start"] + m["r"]["low"]).alias("start"), (m["start"] + m["r"]["high"]).alias("end")))


KINDS = [*BASE_KINDS, ENTROPY_KIND]


def spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    def kept(pattern: str, group: int, least: int) -> Column:
        return F.filter(located(text, pattern, group), lambda m: F.length(m["part"]) >= least)

    return F.sort_array(F.concat(*[spans(kind, kept(*rule)) for kind, rule in BASE_KINDS.items()]))


def apart(more: Column, base: Column) -> Column:
    return F.sort_array(F.filter(more, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and extra (array<struct<start, rank, end, kind>> in order) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans; every row gives one row, repeated rows each their own; an empty table gives an
    empty result; further columns are ignored. An entropy span that meets a base span adds nothing and is left out; base
    spans stay whatever the allow-list says. Starts and ends are code points, the end exclusive.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", base_spans(text).alias("base"), spans(ENTROPY_KIND, entropy_spans(text)).alias("more"))
    return out.select("doc_id", "base", apart(F.col("more"), F.col("base")).alias("extra"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``n_chars``, if there, counted anew.

    All rows and columns stay; texts without a secret, null ones included, are unchanged.
    """
    text = F.coalesce("text", F.lit(""))
    named = "spans"
    while named.lower() in {c.lower() for c in docs.columns}:
        named += "_"
    base = base_spans(text)
    every = bound(base, lambda b: F.sort_array(F.concat(b, apart(spans(ENTROPY_KIND, entropy_spans(text)), b))))
    found = docs.withColumn(named, every)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        out = F.when(s["end"] <= a["at"], a["out"]).when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], before, F.lit(mark)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(named, zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    out = found.withColumn("text", F.when(F.size(named) > 0, clean).otherwise(F.col("text"))).drop(named)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.sort_array(F.concat("base", "extra"))).alias("spans"))
