import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunking as C


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_tokenize(spark):
    assert one(spark, T.tokenize, "ACI.fabric, x! the") == ["aci", "fabric"]


def test_unicode_words(spark):
    assert one(spark, T.content_words, "Étude über x étude") == ["étude", "über"]


def test_approximate_tokens(spark):
    assert [one(spark, T.approx_tokens, t) for t in ("", "abc", "123456789")] == [1, 1, 2]


def test_sentences(spark):
    assert one(spark, T.sentences, "A b. C! d? 1. 2. E") == ["A b.", "C! d?", "1.", "2.", "E"]


def test_content_type_defaults_to_plain(spark):
    assert one(spark, T.content_type, "hello") == "plain"
    assert one(spark, lambda t: T.content_type(t, compat=True), "hello") == "markdown"
    assert one(spark, T.content_type, "# Title\n\n- a\n```x```") == "markdown"


def test_key_token_and_numbers(spark):
    assert one(spark, T.key_token, "about 42 things") == "42"
    assert one(spark, T.key_token, "no number") == "number"
    assert one(spark, lambda t: T.numbered_items(t, F.lit("q")), "1. a\n2) b") == ["a", "b"]
    assert one(spark, lambda t: T.numbered_items(t, F.lit("q")), "nothing") == ["q"]


def test_blank_text_has_no_chunks(spark):
    assert one(spark, lambda t: C.by_characters(t), "  \n") == []
    assert one(spark, lambda t: C.by_sentences(t), "") == []


def test_character_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(5000))
    got = one(spark, lambda t: C.by_characters(t, 1000, 100), text)
    assert all(text[c["start_char"] : c["end_char"]] == c["content"] for c in got)
    assert "".join(c["content"][(100 if i else 0) :] for i, c in enumerate(got)).startswith(text)


def test_native_fold_equals_the_row_function(spark):
    text = " ".join(f"Sentence number {i} has {'many ' * (i % 7)}words." for i in range(80))
    for overlap in (0, 1, 2):
        assert one(spark, lambda t, o=overlap: C.by_sentences(t, 60, o), text) == C.packed(C.split_sentences(text), 60, overlap)


@pytest.mark.parametrize(("size", "overlap"), [(5, 0), (9, 4), (40, 4)])
def test_token_windows_end_and_cover(spark, size, overlap):
    rng = random.Random(size)
    texts = ["", " \n", "a" * 200, *("".join(rng.choice("ab. \n") for _ in range(rng.randrange(400))) for _ in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", C.by_tokens(F.col("t"), size, overlap).alias("c")).collect()
    for r in rows:
        words, at, end = texts[r["id"]].split(), 0, 0
        for window in (c.split() for c in r["c"]):
            assert window == words[at : at + len(window)] and at <= end and at + len(window) > end
            end = at + len(window)
            n = [max(1, len(w) // 4) for w in window]
            assert sum(n[:-1]) < size and (sum(n) >= size or end == len(words))
            at = end - min(max(1, len(window) * overlap // size), len(window) - 1)
        assert end == len(words)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc .\n#", max_size=600))
def test_recursive_chunks_keep_the_letters(text):
    got = "".join(C.recursive_chunks(text, C.SEPARATORS["markdown"], 10, 0))
    keep = lambda s: "".join(c for c in s if c not in " .\n")
    assert keep(got) == keep(text)
