"""Queries agree with their SQL on the smallest tables, a few of each family; the driver compares all of them."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["txt1_tokenize", "txt5_sentences", "chk3_by_sentences", "ret4_bm25_search", "ret5_exact_search", "ret17_hybrid_search", "evl5_ndcg_exponential", "ctx2_first_fit", "grd8_best_context_match", "rrk4_rerank", "qry1_analyze_query", "cst2_cost_per_query", "flt1_metadata_filter", "vec6_outlier"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert ours == theirs


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
