"""Every registered query against its SQL on the smallest tables, and properties where SQL has no say."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pairlab.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({SQL[name]})").fetchall()
    got, want = plain(df.select(columns).collect()), plain(found)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all((x == y) or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("key, where, folds", [("p_partkey", "p_partkey < 72", 3), ("p_partkey - 100", "TRUE", 7)])
def test_weight_grid_search_scores_every_pair_whatever_its_folds(spark, tmp_path, key, where, folds):
    c, name = duckdb.connect(), "b5_weight_grid_search"
    c.execute(f"COPY (SELECT * REPLACE ({key} AS p_partkey) FROM '{SF}/part.parquet' WHERE {where}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'; CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = plain(c.execute(f"SELECT fold, category, point, ap FROM ({SQL[name]})").fetchall())
    assert len({w[0] for w in want}) == folds and {w[2] for w in want} == set(range(15))
    assert plain(QUERIES[name](spark, str(tmp_path)).select("fold", "category", "point", "ap").collect()) == want


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["category", "n_rows", "positives", "ap"] and df.count() > 0


def test_every_query_has_sql_or_a_test_of_its_own():
    own = {"x1_pair_features_full", "b9_stack_logit", "b9_stack_transforms", "b9_weight_stability", "b17_feature_importance", "b17_train_pair_classifier", "b18_graph_meta_model"}
    assert set(QUERIES) - set(SQL) == own
