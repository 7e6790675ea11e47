"""Every query against its oracle on the smallest tables, and empty tables of the same shape."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tessella.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{float(v):.6g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    duck.execute(catalogue.ORACLE_SQL[name])
    names, want = [c[0] for c in duck.description], duck.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, each", [("positional_zip", "documents"), ("caption_grid", "benchmark"), ("log_line_scan", "events")])
def test_no_row_is_left_out(spark, duck, name, each):
    n = duck.execute(f"SELECT count(*) FROM {each}").fetchone()[0]
    assert catalogue.QUERIES[name](spark, FOLDER).count() == n * (6 if each == "benchmark" else 1)


def test_new_pieces_come_from_all_documents(spark, duck):
    last = duck.execute("SELECT count(*) FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) AS w FROM documents WHERE doc_id >= 20) WHERE w NOT IN (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) FROM benchmark)").fetchone()[0]
    assert catalogue.QUERIES["vocabulary_append"](spark, FOLDER).count() >= last > 0
