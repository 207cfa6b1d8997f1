"""Every query against its SQL on the driver's tables, and what SQL can't say against plain Python."""

import json
import os

import __spark_entry__
import duckdb
import pandas as pd
import pytest

from larder.plans import queries as plans

PLAIN = sorted(set(plans.QUERIES) - set(plans.SQL))


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else f"{value:.9g}"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return None if value is None or value is pd.NaT or value is pd.NA else str(value)


def rows(spark_or_db):
    if hasattr(spark_or_db, "collect"):
        names, found = spark_or_db.columns, [tuple(r) for r in spark_or_db.collect()]
    else:
        names, found = [d[0] for d in spark_or_db.description], spark_or_db.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_gives_the_rows_of_its_sql(spark, db, sf_dir, name):
    assert rows(plans.QUERIES[name](spark, sf_dir)) == rows(db.execute(plans.SQL[name]))


@pytest.mark.parametrize("name", PLAIN)
def test_query_without_sql_runs(spark, sf_dir, name):
    found = plans.QUERIES[name](spark, sf_dir)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_entry_module(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_results_can_be_written(spark, sf_dir, tmp_path):
    found = plans.QUERIES["band_match_best"](spark, sf_dir)
    found.write.json(str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == found.count()
