"""Every query runs on the smallest tables; those with SQL give the rows DuckDB gives."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q in SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(cols).collect())
    r = duck.execute(SQL[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    assert len(at) == len(r.description)
    assert got == Counter(tuple(plain(row[i]) for i in at) for row in r.fetchall())


def test_fuzzy_measures_equal_a_plain_count(spark, sf):
    from lineloom.operators import metrics
    from lineloom.plans import evaluation

    ex = {r.sample_id: r for r in evaluation.examples(spark, sf).collect()}
    got = {r.sample_id: r for r in QUERIES["fuzzy_metrics"](spark, sf).collect()}
    assert got.keys() == ex.keys()
    for i, r in ex.items():
        assert tuple(got[i][k] for k in metrics.FUZZY) == metrics.all_pairs_metrics(r.pred, r.ref)
    mean = {r.metric: r.mean for r in QUERIES["evaluation_bundle"](spark, sf).collect()}
    fine = [g for i, g in got.items() if "Traceback" not in "\n".join(ex[i].pred)]
    assert abs(mean["fuzzy_f1"] - sum(g.fuzzy_f1 for g in fine) / len(fine)) < 1e-3


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and SQL.keys() <= QUERIES.keys()
