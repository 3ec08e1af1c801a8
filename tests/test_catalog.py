import glob
import math
import os

import duckdb
import pytest

from batchplan.plans import catalog


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def normal(rows):
    return sorted(tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, db, name):
    got = catalog.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = got.select(columns).collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = db.execute(sql).to_arrow_table() if hasattr(db, "to_arrow_table") else db.execute(sql).fetch_arrow_table()
    assert sorted(want.column_names) == columns
    assert normal(rows) == normal(zip(*(want.column(c).to_pylist() for c in columns), strict=True))


def test_plans_stay_on_the_jvm(spark, sf_dir):
    """Plans of fixed size read three columns at most and run no Python."""
    plan = catalog.queries()["padding_by_strategy"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "n_chars" not in plan


def test_whole_candidate_features(spark, sf_dir):
    """Every position meets every candidate of the grid, against brute force."""
    ranked = catalog._ranked(spark, sf_dir).orderBy("pos").collect()
    token = [r.token_len for r in ranked]
    rows = catalog.queries()["candidate_features"](spark, sf_dir).collect()
    assert {(r.pos, r.batch_size_y): (r.token_sum_y, r.token_max_y) for r in rows} == {(p, c): (sum(token[p : p + c]), max(token[p : p + c])) for p in range(len(token)) for c in catalog.GRID}
    first, ratios = sum(token[: catalog.B]), catalog.queries()["ratio_features"](spark, sf_dir).collect()
    assert len(ratios) == len(rows) and all(math.isclose(r.token_sum_diff, sum(token[r.pos : r.pos + r.batch_size_y]) / first, abs_tol=1e-6) for r in ratios)
