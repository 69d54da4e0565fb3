"""Every query of the road audit against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from waymeter.plans import more, registry  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return None
        return str(v) if isinstance(v, (bool, str)) or type(v).__name__ == "bool_" else round(float(v), 9) + 0.0

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(name, spark, sf, db):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["jn_2_conflicts", "jn_3_gaps", "jn_4_misplaced_stops", "jn_6_corridors", "jn_8_scored_pairs", "jn_15_nearest_other_way"])
def test_no_nested_loops(name, spark, sf):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__

    assert {r.defect_class: r.n for r in __spark_entry__.entry(spark).collect()} == {"A": 52, "AB": 599, "B": 764, "C": 85}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
