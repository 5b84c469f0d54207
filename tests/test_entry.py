"""Driver contract and a quick oracle check at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_entry_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["series_id", "ts", "cgm_primary", "cgm_primary_mmol", "missing"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["cgm_person_fill", "bgm_clean", "insulin_metadata", "align_all", "timeline_check", "ts_convert"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ["events", "orders", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in res.description]
    exp = sorted(tuple(str(row[names.index(c)]) for c in cols) for row in res.fetchall())
    assert sorted(names) == cols
    assert len(got) == len(exp)
    assert got == exp
