"""Every query that has SQL, against DuckDB on the smallest tables; the rest must run."""

import math
import os

import duckdb
import pytest

from trajspark.catalogue import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = [sorted(tuple(map(plain, r)) for r in df[columns].astype(object).values.tolist()) for df in (got, want)]
        assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_window_study_takes_every_point(spark, monkeypatch):
    from trajspark import queries

    class Seen(Exception):
        pass

    def candidates(points, roads, parameters):
        raise Seen(points.select("traj_id", "seq").distinct().count())

    monkeypatch.setattr(queries.matching, "match_candidates", candidates)
    with pytest.raises(Seen) as seen:
        QUERIES["window_study"](spark, SF)
    assert seen.value.args == (spark.read.parquet(f"{SF}/events.parquet").count(),)
