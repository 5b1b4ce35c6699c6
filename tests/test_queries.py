"""Every registered query of the description engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from boundsmith.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(columns, data):
    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return repr(v)
        return repr(round(float(v), 9) + 0.0)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = Q.QUERIES[name](spark, SF)
    sql = db.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    got, want = rows(df.columns, df.collect()), rows(sql.columns, sql.fetchall())
    assert len(got) == len(want) and got == want


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "closure_report" in e.queries()


TOUCHING = [(1, 5131, 51, 40.0), (2, 15769, 106, 3.38), (3, 10898, 297, 6.64), (4, 11112, 831, 1.0)]  # the third course ends on the first, within 1e-7


@pytest.mark.parametrize("name", ["self_intersections", "validation_report", "report_files", "run_summary"])
def test_touching_courses_equal_sql(spark, tmp_path, name):
    values = ", ".join(f"({d}, {n}, {p}, {s}, {q}::DOUBLE, TIMESTAMP '2000-01-01')" for d in range(5) for n, p, s, q in TOUCHING)
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM (VALUES {values}) t(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    df, sql = Q.QUERIES[name](spark, str(tmp_path)), con.sql(Q.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", ["legacy_compact", "legacy_prose"])
def test_older_texts_are_read_once(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("Aggregate [") == 1
