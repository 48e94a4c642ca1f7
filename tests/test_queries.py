"""Every query with SQL of its own agrees with DuckDB on whole small tables."""

import duckdb
import pytest

import __spark_entry__

TABLES = "documents pages labels conversations benchmark".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    mine, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(_raw(mine, columns), key=repr) == sorted(_raw(theirs, columns), key=repr)


def _raw(frame, columns):
    def plain(v):
        if v is None or repr(v) in ("<NA>", "nan"):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(float(v), 9) if isinstance(v, float) else v

    out = []
    for r in frame[columns].astype(object).values:
        values = [plain(v) for v in r]
        out.append(tuple(int(v) if isinstance(v, float) and v == int(v) else v for v in values))
    return out


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
