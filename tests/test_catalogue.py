"""Every query with SQL equals it on a small scale; the others give rows with a stable schema."""

import duckdb
import pytest

from spanloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows(records, columns):
    return sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in records), key=lambda r: [(x is not None, x) for x in r])


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    kinds = {c[0]: str(c[1]) for c in found.description}
    want = found.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want, columns)
    assert want or name.endswith(("violations", "diff", "rows"))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
