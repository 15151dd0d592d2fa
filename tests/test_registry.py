"""Every registered query with SQL, against DuckDB over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tonearm.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query_equals_its_sql(spark, db, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted("|".join(told(r[c]) for c in columns) for r in found.collect())
    cursor = db.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert got == sorted("|".join(told(dict(zip(names, row, strict=True))[c]) for c in columns) for row in cursor.fetchall())


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["f1", "f2", "identical", "weighted_score"]
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
