"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from talus.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "-"
        return f"{float(x):.4f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA)
    names = sorted(found.columns)
    wanted = duck.sql(registry.SQL[name])
    assert names == sorted(wanted.columns)
    cols = ", ".join(f'"{c}"' for c in names)
    assert plain(found.select(*names).collect()) == plain(wanted.query("w", f"SELECT {cols} FROM w").fetchall())
