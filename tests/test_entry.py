from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from folium import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).columns == ["module_id", "link", "title", "format"]


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n in registry.QUERIES])
def test_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    assert set(got.columns) == set(want.columns)
    cols = sorted(got.columns)
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    a = sorted(str([plain(r[c]) for c in cols]) for r in got.collect())
    b = sorted(str([plain(v) for v in r]) for r in duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM want").fetchall())
    assert a == b
