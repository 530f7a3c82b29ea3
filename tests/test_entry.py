"""The registered queries: contract, and agreement with their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = [
    "os_from_source", "parse_linux", "parse_macos", "label_counts", "issue_sessions", "user_sessions", "issues_day_gap", "cluster_candidates",
    "agent_stats", "normalize_snmp", "normalize_dcim", "nearest_prototype", "nearest_prototype_blocks", "medoids", "list_alerts", "cooldown_fires",
]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def comparable(rows):
    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(([plain(v) for v in r] for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert comparable(tuple(r[c] for c in cols) for r in df.collect()) == comparable(want)
