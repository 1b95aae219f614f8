"""Every registered query of the scanning operators against its SQL on the smallest tables, and the planted view."""

import duckdb
import pytest

from palisade import queries as Q
from palisade.plans.planted import PAYLOADS, planted_files
from palisade.plans.rules import RULES

SF = "/root/testdata/sf0.001"
NAMES = [name for name in Q.oracle_sql() if not name.startswith("sig_sd")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    got = key(df.select(*columns).collect())
    assert got and got == key(duck.execute(f"SELECT {', '.join(columns)} FROM ({Q.oracle_sql()[name]})").fetchall())


def test_every_rule_has_hits_and_misses(spark):
    rows = Q.sig_all(spark, SF).groupBy("rule_id").count().collect()
    total = planted_files(spark, SF).count()
    assert {r.rule_id for r in rows} == {r.rule_id for r in RULES}
    assert all(0 < r["count"] < total for r in rows)


def test_payload_slots_are_distinct():
    slots = [p[0] for p in PAYLOADS]
    assert len(set(slots)) == len(slots) and max(slots) < 61


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())
