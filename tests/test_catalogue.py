"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from lodestrata.plans.adapters import TRADE
from lodestrata.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _sorted(columns, rows):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    return order, sorted([tuple(clean(r[i]) for i in at) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    q = con.sql(ORACLE_SQL[name])
    assert _sorted(df.columns, df.collect()) == _sorted(q.columns, q.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, con, name):
    """Those whose twins are plain Python (the parser's cases in test_operators, the search in test_structure) give rows that their tables explain."""
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name == "cycle_list":
        edges = set(con.sql(f"WITH {TRADE} SELECT src, dst FROM trade").fetchall())
        for r in rows:
            nodes = r["nodes"].split(">")
            assert nodes[0] == nodes[-1] and len(set(nodes)) == r["length"] == len(nodes) - 1 and set(zip(nodes, nodes[1:])) <= edges
