"""The SQL of the queries gives their rows."""

import duckdb
import pytest

from framewright.llm import queries as Q


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda x: bool(x) if isinstance(x, bool) else int(x) if isinstance(x, int) else x
    return sorted(names), sorted((tuple(shown(r[i]) for i in order) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01" if name.startswith("op4") else "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(Q.ORACLES[name])
    want = rows([c[0] for c in want.description], want.fetchall())
    out = Q.QUERIES[name](spark, sf)
    assert rows(out.columns, [tuple(r) for r in out.collect()]) == want
    if name.startswith("op4"):  # the verdict is more than the base
        failed, kept = want[0].index("base_failed"), want[0].index("kept")
        assert any(not r[failed] and not r[kept] for r in want[1])
