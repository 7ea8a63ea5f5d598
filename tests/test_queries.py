"""Every query with SQL gives the same rows as DuckDB."""

import duckdb
import pytest

from tallyforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["findings_view", "policy_restamp", "repair_ranking", "top3_projection", "share_payload"])
def test_rules_that_the_catalog_lacks(spark, name):
    """A larger table, which holds findings of such a rule: they stay, and their sources' scores aren't published."""
    larger, con = SF.replace("0.001", "0.01"), duckdb.connect()
    con.execute(f"create view documents as select * from '{larger}/documents.parquet'")
    df = registry.QUERIES[name](spark, larger)
    cursor = con.execute(registry.ORACLE[name])
    names = [d[0] for d in cursor.description]
    got = sorted(tuple(str(r[c]) for c in names) for r in df.collect())
    assert got == sorted(tuple(map(str, r)) for r in cursor.fetchall())
    if name == "findings_view":
        assert any("enormous_unit" in r for r in got)


@pytest.mark.parametrize("name", ["health_score", "stride_sample", "findings_digest"])
def test_partitioning_changes_nothing(spark, monkeypatch, name):
    from tallyforge.plans import base

    whole, seen = base.table, []
    for n in (1, 7):
        monkeypatch.setattr(base, "table", lambda s, d, t, n=n: whole(s, d, t).repartition(n))
        seen.append(sorted(map(tuple, registry.QUERIES[name](spark, SF).collect()), key=str))
    assert seen[0] == seen[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
