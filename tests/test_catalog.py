"""Every query with SQL gives the rows that DuckDB finds on the same tables."""

import datetime
import decimal

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_the_others_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_turns_are_compared_and_ranked(spark):
    turns = {(str(r.conv_id), f"{r.conv_id}:{r.turn}") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    fixture = {(c[1], c[0]) for c in catalog.X.CLAIMS}
    ranked = {(r.conversation_id, r.mu_id) for r in catalog.QUERIES["betweenness_centrality"](spark, SF).collect()}
    assert ranked == turns | fixture
    pairs = catalog.QUERIES["pairwise_relationships"](spark, SF).collect()
    expected = sum(c[0] == other[0] for every in (turns, fixture) for c in every for other in every if c[1] < other[1])
    assert len(pairs) == expected
