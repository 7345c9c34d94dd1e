"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lotlens.plans import queries as core
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else str(v) if v is not None else None


def compare(spark, duck, run, sql):
    got = run(spark, DATA)
    names = sorted(got.columns)
    a = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str)
    found = duck.execute(sql)
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    b = sorted((tuple(plain(r[order.index(n)]) for n in names) for r in found.fetchall()), key=str)
    assert a == b


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    compare(spark, duck, core.QUERIES[name], core.ORACLES[name])


def test_all_users_and_keys(spark):
    users = core.offers(spark, DATA).join(core.table(spark, DATA, "lineitem"), F.col("id") == F.col("l_orderkey")).select("user_id").distinct().count()
    for name in ("favorites_join", "favorites_join_all"):
        assert users > 20 and core.QUERIES[name](spark, DATA).select("user_id").distinct().count() == users
    keys = core.events(spark, DATA).select("user_id").distinct().count()
    assert core.QUERIES["kv_ttl_all"](spark, DATA).count() == keys + 3


def test_whole_texts_are_folded(spark):
    texts = {r["doc_id"]: r["text"] for r in core.table(spark, DATA, "documents").select("doc_id", "text").collect()}
    low = {r["doc_id"]: r["low"] for r in core.QUERIES["lower_whole_text"](spark, DATA).collect()}
    assert {i: len(t) for i, t in low.items()} == {i: len(t) for i, t in texts.items()} and max(map(len, low.values())) > 60


@pytest.mark.parametrize("sort", ["price_asc", "price_desc", "year_desc", "mileage_asc"])
def test_sorts_have_all_rows(spark, sort):
    n = core.listings(spark, DATA).count()
    rows = core.QUERIES[f"sort_{sort}_all"](spark, DATA).orderBy("place").collect()
    assert n > 50 and [r["place"] for r in rows] == list(range(1, n + 1))
    assert [r["id"] for r in rows] == [r["id"] for r in core.QUERIES[f"sort_{sort}"](spark, DATA).collect()]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "title", "price"]
    assert set(core.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_catalogue_without_a_row_for_each_pair(spark, duck, tmp_path):
    """Customers that occur twice or have no key; no row for each pair and no titles kept while rows are grouped."""
    keys = spark.range(-3, 90).unionByName(spark.range(20, 25)).select(F.when(F.col("id") != 50, F.col("id")).alias("c_custkey"))
    keys.write.parquet(str(tmp_path / "customer.parquet"))
    out = core.catalogue_rows(spark, str(tmp_path))
    want = duck.cursor().execute(f"WITH customer AS (SELECT * FROM '{tmp_path}/customer.parquet/*.parquet') {core.ORACLES['catalogue_rows'].replace('WITH t AS', ', t AS', 1)}").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) and {k: n for k, n, *_ in want}[20] == 2 * {k: n for k, n, *_ in want}[60] > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "min_by" not in plan
