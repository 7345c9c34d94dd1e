"""Dashboards from batches, and cards that are delivered once."""

import random

import pytest
from pyspark.sql import functions as F

from lotlens.operators import metrics as M
from lotlens.operators import rollup as R
from lotlens.plans import queries as core
from lotlens.streaming import delivery as D
from tests.conftest import DATA

NAMES = ["total", "unread"]


def measures():
    return {"total": F.lit(1), "unread": F.when(~F.col("is_read"), 1)}


@pytest.mark.parametrize("merge", [2, 16])
def test_any_order_of_batches(spark, tmp_path, merge):
    path, facts = "file://" + str(tmp_path / "sums"), core._notices(spark, DATA).withColumn("part", F.pmod(F.xxhash64("created_at"), F.lit(5)))
    order = [3, 0, 3, 4, 1, 0, 2, 3]
    added = [R.add_batch(facts.where(F.col("part") == p), path, p, ["user_id"], "created_at", measures(), merge) for p in order]
    assert added == [p not in order[:i] for i, p in enumerate(order)]
    sums, rows = R.daily_sums(spark, path, NAMES), lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(R.activity(sums, core.AS_OF)) == rows(M.user_activity(facts, core.AS_OF).select("user_id", "total", "unread", "today", "yesterday"))
    assert rows(R.daily_series(sums, core.AS_OF)) == rows(M.daily_series(facts, "created_at", core.AS_OF))
    assert R.add_batch(facts.limit(0), path, 5, ["user_id"], "created_at", measures(), merge) and rows(R.activity(R.daily_sums(spark, path, NAMES), core.AS_OF)) == rows(R.activity(sums, core.AS_OF))
    before = rows(R.daily_sums(spark, path, NAMES))
    assert bool(R.forget_merged(spark, path, minutes=0)) == (merge == 2) and rows(R.daily_sums(spark, path, NAMES)) == before


def test_reading_notices_is_a_correction(spark, tmp_path):
    path = "file://" + str(tmp_path / "sums")
    facts = spark.createDataFrame([("u", "2024-01-01 10:00:00", False), ("u", "2024-01-01 11:00:00", None), ("v", None, False)], "user_id string, created_at string, is_read boolean")
    R.add_batch(facts, path, 7, ["user_id"], "created_at", measures())
    R.add_batch(facts.where("user_id = 'u'").limit(1), path, 8, ["user_id"], "created_at", {"total": F.lit(0), "unread": F.lit(-1)})
    assert {r["user_id"]: (r["total"], r["unread"]) for r in R.activity(R.daily_sums(spark, path, NAMES), "2024-01-01 12:00:00").collect()} == {"u": (2, 0), "v": (1, 1)}


def test_ranges_of_batches():
    done, numbers = [], random.Random(1).sample(range(40), 30)
    for n in numbers:
        done = R._with(done, n)
        assert all(b[0] > a[1] + 1 for a, b in zip(done, done[1:], strict=False))
    assert sorted(numbers) == [n for a, b in done for n in range(a, b + 1)]


def test_whole_card(spark):
    row = spark.createDataFrame([("Camry", 2021, 45000, 780000, "Київ", None), (None, None, None, None, None, "USD")], "title string, year int, mileage int, price int, region string, currency string")
    c = [F.col(x) for x in ("title", "year", "mileage", "price", "region")]
    got = [r[0] for r in row.select(D.listing_card(*c, F.lit("Моя"), F.lit("OLX"), F.col("currency"))).collect()]
    assert got[0] == "🚗 <b>Camry</b>\n📅 2021 · 🛣 45,000 км · 📍 Київ\n💰 <b>780 000 UAH</b>\n🔍 Запит: «Моя»\n📡 OLX"
    assert got[1].startswith("🚗 <b></b>\n") and [r[0] for r in row.select(D.button_url(F.col("region"), "https://site")).collect()] == ["Київ", "https://site"]


def test_once_over_crashes(spark, tmp_path):
    path, source, checkpoint = ("file://" + str(tmp_path / x) for x in ("out", "in", "checkpoint"))
    cards = lambda ids: spark.createDataFrame([(i, None if i == "lost" else "chat", f"text {i}", "url", f"2024-01-0{1 + len(str(i)) % 3} 10:00:00") for i in ids], f"{D.OUT}, created_at string")
    stream = lambda: spark.readStream.schema(f"{D.OUT}, created_at string").option("maxFilesPerTrigger", 1).parquet(source)
    cards(["a", "bb", "bb", None, "lost"]).coalesce(1).write.parquet(source)

    def crash(df, n, p):
        D.deliver(df, n, p)
        raise RuntimeError("after the write, before the commit")

    with pytest.raises(Exception):  # noqa: B017
        D.deliver_stream(stream(), path, checkpoint, crash).awaitTermination()
    D.deliver_stream(stream(), path, checkpoint).awaitTermination()
    cards(["bb", "ccc", "a"]).coalesce(1).write.mode("append").parquet(source)

    def early(df, n, p):
        raise RuntimeError("before the write")

    with pytest.raises(Exception):  # noqa: B017
        D.deliver_stream(stream(), path, checkpoint, early).awaitTermination()
    D.deliver_stream(stream(), path, checkpoint).awaitTermination()
    assert sorted((r["id"], r["batch"]) for r in D.sent_cards(spark, path).collect()) == [("a", 0), ("bb", 0), ("ccc", 1)]
    assert not D.deliver(cards(["new"]), 1, path) and D.deliver(cards([]), 2, path)
