"""The exact cooldown by pointer doubling, one-time tokens, and the key-value map as a restarted stream."""

import random

import pytest
from pyspark.sql import functions as F

from lotlens.operators import keyed_state as K
from lotlens.operators import paging
from lotlens.plans import queries as core
from lotlens.streaming import keyed
from tests.conftest import DATA


def walked(rows, seconds):
    out, last = {}, {}
    for k, t, i in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        if out.setdefault(i, k not in last or t - last[k] >= seconds):
            last[k] = t
    return out


@pytest.mark.parametrize("seconds", [0, 7, 60])
def test_cooldown_is_that_of_a_walk(spark, seconds):
    rng = random.Random(seconds)
    rows = [(rng.choice(["a", "a", "a", "b", "c", f"k{rng.randrange(40)}", None]), rng.choice([rng.randrange(2000), rng.randrange(30), None]), i) for i in range(1500)]
    rows += [("even", 60 * i, 5000 + i) for i in range(70)] + [("lone", 3, 9000)]
    log = spark.createDataFrame([(k, t, i, True) for k, t, i in rows], "k string, t long, i long, accepted boolean").withColumn("ts", F.timestamp_seconds("t")).drop("accepted")
    got = {r["i"]: r["accepted"] for r in K.accepted_sends(log, "k", "ts", seconds, "i").collect()}
    want = walked(rows, seconds)
    assert len(got) == len(rows) and {i for i, ok in got.items() if ok} == {i for i, ok in want.items() if ok}
    assert K.accepted_sends(log.limit(0), "k", "ts", seconds, "i").count() == 0


def test_one_key_is_spread_over_tasks(spark):
    n = 200_000
    log = spark.range(n).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 2).alias("ts"), "id")
    out = K.accepted_sends(log, "k", "ts", 7, "id")
    assert out.where("accepted").count() == n // 4 and out.where("accepted AND id % 4 <> 0").count() == 0
    at = paging.placed(log.select("k", "ts"), [F.asc("k"), F.asc("ts")])
    assert at.agg(F.count_distinct(F.col("place"))).first()[0] == n and at.rdd.getNumPartitions() > 1


def test_sorted_pages_open_their_ranges_only(spark, tmp_path):
    path, rows = str(tmp_path / "sorted"), spark.range(10_000).withColumn("price", F.xxhash64("id") % 50)
    order = [F.desc("price"), F.asc("id")]
    paging.write_sorted(rows, order, path)
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    for number in (1, 50, 99, 100):
        found = paging.sorted_page(spark, path, number, 100)
        assert [tuple(r) for r in found.select("id", "price").collect()] == want[100 * (number - 1) : 100 * number]
        opened = paging.sorted_rows(spark, path, 100 * (number - 1), 100).inputFiles()
        scanned = [r for r in spark.read.parquet(f"{path}/ranges").collect() if r["first"] < 100 * number and r["first"] + r["n"] > 100 * (number - 1)]
        assert 1 <= len(scanned) <= 2 and len(opened) >= len(scanned)
    plan = paging.sorted_page(spark, path, 100, 100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__range" in plan or "PartitionFilters: [(__range" in plan
    assert paging.sorted_page(spark, path, 101, 100).count() == 0
    cursor, seen = None, []
    while got := paging.next_page(rows.where("price > 40"), cursor, ("price", "id"), ("price",), 100).collect():
        seen, cursor = seen + got, got[-1].asDict()
    assert [tuple(r) for r in seen] == [r for r in want if r[1] > 40]


def slices(spark, log, times, folder):
    """Append the log's slices one after another, as files of a streamed folder, and yield after each."""
    for a, b in zip(times, times[1:], strict=False):
        log.where((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(folder)
        yield a


def test_map_as_a_stream_with_restarts(spark, tmp_path):
    log, (source, out, checkpoint) = core._log(spark, DATA), (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    stream = lambda: keyed.keyed_changes(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source), "1 hour")
    for a in slices(spark, log, ["2024-01-01", "2024-01-10", "2024-01-20", "2024-02-02"], source):
        if a != "2024-01-10":  # two slices in two batches of the second start
            keyed.start(stream(), out, checkpoint).awaitTermination()
    now = core.EPOCH + 15.5 * 86400
    live = {tuple(r) for r in keyed.entries(spark, checkpoint, now).collect()}
    assert live == {tuple(r) for r in K.kv_state(log, now).collect()} and live
    kinds = {r["kind"]: r["count"] for r in spark.read.parquet(out).groupBy("kind").count().collect()}
    assert kinds["set"] + kinds["delete"] == log.count()


def test_timers_tokens_and_late_rows(spark, tmp_path):
    rows = [
        [("a", "set", "1", 20.0, 10, 1), ("b", "set", "2", None, 10, 2), ("t", "set", "secret", 40.0, 10, 3), ("t", "consume", None, None, 12, 5), ("t", "consume", None, None, 11, 4), ("d", "set", "x", None, 12, 6), ("e", "set", "y", 15.0, 10, 7), ("e", "set", "z", 300.0, 11, 8)],
        [("a", "consume", None, None, 30, 9), ("d", "delete", None, None, 30, 10), ("t", "set", "new", 35.0, 31, 12), ("t", "consume", None, None, 36, 13), ("b", "set", "3", None, 9, 14), (None, "set", "n", None, 30, 15)],
        [("d", "set", "old", None, 29, 11), ("z", "set", "9", None, 200, 16)], [("b", "set", "too late", None, 100, 17), ("z", "set", "10", None, 210, 18)],
    ]
    schema, (source, out, checkpoint) = "key string, op string, value string, expires_at double, t long, seq long", (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for batch in rows:
        spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(source)
        log = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        keyed.start(keyed.keyed_changes(log, "5 seconds"), out, checkpoint).awaitTermination()
    changes = {(r["key"], r["kind"], r["seq"]): r["value"] for r in spark.read.parquet(out).collect()}
    assert changes[("t", "consume", 4)] == "secret" and changes[("t", "consume", 5)] is None and changes[("t", "consume", 13)] is None
    assert changes[("a", "consume", 9)] is None and changes[("a", "expire", 1)] == "1" and changes[("t", "expire", 12)] == "new" and ("d", "set", 11) not in changes and ("b", "set", 14) not in changes
    assert {tuple(r) for r in keyed.entries(spark, checkpoint).select("key", "value").collect()} == {("b", "2"), ("e", "z"), ("z", "10")}
    assert keyed.entries(spark, checkpoint, 300.0).count() == 2


def test_token_uses(spark):
    rows = [("t", 1, 10.0, "set"), ("t", 2, 11.0, "consume"), ("t", 3, 12.0, "consume"), ("t", 4, 13.0, "set"), ("t", 5, 23.0, "consume"), ("u", 6, 1.0, "consume"), ("t", 7, 24.0, "set"), ("t", 8, 25.0, "set"), ("t", 9, 26.0, "consume")]
    log = spark.createDataFrame(rows, "key string, seq int, at double, op string")
    out = {r["seq"]: (r["served"], r["set_by"]) for r in K.token_uses(log, "key", ["seq"], "at", "op", "seq", 10).collect()}
    assert out == {2: (True, 1), 3: (False, None), 5: (False, None), 6: (False, None), 9: (True, 8)}


def test_codes_like_a_walk_over_their_log(spark):
    rng, rows, want = random.Random(11), [], {}
    for k in range(60):
        t, code = 0, None  # code: [end, failed]
        for _ in range(rng.randrange(1, 40)):
            t += rng.choice([0, 1, 250_000, 999_999, 1_000_000, 1_500_001, 3_000_000, 4_750_000])
            kind, i, ttl = rng.choice(["register", "refresh", "refresh", "wrong", "wrong", "wrong", "right"]), len(rows), 5
            rows.append((k, i, t / 1e6, kind))
            last = want[i - 1][0] if i and rows[i - 1][0] == k else None
            if kind == "register":
                code, want[i] = [t + ttl * 10**6, 0], (t + ttl * 10**6, False, 0, False)
                continue
            if code is None or code[0] <= t:
                code, want[i] = None, (last, False, 0, False)
                continue
            failed, rest, deleted = code[1], (code[0] - t) // 10**6, False
            if kind == "refresh":
                code = [t + (rest or ttl) * 10**6, 0]
            elif kind == "right" or failed + 1 >= 3:
                deleted = True
            elif rest:
                code = [t + rest * 10**6, failed + 1]
            want[i] = (code[0], True, failed, deleted)
            code = None if deleted else code
    log = spark.createDataFrame(rows, "k int, i int, at double, kind string")
    out = K.code_tries(log, "k", ["i"], "at", "kind", 5, 3).collect()
    got = {r["i"]: (None if r["expires_at"] is None else round(r["expires_at"] * 1e6), r["live"], r["failed_before"], r["deleted"]) for r in out}
    assert len(out) == len(rows) and got == want
    assert any(w[1] and rows[i][3] == "refresh" and w[0] - round(rows[i][2] * 1e6) == 5_000_000 for i, w in want.items()) and sum(w[3] for w in want.values()) > 20


def test_state_is_read_and_written_once_for_all_rows_of_a_key():
    calls, state = [], {"entry": None, "timers": set()}

    class Handle:
        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return state["entry"]

        def update(self, entry):
            calls.append("update")
            state["entry"] = entry

        def registerTimer(self, at):
            calls.append("register")
            state["timers"].add(at)

        def deleteTimer(self, at):
            calls.append("delete")
            state["timers"].remove(at)

    log = keyed.KeyedLog()
    log.init(Handle())
    rows = [{"op": "set", "value": str(i), "expires_at": 50.0 + i, "us": i * 1_000_000, "seq": i} for i in range(100)]
    assert len(list(log.handleInputRows(("k",), iter(rows[:60]), None))) == 60 and calls == ["get", "update", "register"] and state["timers"] == {109_000}
    assert len(list(log.handleInputRows(("k",), iter(rows[::-1]), None))) == 40 and len(calls) == 7 and state["timers"] == {149_000} and state["entry"][1] == "99"
    assert list(log.handleInputRows(("k",), iter(rows), None)) == [] and calls[7:] == ["get"]
