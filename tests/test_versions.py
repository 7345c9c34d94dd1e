"""Commits that can be read later and forgotten, and the key-value map that is merged bucket by bucket."""

import pytest
from pyspark.sql import functions as F

from lotlens.operators import compaction as V
from lotlens.operators import export as E
from lotlens.operators import keyed_state as K
from lotlens.plans import queries as core
from tests.conftest import DATA


def test_old_commits_are_read_and_forgotten(spark, tmp_path):
    path, rows = "file://" + str(tmp_path / "state"), lambda n: {"t": spark.range(n)}
    assert [E.commit_tables(rows(n), path) for n in (1, 2, 3)] == [1, 2, 3]
    old = E.current_table(spark, path, "t", 2)
    with pytest.raises(Exception):  # noqa: B017
        E.commit_tables({"t": spark.range(4).select(F.raise_error(F.lit("no")).alias("id"))}, path)  # leaves a folder
    E.commit_tables(rows(5), path)
    assert old.count() == 2 and E.current_table(spark, path, "t").count() == 5
    folders = lambda: sum(p.name.startswith("v-") for p in (tmp_path / "state").iterdir())
    assert folders() == 5 and E.forget_tables(spark, path, keep=2) == [] and folders() == 5
    assert len(E.forget_tables(spark, path, keep=2, minutes=0)) == 3 and folders() == 2
    assert E.current_table(spark, path, "t", 3).count() == 3
    with pytest.raises(LookupError):
        E.current_table(spark, path, "t", 2)
    with pytest.raises(LookupError):
        E.current_table(spark, "file://" + str(tmp_path / "none"), "t")


def test_map_equals_its_whole_log(spark, tmp_path):
    log, now, path = core._log(spark, DATA), core.EPOCH + 15.5 * 86400, "file://" + str(tmp_path / "kv")
    days = ["2024-01-01", "2024-01-09", "2024-01-17", "2024-02-02"]
    batches = [log.where((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))) for a, b in zip(days, days[1:], strict=False)]
    for b in (batches[2], batches[0], batches[1], batches[0]):  # out of order, one twice
        V.apply_batch(b, path, buckets=8)
    want = {tuple(r) for r in K.kv_state(log, now).collect()}
    assert {tuple(r) for r in V.kv_live(spark, path, now).collect()} == want and want
    some = sorted(r[0] for r in want)[:2]
    assert {r[0] for r in V.kv_live(spark, path, now, some).collect()} == set(some)
    assert V.kv_rows(spark, path, 1).count() == batches[2].select("key").distinct().count()


def test_only_touched_buckets_are_read(spark, tmp_path):
    path = "file://" + str(tmp_path / "kv")
    row = "key string, op string, value string, expires_at double, t long, seq long"
    batch = lambda rows: spark.createDataFrame(rows, row).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    assert V.apply_batch(batch([]), path) == {"commit": 0, "touched": [], "files": []} and V.kv_rows(spark, path).count() == 0
    V.apply_batch(batch([(f"k{i}", "set", str(i), None, 10, i) for i in range(500)] + [(None, "set", "x", None, 10, 0)]), path, buckets=16)
    did = V.apply_batch(batch([("k7", "set", "new", 100.0, 20, 1), ("k7", "set", "newer", 100.0, 20, 2), ("k9", "delete", None, None, 20, 3), ("k8", "set", "late", None, 5, 9)]), path)
    assert did["commit"] == 2 and 1 <= len(did["touched"]) <= 3
    assert did["files"] and {int(f.split("bucket=")[1].split("/")[0]) for f in did["files"]} == set(did["touched"])
    got = {r["key"]: r["value"] for r in V.kv_live(spark, path, 50.0).collect()}
    assert len(got) == 499 and got["k7"] == "newer" and got["k8"] == "8" and "k9" not in got and V.kv_rows(spark, path).count() == 500
    assert {r["value"] for r in V.kv_live(spark, path, 50.0, ["k7"], number=1).collect()} == {"7"} and V.kv_live(spark, path, 100.0, ["k7"]).count() == 0
    # nobody brings rows from before 200 any more
    V.apply_batch(batch([(f"k{i}", "delete", None, None, 30, i) for i in range(500)]), path, forget_before=200.0)
    assert V.kv_rows(spark, path).count() == 0
    V.apply_batch(batch([("z", "set", "1", None, 300, 1)]), path)
    assert V.kv_live(spark, path, 300.0).count() == 1 and len(V.forget_versions(spark, path, minutes=0)) == 3 and V.kv_live(spark, path, 300.0).count() == 1


@pytest.mark.parametrize("kind", ["csv", "xml"])
def test_one_file_is_what_the_driver_would_write(spark, tmp_path, kind):
    from lotlens.sources import constants as C

    more = spark.range(400).withColumnRenamed("id", "n")
    rows = C.catalog(spark).join(more).withColumn("desc", F.when(F.col("n") % 3 == 0, F.lit('<a> "b",\r\nc')).otherwise(F.col("n").cast("string")))
    order, own, want = [F.asc("n"), F.asc("pos")], tmp_path / f"own.{kind}", tmp_path / f"want.{kind}"
    write = E.write_csv if kind == "csv" else E.write_spreadsheet
    assert write(rows, str(want), order) and E.write_one_file(rows, f"file://{own}", order, kind)
    assert own.read_bytes() == want.read_bytes() and own.stat().st_size > 100_000
    assert E.write_one_file(rows.where("n = 7 AND pos = 3"), f"file://{own}", order, kind) and write(rows.where("n = 7 AND pos = 3"), str(want), order)
    assert own.read_bytes() == want.read_bytes()
    assert not E.write_one_file(rows.limit(0), f"file://{own}", order, kind) and own.read_bytes() == want.read_bytes()
    assert bytes(spark.read.format("binaryFile").load(f"file://{own}").first()["content"]) == own.read_bytes()
    assert {p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")} == {own.name, want.name}


def test_one_file_where_bytes_are_copied(spark, tmp_path, monkeypatch):
    """A file system that is no shared disk."""
    from pyspark.sql import functions as F

    class Elsewhere:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return (lambda: "store") if name == "getScheme" else getattr(self.fs, name)

    joined, rows = E._joined, spark.range(300).selectExpr("id AS year", "'x,y' AS title")
    monkeypatch.setattr(E, "_joined", lambda spark, fs, *a: joined(spark, Elsewhere(fs), *a))
    for kind, write in (("csv", E.write_csv), ("xml", E.write_spreadsheet)):
        assert E.write_one_file(rows, f"file://{tmp_path}/own", [F.asc("year")], kind) and write(rows, str(tmp_path / "want"), [F.asc("year")])
        assert (tmp_path / "own").read_bytes() == (tmp_path / "want").read_bytes()
