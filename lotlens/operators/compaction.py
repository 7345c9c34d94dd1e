"""A key-value map kept as a snapshot in buckets: a batch of its log rewrites the buckets that it touches and no others.

The snapshot is one folder for each bucket of keys and version of it; a commit lists each bucket's folder. A batch is first reduced to
each key's last row, then merged with the buckets of its keys; what it doesn't touch stays where it is. Readers see a commit
whole, old commits stay readable until they are forgotten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.operators.keyed_state import latest
from lotlens.sources.commits import commit, commit_numbers, committed, forget

ROW = "key string, op string, value string, expires_at double, ts timestamp, seq long"
NAMES = [c.split()[0] for c in ROW.split(", ")]
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, int, dict[int, str]]:
    """(commit's number, buckets, folder of each bucket that has rows); number 0 and nothing before the first commit."""
    if number is None and not commit_numbers(spark, path):
        return 0, 0, {}
    number = number or commit_numbers(spark, path)[-1]
    m = json.loads(committed(spark, path, number))
    return number, m["buckets"], {int(k): v for k, v in m["folders"].items()}


def _stored(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], ROW)
    return spark.read.schema(ROW).parquet(*[f"{path}/{f}" for f in sorted(folders)])


def apply_batch(log: DataFrame, path: str, forget_before: float | None = None, buckets: int = BUCKETS) -> dict:
    """Merge a batch of log rows (key, op ``set`` or ``delete``, value, expires_at, ts, seq) into the map at ``path``; returns commit, buckets touched and files read.

    A key's last row by (ts, seq) counts, wherever it comes from, so batches may come in any order and one may come twice.
    Deleted and ended keys are kept as such, since a late batch may have older rows of them; with ``forget_before`` (seconds), those
    whose last row is older than that go when their bucket is rewritten: no batch may bring rows from before it. Rows without a key
    change nothing; an empty batch makes no commit (number of the last one, 0 if there is none).
    """
    spark = log.sparkSession
    number, before, folders = _manifest(spark, path)
    buckets = before or buckets
    last = latest(log.where("key IS NOT NULL").select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in ROW.split(", "))]), "key", ["ts", "seq"])
    last = last.select(*NAMES, _bucket(buckets).alias("bucket"))
    touched = sorted(r[0] for r in last.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return {"commit": number, "touched": [], "files": []}
    old = _stored(spark, path, [folders[b] for b in touched if b in folders])
    merged = latest(last.select(*NAMES).unionByName(old), "key", ["ts", "seq"]).select(*NAMES)
    if forget_before is not None:
        ended = (F.col("op") == "delete") | (F.col("expires_at") < forget_before)
        merged = merged.where(~F.coalesce(ended & (F.unix_micros("ts") < forget_before * 1e6), F.lit(False)))
    version = f"v-{uuid.uuid4().hex}"
    merged.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{version}")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}")
    written = {f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)}
    now = {b: f for b, f in folders.items() if b not in touched} | {b: f"{version}/bucket={b}" for b in touched if f"bucket={b}" in written}
    made = commit(spark, path, json.dumps({"buckets": buckets, "folders": {str(b): f for b, f in sorted(now.items())}}), number)
    return {"commit": made, "touched": touched, "files": sorted(old.inputFiles()) if folders else []}


def kv_rows(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The last row of each key, deleted and ended ones included, as of a commit (by default the last); none before the first."""
    return _stored(spark, path, list(_manifest(spark, path, number)[2].values()))


def kv_live(spark: SparkSession, path: str, now: float, keys: list[str] | None = None, number: int | None = None) -> DataFrame:
    """(key, value, expires_at) of the live keys; of a few keys, only their buckets are opened."""
    _, buckets, folders = _manifest(spark, path, number)
    if keys is not None and buckets:
        wanted = {r[0] for r in spark.createDataFrame([(k,) for k in keys], "key string").select(_bucket(buckets)).collect()}
        rows = _stored(spark, path, [f for b, f in folders.items() if b in wanted]).where(F.col("key").isin(*keys))
    else:
        rows = _stored(spark, path, list(folders.values()))
    return rows.where((F.col("op") == "set") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).select("key", "value", "expires_at")


def forget_versions(spark: SparkSession, path: str, keep: int = 1, minutes: float = 60) -> list[str]:
    """Drop old commits, and folders that none of those left uses at all; a folder goes when its last bucket is superseded."""
    return forget(spark, path, keep, lambda text: {f.split("/")[0] for f in json.loads(text)["folders"].values()}, minutes=minutes)
