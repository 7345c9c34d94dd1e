"""Dashboards that are kept up to date: daily sums by key, to which batches of facts are added, each once.

A batch is summed by key and day and becomes a folder beside the others; a commit names the folders that count and the batches that
are in. A batch that comes again changes nothing, whatever the order, so the sums are those of all facts though none is read twice. Once
enough batches have gathered they are merged into one folder, so that a reader opens few.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.operators.metrics import day
from lotlens.sources.commits import commit, commit_numbers, committed, forget

#: Folders of single batches beside the merged one.
MERGE = 16


def _with(done: list[list[int]], batch: int) -> list[list[int]]:
    """Sorted, closed ranges of batch numbers with one more number."""
    out: list[list[int]] = []
    for a, b in sorted([*done, [batch, batch]]):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _state(spark: SparkSession, path: str) -> tuple[int, dict]:
    numbers = commit_numbers(spark, path)
    return (numbers[-1], json.loads(committed(spark, path))) if numbers else (0, {"done": [], "folders": []})


def _summed(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.groupBy(*[c for c in rows.columns if c not in names]).agg(*[F.sum(c).cast("long").alias(c) for c in names])


def add_batch(facts: DataFrame, path: str, batch: int, keys: list[str], ts: str, measures: dict[str, Column], merge: int = MERGE) -> bool:
    """Add a batch's sums of ``measures`` by key and day; False if a batch of that number is in already.

    A correction of earlier facts is a batch with negative measures. Null measures add nothing, null keys and times are groups of their own;
    an empty batch counts as in. Two writers at once: the second fails and may try again.
    """
    spark = facts.sparkSession
    number, state = _state(spark, path)
    if any(a <= batch <= b for a, b in state["done"]):
        return False
    names = list(measures)
    rows = facts.select(*keys, F.date_trunc("day", F.col(ts).cast("timestamp")).alias("day"), *[F.coalesce(v.cast("long"), F.lit(0)).alias(c) for c, v in measures.items()])
    folders, version = state["folders"], f"v-{uuid.uuid4().hex}"
    added = _summed(rows, names)
    if len(folders) >= merge:
        added, folders = _summed(added.unionByName(spark.read.parquet(*[f"{path}/{f}" for f in folders])), names), []
    added.write.parquet(f"{path}/{version}")
    commit(spark, path, json.dumps({"done": _with(state["done"], batch), "folders": [*folders, version]}), number)
    return True


def daily_sums(spark: SparkSession, path: str, measures: list[str]) -> DataFrame:
    """(keys, day, measures) over all batches that are in; an error before the first."""
    _, state = _state(spark, path)
    return _summed(reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{f}") for f in state["folders"]]), measures)


def forget_merged(spark: SparkSession, path: str, minutes: float = 60) -> list[str]:
    """Delete commits but the last, and folders that are merged into another."""
    return forget(spark, path, 1, lambda text: json.loads(text)["folders"], minutes=minutes)


def activity(sums: DataFrame, as_of: str, key: str = "user_id") -> DataFrame:
    """The user dashboard from daily sums (total, unread): total, unread, today and yesterday by user, as ``metrics.user_activity`` counts them."""
    on = lambda test: F.coalesce(F.sum(F.when(test, F.col("total"))), F.lit(0)).cast("long")
    return sums.groupBy(key).agg(
        F.sum("total").cast("long").alias("total"), F.sum("unread").cast("long").alias("unread"),
        on(F.col("day") >= day(as_of)).alias("today"), on(F.col("day") == day(as_of, -1)).alias("yesterday"),
    )


def daily_series(sums: DataFrame, as_of: str, days: int = 7, measure: str = "total") -> DataFrame:
    """(day, label, n) of the last days from daily sums, oldest first, 0 included, as ``metrics.daily_series`` counts them."""
    calendar = sums.sparkSession.range(days).select((day(as_of, 1 - days) + F.make_dt_interval(F.col("id").cast("int"))).alias("day"))
    held = sums.where((F.col("day") >= day(as_of, 1 - days)) & (F.col("day") <= day(as_of))).groupBy("day").agg(F.sum(measure).alias("n"))
    return calendar.join(held, "day", "left").select("day", F.date_format("day", "dd.MM").alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
