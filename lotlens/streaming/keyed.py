"""The key-value map with a time to live, and one-time tokens, as a stream with state, timers and restarts.

Each key's state is its last write; event-time timers end entries once the watermark has passed their time, so that state holds live keys
and what may still be overtaken by a late row. State is kept in RocksDB and written to the checkpoint; a stream that is started
again on its checkpoint goes on where it stopped, and ``entries`` reads the state as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lotlens.sources.shared import ship

ENTRY = "op string, value string, expires_at double, us long, seq long"
CHANGES = "key string, kind string, value string, us long, seq long"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timer(entry: tuple) -> int | None:
    """Milliseconds at which an entry can be forgotten: a live one at its end, a deleted one once no older row can come; neither before its own time."""
    op, _, expires_at, us, _ = entry
    if op == "set" and expires_at is None:
        return None
    return max(-(-us // 1000), 0 if op != "set" else int(-(-expires_at * 1000 // 1)))


class KeyedLog(StatefulProcessor):
    """One key's log: ``set``, ``delete`` and ``consume`` (get and delete at once), in order of time and number; what is older than the last write changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY)

    def _held(self) -> tuple | None:
        held = self.entry.get()
        return None if held is None else tuple(held)

    def _put(self, before: tuple | None, entry: tuple) -> None:
        old, new = before and _timer(before), _timer(entry)
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        self.entry.update(entry)
        if new is not None and old != new:
            self.handle.registerTimer(new)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        entry = before = self._held()
        for r in sorted(rows, key=lambda r: (r["us"], r["seq"])):
            newer = entry is None or (r["us"], r["seq"]) > (entry[3], entry[4])
            found = entry is not None and entry[0] == "set" and (entry[2] is None or entry[2] > r["us"] / 1e6)
            if r["op"] == "consume":
                held = entry[1] if newer and found else None
                yield Row(key=key[0], kind="consume", value=held, us=r["us"], seq=r["seq"])
                if held is None:
                    continue
            elif newer:
                yield Row(key=key[0], kind=r["op"], value=r["value"], us=r["us"], seq=r["seq"])
            if newer:
                after = ("set", r["value"], r["expires_at"], r["us"], r["seq"]) if r["op"] == "set" else ("gone", None, None, r["us"], r["seq"])
                entry = after
        if entry is not before:  # once for all rows, as each call goes to the JVM and back
            self._put(before, entry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entry = self._held()
        if entry is None or _timer(entry) is None or _timer(entry) > expiredTimerInfo.getExpiryTimeInMs():
            return
        self.entry.clear()
        if entry[0] == "set":
            yield Row(key=key[0], kind="expire", value=entry[1], us=entry[3], seq=entry[4])

    def close(self) -> None:
        pass


def keyed_changes(log: DataFrame, late: str = "0 seconds") -> DataFrame:
    """What a streamed log (key string, op, value string, expires_at double, ts, seq long) does to its map: (key, kind, value, us, seq).

    kind: ``set``, ``delete``, ``expire``, or ``consume`` with the token's value if it was there (null if not: missing, used, ended). Rows may
    come in any order within ``late``; later ones are dropped. A consumer is served by the state at its arrival, so of two
    consumers the first to arrive gets the token. Rows without key or time change nothing.
    """
    ship(log.sparkSession)
    rows = log.withColumn("at", F.col("ts").cast("timestamp")).where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    rows = rows.select("key", "op", "value", F.col("expires_at").cast("double").alias("expires_at"), "at", F.unix_micros("at").alias("us"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("key").transformWithState(statefulProcessor=KeyedLog(), outputStructType=CHANGES, outputMode="Append", timeMode="eventTime")


def start(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the changes to a table at ``path`` until the source has no more; started again on its checkpoint, it takes what is new, each row once."""
    conf, before = changes.sparkSession.conf, changes.sparkSession.conf.get(STORE[0])
    conf.set(*STORE)
    try:
        return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(STORE[0], before)


def entries(spark: SparkSession, checkpoint: str, now: float | None = None) -> DataFrame:
    """(key, value, expires_at) of the state at a checkpoint; with ``now``, without entries that have ended by then though no timer has run."""
    state = spark.read.format("statestore").option("stateVarName", "entry").load(checkpoint)
    rows = state.select("key.key", "value.*").where("op = 'set'")
    return (rows if now is None else rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))).select("key", "value", "expires_at")
