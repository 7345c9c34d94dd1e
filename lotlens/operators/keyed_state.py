"""Keyed state from an append-only log: time-to-live maps, one-time tokens, cooldowns and bounded attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.operators.paging import placed
from lotlens.sources.shared import written


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's last row, by partial aggregation: no key's history is gathered."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return last.select(key, "__r.*")


def kv_state(log: DataFrame, now: float) -> DataFrame:
    """(key, value, expires_at) of a log (key, op ``set`` or ``delete``, value, expires_at, ts, seq): last write wins, deleted and ended keys are gone."""
    return latest(log, "key", ["ts", "seq"]).where((F.col("op") == "set") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).select("key", "value", "expires_at")


def kv_ttl(state: DataFrame, keys: DataFrame, now: float) -> DataFrame:
    """Whole seconds left: -1 for a key that is missing or never ends, -2 for under a second."""
    left = F.floor(F.col("expires_at") - now).cast("long")
    return keys.join(state, "key", "left").select("key", F.when(F.col("expires_at").isNull(), F.lit(-1)).when(left <= 0, F.lit(-2)).otherwise(left).cast("long").alias("ttl"))


def open_tokens(log: DataFrame, now: float) -> DataFrame:
    """One-time tokens that are set, not consumed since, and not ended."""
    return latest(log, "key", ["ts", "seq"]).where((F.col("op") == "set") & (F.col("expires_at") > now)).select("key", "value")


def token_uses(log: DataFrame, key: str, order: list[str], at: str, kind: str, name: str, ttl: float) -> DataFrame:
    """The ``consume`` rows of a log of one-time tokens with ``served`` and ``set_by``, the ``name`` of the ``set`` row whose token it got (else null).

    A token lives ``ttl`` seconds and is gone with its first use; a new one takes its place. at: seconds. ``order`` must be unique in a key.
    """
    w = Window.partitionBy(key).orderBy(*order)
    is_set = F.col(kind) == "set"
    rows = log.withColumns({"__token": F.count_if(is_set).over(w), "__by": F.last(F.when(is_set, F.col(name)), ignorenulls=True).over(w), "__end": F.last(F.when(is_set, F.col(at) + ttl), ignorenulls=True).over(w)})
    first = F.row_number().over(Window.partitionBy(key, "__token", kind).orderBy(*order)) == 1
    served = (F.col("__token") > 0) & first & F.coalesce(F.col(at) < F.col("__end"), F.lit(False))
    uses = rows.withColumn("served", served).where(F.col(kind) == "consume")
    return uses.withColumn("set_by", F.when(F.col("served"), F.col("__by"))).drop("__token", "__by", "__end")


def within_cooldown(log: DataFrame, key: str, ts: str, seconds: int, unique: str) -> DataFrame:
    """Requests with ``too_soon``: less than so many seconds after the key's request before, whether or not that one passed."""
    w = Window.partitionBy(key).orderBy(ts, unique)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return log.withColumn("too_soon", F.coalesce(gap < seconds * 1_000_000, F.lit(False)))


def accepted_sends(log: DataFrame, key: str, ts: str, seconds: int, unique: str) -> DataFrame:
    """The exact gate: ``log`` with ``accepted``, true if the key's last request that passed lies at least so many seconds back.

    Rejected requests don't restart the timer. Each request points to its key's first one that could pass after it did, by two sorts: of
    the requests, and of requests merged with the moments at which their timers end. Whoever follows a gap of the whole time passes in any
    case, which cuts a key's requests into sessions; from there the pointers are followed by doubling, so that one key's
    requests, however many, are spread over all tasks, and a session of n that pass takes log n joins. Pointers that
    nothing leads to are left behind at each step. Of requests at one moment the one with the smallest ``unique`` passes, if any.

    Rows without key or time don't pass. With no seconds all others do. An empty log gives an empty result.
    """
    rows = log.withColumns({"__us": F.unix_micros(F.col(ts).cast("timestamp"))})
    given = F.col(key).isNotNull() & F.col("__us").isNotNull()
    if seconds <= 0:
        return rows.withColumn("accepted", given).drop("__us")
    moments = rows.where(given).groupBy(F.col(key).alias("k"), F.col("__us").alias("us")).agg(F.min(unique).alias("one"))
    moments = placed(moments, [F.asc("k"), F.asc("us")], "r")
    ends = moments.select("k", (F.col("us") + seconds * 1_000_000).alias("us"), F.col("r").alias("of"))
    merged = placed(ends.unionByName(moments.select("k", "us", F.lit(None).cast("long").alias("of"))), [F.asc("k"), F.asc("us"), F.asc_nulls_last("of")], "m")
    # before the end of r's timer come r such ends (its own among them) and all requests that are too soon or of earlier keys
    after = written(merged.where("of IS NOT NULL").select(F.col("of").alias("r"), (F.col("m") - F.col("of") + 1).alias("next")), "gate")
    starts = after.where("next = r + 1").select(F.col("next").alias("r")).unionByName(after.where("r = 1").select("r"))
    jumps = written(after.join(starts.withColumnRenamed("r", "next"), "next", "left_anti").join(after.select(F.col("r").alias("next")), "next", "left_semi").select("r", "next"), "gate")
    levels = []
    while not jumps.isEmpty():
        levels.append(jumps)
        reached = jumps.select(F.col("next").alias("r")).unionByName(starts).distinct()
        led = jumps.join(reached, "r", "left_semi")
        jumps = written(led.alias("a").join(led.alias("b"), F.col("a.next") == F.col("b.r")).select("a.r", "b.next"), "gate")
    passed = starts
    for level in reversed(levels):
        passed = passed.join(level, "r", "left").select(F.explode(F.array_compact(F.array("r", "next"))).alias("r"))
    firsts = moments.join(passed, "r", "left_semi").select(F.col("k").alias(key), F.col("us").alias("__us"), F.col("one").alias("__one"))
    return rows.join(firsts, [key, "__us"], "left").withColumn("accepted", F.coalesce(F.col(unique) == F.col("__one"), F.lit(False))).select(*log.columns, "accepted")


def code_tries(log: DataFrame, key: str, order: list[str], at: str, kind: str, ttl: int, limit: int = 5) -> DataFrame:
    """A log of one-time codes with what each row finds: live and failed_before (0 unless live), and what it leaves: expires_at and deleted.

    kind: ``register`` starts a code with ``ttl`` seconds; ``refresh`` sets a new one with no failed tries; ``wrong`` counts a failed try;
    ``right`` uses the code up, as the ``limit``-th wrong try does. refresh and wrong keep the time that is left, in whole seconds, so each
    moves the end forward by the fraction; in a code's last second nothing is left to keep: a wrong try isn't counted there, and a
    refresh starts the whole time again. What comes after the end or a deletion finds nothing until the key registers again, and
    leaves expires_at as it was. at: seconds, exact to a microsecond. ``order`` must be unique in a key.

    Within a time that runs on, ends follow from the times' fractions alone, by window sums; each pass over the log finds the first refresh in a last
    second after each start, which starts a time of its own in the next pass, until there is none.
    """
    second = 1_000_000
    w = Window.partitionBy(key).orderBy(*order)
    rows = log.withColumns({"__us": F.round(F.col(at) * second).cast("bigint"), "__start": F.col(kind) == "register", "__found": F.lit(None).cast("bigint")})
    touch = F.col(kind).isin("wrong", "refresh") & ~F.col("__start")
    while True:
        s = Window.partitionBy(key, "__session").orderBy(*order)
        before, first = s.rowsBetween(Window.unboundedPreceding, -1), lambda test, value, over: F.first(F.when(test, value), ignorenulls=True).over(over)
        out = rows.withColumns({"__session": F.count_if("__start").over(w), "__part": F.pmod("__us", F.lit(second))})
        # an end is a whole second and the fraction of whoever moved it last; it moves a second forward where the fraction grows
        out = out.withColumn("__last", F.last(F.when(touch | F.col("__start"), F.col("__part")), ignorenulls=True).over(before))
        out = out.withColumn("__moves", F.when(touch & (F.col("__part") > F.col("__last")), 1).otherwise(0))
        out = out.withColumns({"__base": first(F.col("__start"), F.floor(F.col("__us") / second) + ttl, s), "__moved": F.sum("__moves").over(s)})
        out = out.withColumns({"__end": (F.col("__base") - F.col("__moved") + F.col("__moves")) * second + F.col("__last"), "__next": (F.col("__base") - F.col("__moved")) * second + F.col("__part")})
        out = out.withColumn("__short", touch & (F.col("__end") - F.col("__us") < second))
        out = out.withColumn("__end", F.coalesce(first(F.col("__short"), F.col("__end"), before), "__end"))
        out = out.withColumns({"__open": ~F.col("__start") & (F.col("__session") > 0) & (F.col("__end") > F.col("__us")), "__generation": F.count_if((F.col(kind) == "refresh") & ~F.col("__start")).over(before)})
        g = Window.partitionBy(key, "__session", "__generation").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("__failed", F.coalesce(F.count_if((F.col(kind) == "wrong") & ~F.col("__short")).over(g), F.lit(0)))
        out = out.withColumn("__ends", F.col("__open") & ((F.col(kind) == "right") | ((F.col(kind) == "wrong") & (F.col("__failed") >= limit - 1))))
        out = out.withColumn("__gone", first(F.col("__ends"), F.col("__end"), before))
        out = out.withColumn("__live", F.col("__open") & F.col("__gone").isNull())
        again = F.col("__live") & F.col("__short") & (F.col(kind) == "refresh")
        out = written(out.withColumn("__again", again & (F.coalesce(F.count_if(again).over(before), F.lit(0)) == 0)), "codes")
        if out.where("__again").isEmpty():
            break
        rows = out.select(*log.columns, "__us", (F.col("__start") | F.col("__again")).alias("__start"), F.when(F.col("__again"), F.col("__failed")).otherwise(F.col("__found")).alias("__found"))
    live = F.col("__live") | F.col("__found").isNotNull()
    left = (
        F.when(F.col("__start"), F.col("__us") + ttl * second).when(F.col("__gone").isNotNull(), F.col("__gone"))
        .when(F.col("__live") & touch & ~F.col("__short") & ~F.col("__ends"), F.col("__next")).otherwise(F.col("__end"))
    )
    failed = F.coalesce("__found", F.when(F.col("__live"), F.col("__failed")), F.lit(0).cast("bigint"))
    return out.select(*log.columns, (left / second).alias("expires_at"), live.alias("live"), failed.alias("failed_before"), F.coalesce(F.col("__live") & F.col("__ends"), F.lit(False)).alias("deleted"))


def attempts(log: DataFrame, key: str, generation: str, order: list[Column], wrong: Column, limit: int) -> DataFrame:
    """Tries with the wrong ones so far in their generation (a refreshed code starts a new one) and whether the code still lives before and after."""
    w = Window.partitionBy(key, generation).orderBy(*order)
    so_far = F.coalesce(F.count_if(wrong).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = log.withColumn("failed_before", so_far)
    dead = F.col("failed_before") >= limit
    return out.withColumn("accepted", ~wrong & ~dead).withColumn("deleted_now", wrong & (F.col("failed_before") == limit - 1))
