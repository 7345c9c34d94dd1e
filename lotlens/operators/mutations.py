"""Writes as pure functions: (state, changes) -> state. Saving the result is one atomic table write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.operators.joins import first_by_key


def insert_rows(state: DataFrame, rows: DataFrame) -> DataFrame:
    return state.unionByName(rows, allowMissingColumns=True)


def patch(state: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Apply the patch's non-null fields by key; nested values are replaced as a whole, null never clears a field."""
    fields = [c for c in patches.columns if c != key]
    renamed = patches.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    joined = state.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in state.columns])


def bulk_set(state: DataFrame, where: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(state with the values set where the test holds, one row with the number changed)."""
    hit = F.coalesce(where, F.lit(False))
    return state.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}), state.agg(F.count_if(hit).alias("changed"))


def delete_owned(state: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Without the rows whose key and owner are both named."""
    return state.join(keys.select(*by), by, "left_anti")


def insert_missing(state: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert rows whose key is new; of several with one key, that with the smallest values of ``order``. Applying it again changes nothing."""
    new = rows.join(state.select(*keys), keys, "left_anti").select(*rows.columns)
    return insert_rows(state, first_by_key(new, keys, order))


def increment(state: DataFrame, events: DataFrame, key: str, event_key: str, counters: dict[str, Column]) -> DataFrame:
    """Add each key's sums of the events to its counters."""
    sums = events.groupBy(F.col(event_key).alias(key)).agg(*[F.sum(v).alias(f"__{c}") for c, v in counters.items()])
    joined = state.join(sums, key, "left")
    return joined.select(*[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).cast(state.schema[c].dataType).alias(c) if c in counters else F.col(c) for c in state.columns])


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent is left."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def set_null(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children with the key of a parent that is gone set to null."""
    left = parents.select(F.col(parent_key).alias("__p")).distinct()
    joined = children.join(left, children[key] == F.col("__p"), "left")
    return joined.select(*[F.when(F.col("__p").isNotNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in children.columns])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break a unique constraint; nulls never do."""
    given = df.dropna(subset=keys)
    return given.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def activate_plan(users: DataFrame, changes: DataFrame, plans: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Set plan and end of the named users (id, plan); unknown plans are an error of the caller and change nothing."""
    known = changes.join(plans.select(F.col("id").alias("plan")), "plan", "left_semi").select("id", "plan", (F.lit(as_of).cast("timestamp") + F.expr(f"INTERVAL {days} DAYS")).alias("plan_expires_at"))
    return patch(users, known, "id")


def seed_notifications(listings: DataFrame, user_id: str, search_id: str | None, labels: dict[str, str]) -> DataFrame:
    """A notification for each listing: text, and payload as a struct."""
    from lotlens.functions.scalars import label, thousands

    body = F.concat_ws(" · ", F.col("year").cast("string"), F.concat(thousands(F.col("mileage")), F.lit(" км")), F.concat(thousands(F.col("price")), F.lit(" грн")), "region")
    payload = F.struct("price", "year", "mileage", "region", "source", label(F.col("source"), labels).alias("source_label"), "url")
    return listings.select(F.lit(user_id).alias("user_id"), F.lit("listing_match").alias("type"), "title", body.alias("body"), F.col("external_id").alias("listing_id"), F.lit(search_id).alias("search_id"), payload.alias("payload"), F.lit(False).alias("is_read"), F.lit(False).alias("sent_telegram"))
