"""Joins that stand for lookup loops and dictionary accesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the smallest values of ``order``, nulls first, by partial aggregation: no key's rows are gathered."""
    least = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__r"))
    return least.select("__r.*")


def with_counts(rows: DataFrame, facts: DataFrame, key: str, fact_key: str, name: str) -> DataFrame:
    """``rows`` (a page) with the number of facts per key, 0 where there are none; only the page's keys are counted."""
    wanted = facts.join(rows.select(F.col(key).alias(fact_key)), fact_key, "left_semi").groupBy(fact_key).agg(F.count(F.lit(1)).alias(name))
    return rows.join(wanted.withColumnRenamed(fact_key, key), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def with_dimension(df: DataFrame, code: str, dim: DataFrame, dim_key: str, columns: list[str], default: str) -> DataFrame:
    """``df`` with a small dimension's columns; unknown and null codes get the default row's, or nulls where the dimension lacks that row."""
    # The dimension is a constant relation of a few rows; Spark broadcasts it by its size. The default is one row of it.
    known = dim.select(F.col(dim_key).alias("__k"), F.struct(*columns).alias("__d"))
    other = dim.where(F.col(dim_key) == default).limit(1).select(F.lit(1).alias("__one"), F.struct(*columns).alias("__o"))
    out = df.withColumn("__one", F.lit(1)).join(known, df[code] == F.col("__k"), "left").join(other, "__one", "left").withColumn("__d", F.coalesce("__d", "__o"))
    return out.select(*df.columns, *[F.col(f"__d.{c}").alias(c) for c in columns])


def domain_counts(domain: DataFrame, key: str, facts: DataFrame, fact_key: str, name: str = "n") -> DataFrame:
    """Every member of a domain with its number of facts, 0 included. Facts are counted first, so the join is as small as the domain."""
    counted = facts.groupBy(F.col(fact_key).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return domain.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def existence(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a flag: is its key among the other's?"""
    keys = other.select(F.col(key).alias("__o")).distinct()
    return df.join(keys, df[key] == F.col("__o"), "left").withColumn(name, F.col("__o").isNotNull()).drop("__o")


def missing(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key does not exist yet."""
    return new.join(existing.select(*keys), keys, "left_anti")


def fallback_lookup(df: DataFrame, other: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The value found by the first key that finds one; null where none does. The other's keys must be unique."""
    out = df
    for i, k in enumerate(keys):
        found = other.where(F.col(k).isNotNull()).select(F.col(k).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.join(found, out[k] == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    return out.withColumn(name, F.coalesce(*[F.col(f"__v{i}") for i in range(len(keys))])).drop(*[f"__v{i}" for i in range(len(keys))])


def favourites(favs: DataFrame, listings: DataFrame) -> DataFrame:
    """Favourites (id, user_id, listing_id, created_at) with the listing nested; those whose listing is gone are dropped."""
    nested = listings.select(F.col("id").alias("listing_id"), F.struct(*listings.columns).alias("listing"))
    return favs.join(nested, "listing_id").select(favs["id"], "user_id", "listing_id", "listing", favs["created_at"])


def favourites_of(favs: DataFrame, listings: DataFrame, user_id: Column | str | int) -> DataFrame:
    """One user's favourites, newest first; ties by the favourite's id. Only that user's rows are joined."""
    return favourites(favs.where(F.col("user_id") == user_id), listings).orderBy(F.desc("created_at"), "id")


def searches_of(users: DataFrame, searches: DataFrame) -> DataFrame:
    """Users with their searches (id, name, is_active, new_count, total_count) as an array of structs, newest first, ties by the larger id."""
    shown = ["id", "name", "is_active", "new_count", "total_count"]
    newest = F.sort_array(F.collect_list(F.struct("created_at", *shown)), False)
    held = searches.groupBy("user_id").agg(F.transform(newest, lambda x: F.struct(*[x[c].alias(c) for c in shown])).alias("searches"))
    return users.join(held, users["id"] == held["user_id"], "left").drop("user_id").withColumn("searches", F.coalesce("searches", F.array().cast(held.schema["searches"].dataType)))
