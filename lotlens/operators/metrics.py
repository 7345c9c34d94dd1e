"""Dashboards: one pass per fact table, all counts at once. ``as_of`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.predicates import trial_active
from lotlens.functions.scalars import guarded_ratio, percent
from lotlens.operators.joins import domain_counts, with_dimension


def day(ts: str | Column, days: int = 0) -> Column:
    base = F.date_trunc("day", F.lit(ts).cast("timestamp") if isinstance(ts, str) else ts)
    return base + F.expr(f"INTERVAL {days} DAYS") if days else base


def admin_users(users: DataFrame, as_of: str) -> DataFrame:
    """total, today, this week (from midnight seven days ago), trials; one row."""
    at = F.col("created_at").cast("timestamp")
    return users.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if(at >= day(as_of)).alias("new_today"),
        F.count_if(at >= day(as_of, -7)).alias("new_week"),
        F.count_if(trial_active("trial_ends_at", F.lit(as_of).cast("timestamp"))).alias("trials"),
    )


def user_activity(notifications: DataFrame, as_of: str) -> DataFrame:
    """total, unread, today and yesterday per user."""
    at = F.col("created_at").cast("timestamp")
    return notifications.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_read").eqNullSafe(False)).alias("unread"),
        F.count_if(at >= day(as_of)).alias("today"),
        F.count_if((at >= day(as_of, -1)) & (at < day(as_of))).alias("yesterday"),
    )


def revenue_by_plan(users: DataFrame, plans: DataFrame, plan: str = "plan") -> DataFrame:
    """Every plan with its users, price and monthly revenue, 0 included; users of unknown plans count nowhere."""
    counted = domain_counts(plans.select("id", "price_uah"), "id", users, plan, "users")
    return counted.withColumn("revenue_uah", F.col("users") * F.col("price_uah"))


def revenue_summary(by_plan: DataFrame, free: str = "free") -> DataFrame:
    """mrr, arr, paid users and revenue per user (over all users, at least 1); one row."""
    whole = by_plan.agg(
        F.coalesce(F.sum("revenue_uah"), F.lit(0)).cast("long").alias("mrr"),
        F.coalesce(F.sum(F.when(F.col("id") != free, F.col("users"))), F.lit(0)).cast("long").alias("paid_users"),
        F.coalesce(F.sum("users"), F.lit(0)).cast("long").alias("total_users"),
    )
    return whole.select("mrr", (F.col("mrr") * 12).alias("arr"), "paid_users", "total_users", guarded_ratio(F.col("mrr").cast("double"), F.col("total_users")).alias("arpu"))


def with_shares(by_group: DataFrame, count: str = "users") -> DataFrame:
    """Groups (few rows) with their rounded percentage of the total and of the largest group (at least 1)."""
    totals = by_group.agg(F.sum(count).alias("__sum"), F.max(count).alias("__max"))
    return (
        by_group.crossJoin(totals)  # one row
        .withColumn("share", percent(F.col(count), F.col("__sum")))
        .withColumn("of_largest", F.col(count) / F.greatest("__max", F.lit(1)))
        .drop("__sum", "__max")
    )


def daily_series(facts: DataFrame, ts: str, as_of: str, days: int = 7) -> DataFrame:
    """(day, label ``dd.MM``, n) of the last days up to and with as_of's, oldest first, 0 included.

    Only the days wanted are read and counted; the calendar has as many rows as days.
    """
    spark = facts.sparkSession
    calendar = spark.range(days).select((day(as_of, 1 - days) + F.make_dt_interval(F.col("id").cast("int"))).alias("day"))
    at = F.col(ts).cast("timestamp")
    counted = facts.where((at >= day(as_of, 1 - days)) & (at < day(as_of, 1))).groupBy(F.date_trunc("day", at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counted, "day", "left").select("day", F.date_format("day", "dd.MM").alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def remaining_searches(users: DataFrame, searches: DataFrame, plans: DataFrame, plan: str = "plan", default: str = "free") -> DataFrame:
    """Per user: limit of the plan, all and active searches, whether another may be made (all count), and the rest by active ones, at least 0."""
    counted = searches.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("used"), F.count_if("is_active").alias("active"))
    out = with_dimension(users, plan, plans.withColumnRenamed("id", "plan_id"), "plan_id", ["searches_limit"], default).join(counted, "id", "left").fillna(0, ["used", "active"])
    return out.withColumns({"may_create": F.col("used") < F.col("searches_limit"), "remaining": F.greatest(F.lit(0).cast("long"), F.col("searches_limit") - F.col("active"))})


def all_and_any(df: DataFrame, test: Column) -> DataFrame:
    """Whether every row and some row passes; of no rows, true and false."""
    return df.agg(F.coalesce(F.every(test), F.lit(True)).alias("every_row"), F.coalesce(F.some(test), F.lit(False)).alias("some_row"))


def previous_value(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Rows whose value fell since the key's row before (an extension: price drops)."""
    w = Window.partitionBy(key).orderBy(ts)
    return df.withColumn("previous", F.lag(value).over(w)).where(F.col(value) < F.col("previous"))
