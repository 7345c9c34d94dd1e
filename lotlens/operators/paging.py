"""Places in a sorted whole, and pages far into it, without sorting again or skipping rows one by one."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.functions.predicates import page_arguments
from lotlens.sources.shared import written


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in ranges of the sort, with __range and __at, a row's position in its range from 0; one row order for a run of the plan."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return rows.withColumns({"__range": F.shiftright("__at", 33).cast("int"), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})


def _starts(rows: DataFrame) -> DataFrame:
    """(__range, first, n): rows before each range, and its own; a row for each range, so few that one driver sums them."""
    at, found = 0, []
    for r in sorted(rows.groupBy("__range").count().collect()):
        found.append((r["__range"], at, r["count"]))
        at += r["count"]
    return rows.sparkSession.createDataFrame(found, "__range int, first long, n long")


def placed(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """All rows with their place in the sort, from 1; ``order`` must end in a unique key.

    Rows are sorted in ranges, not in one task; a row's place is its place in its range after the rows of the ranges before. The sorted
    rows are written to the shared folder first, so that ranges and places are of one run (``sources.shared.drop_all`` deletes them).
    """
    rows = written(_ranged(df, order), "placed")
    out = rows.join(_starts(rows), "__range").select(*df.columns, (F.col("first") + F.col("__at") + 1).alias(place))
    out._lotlens_path = rows._lotlens_path
    return out


def write_sorted(df: DataFrame, order: list[Column], path: str) -> None:
    """Write ``df`` sorted, for ``sorted_page``: a folder for each range of the sort, and a table of how many rows each has."""
    _ranged(df, order).write.partitionBy("__range").parquet(f"{path}/rows")
    starts = _starts(df.sparkSession.read.parquet(f"{path}/rows"))
    starts.coalesce(1).write.parquet(f"{path}/ranges")


def sorted_rows(spark: SparkSession, path: str, first: int, count: int, place: str = "place") -> DataFrame:
    """The rows with places first + 1 to first + count, in order: only the ranges that hold them are opened."""
    ranges = spark.read.parquet(f"{path}/ranges").where((F.col("first") < first + count) & (F.col("first") + F.col("n") > first)).collect()
    rows = spark.read.parquet(f"{path}/rows")
    hit = [(F.col("__range") == r["__range"]) & (F.col("__at") >= first - r["first"]) & (F.col("__at") < first + count - r["first"]) for r in ranges]
    at = F.lit(None).cast("long")
    for r in ranges:
        at = F.when(F.col("__range") == r["__range"], F.lit(r["first"]) + F.col("__at") + 1).otherwise(at)
    found = rows.where(reduce(or_, hit) if hit else F.lit(False))
    return found.withColumn(place, at.cast("long")).drop("__range", "__at").orderBy(place)


def sorted_page(spark: SparkSession, path: str, number: int = 1, per_page: int = 20) -> DataFrame:
    """One page of what ``write_sorted`` wrote: however far in, it reads the one or two ranges that the page lies in. Beyond the end: no rows."""
    offset, limit = page_arguments(number, per_page)
    return sorted_rows(spark, path, offset, limit).drop("place")


def after(cursor: dict, descending: tuple[str, ...] = ()) -> Column:
    """Rows that come after the cursor (the last row's sort values, most important first, ending in a unique key): a test that reaches the scan.

    Nulls have no place in such a sort: leave them out or fill them first.
    """
    tests, equal = [], F.lit(True)
    for name, value in cursor.items():
        beyond = F.col(name) < F.lit(value) if name in descending else F.col(name) > F.lit(value)
        tests.append(equal & beyond)
        equal = equal & (F.col(name) == F.lit(value))
    return reduce(or_, tests)


def next_page(df: DataFrame, cursor: dict | None, by: tuple[str, ...], descending: tuple[str, ...] = (), per_page: int = 20) -> DataFrame:
    """The page after a cursor ({name: value} of ``by``, None for the first page): a filter and a top-k, with no offset."""
    _, limit = page_arguments(1, per_page)
    rows = df if cursor is None else df.where(after({c: cursor[c] for c in by}, descending))
    return rows.orderBy(*[F.desc(c) if c in descending else F.asc(c) for c in by]).limit(limit)
