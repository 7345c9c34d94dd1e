"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark context, so that Python tasks can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_lotlens_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="lotlens-"), f"lotlens_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, str(path.relative_to(PACKAGE.parent)))
    sc.addPyFile(archive)
    sc._lotlens_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of our own on a single machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_lotlens_shared", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lotlens-shared-")
        spark.sparkContext._lotlens_shared = folder
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lotlens-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs at most the tasks it ran; nothing is kept in executor memory.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _written(spark).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lotlens_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialise`` wrote for ``df``, if anything."""
    path = getattr(df, "_lotlens_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all that ``materialise`` wrote in this session: once results that read it are saved elsewhere."""
    for path in list(_written(spark)):
        _delete(spark, path)


def _written(spark: SparkSession) -> set[str]:
    sc = spark.sparkContext
    sc._lotlens_written = getattr(sc, "_lotlens_written", set())
    return sc._lotlens_written


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written(spark).discard(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_if_null(col) -> F.Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def whole_runs(frames, key: list[str]):
    """Pandas frames in which no run of equal ``key`` values is torn, from batches that are sorted by ``key``."""
    import pandas as pd

    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        cut = int((keys == keys[-1]).all(axis=1).argmax())  # the last run may go on in the next batch
        held = frame.iloc[cut:]
        if cut:
            yield frame.iloc[:cut]
    if held is not None and len(held):
        yield held


def in_blocks(rows: DataFrame, group: list[str], hot: int, first: bool) -> DataFrame:
    """``rows`` (the group's columns, its size n, id, root) with ``deal``: groups of at most ``hot`` rows whole (-1), larger ones in blocks of half as many.

    At first, a block is searched by itself; each group has other blocks. Later, when most of a large group is connected,
    only its members outside of its commonest root go to all blocks, so that every link between different roots has a deal.
    """
    half = hot // 2
    parts = F.ceil(F.col("n") / half).cast("int")
    mine = F.pmod(F.xxhash64("id", *group), parts).cast("long")
    small, large = rows.where(F.col("n") <= hot).withColumn("deal", F.lit(-1).cast("long")), rows.where(F.col("n") > hot)
    if first:
        return small.unionByName(large.withColumn("deal", mine))
    main = large.groupBy(*group, "root").agg(F.count(F.lit(1)).alias("c")).groupBy(*group).agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("others")).where("others > 0")
    groups = F.ceil(F.col("others") / half).cast("int")
    wide = F.lit(1 << 32)
    own = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: mine * wide + g)
    across = F.transform(F.sequence(F.lit(0), parts - 1), lambda b: b * wide + F.pmod(F.xxhash64("id", F.lit(1)), groups))
    deals = F.when(F.col("root") == F.col("main"), own).otherwise(F.array_union(own, across))
    return small.unionByName(large.join(main, group).withColumn("deal", F.explode(deals)).drop("main", "others"))
