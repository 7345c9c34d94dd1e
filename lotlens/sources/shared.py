"""Tables between steps: written to the folder that driver and executors share, so that lineage is cut and a lost executor costs its tasks only."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own on a single machine, else an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_lotlens_steps", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = sc._lotlens_steps = "file://" + tempfile.mkdtemp(prefix="lotlens-steps-")
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table of its own in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lotlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lotlens_path = path
    paths = spark.sparkContext._lotlens_tables = getattr(spark.sparkContext, "_lotlens_tables", set())
    paths.add(path)
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete the tables that ``written`` made for these, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_lotlens_path", None):
            _delete(df.sparkSession, path)


def drop_all(spark: SparkSession) -> None:
    """Delete every table that ``written`` made in this session: once the results that read them are saved elsewhere."""
    for path in list(getattr(spark.sparkContext, "_lotlens_tables", ())):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    spark.sparkContext._lotlens_tables.discard(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark context, for the stateful operators that run in Python."""
    sc = spark.sparkContext
    if getattr(sc, "_lotlens_sent", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="lotlens-package-")) / f"lotlens_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, str(path.relative_to(PACKAGE.parent)))
    sc.addPyFile(str(archive))
    sc._lotlens_sent = True
