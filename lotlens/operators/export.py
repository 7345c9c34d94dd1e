"""Result exports: CSV and spreadsheet rows as Columns, and small single-file writers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.functions.scalars import csv_cell, label, xml_text
from lotlens.sources.commits import commit, commit_numbers, committed, forget
from lotlens.sources.constants import EXPORT_COLUMNS, EXPORT_NUMBERS, EXPORT_SHEET, RISK_LABELS


def cells(df: DataFrame) -> list[tuple[str, Column]]:
    """(key, text) of the export columns; a column that ``df`` lacks is empty."""
    out = []
    for key, _ in EXPORT_COLUMNS:
        if key == "riskLabel":
            value = F.coalesce(label(F.col("risk"), RISK_LABELS), F.lit("")) if "risk" in df.columns else F.lit("")
        else:
            value = F.coalesce(F.col(key).cast("string"), F.lit("")) if key in df.columns else F.lit("")
        out.append((key, value))
    return out


def csv_lines(df: DataFrame) -> Column:
    return F.concat_ws(",", *[csv_cell(v) for _, v in cells(df)])


def xml_rows(df: DataFrame) -> Column:
    parts = []
    for key, v in cells(df):
        kind = F.when(v != "", "Number").otherwise("String") if key in EXPORT_NUMBERS else F.lit("String")
        parts.append(F.concat(F.lit('<Cell><Data ss:Type="'), kind, F.lit('">'), xml_text(v), F.lit("</Data></Cell>")))
    return F.concat(F.lit("<Row>"), *parts, F.lit("</Row>"))


def _csv_head() -> str:
    """Byte order mark and header; a name with a comma is quoted like a cell."""
    return "\ufeff" + ",".join(f'"{h}"' if "," in h else h for _, h in EXPORT_COLUMNS)


def _sheet_head() -> str:
    spaces = {"": "spreadsheet", ":o": "office", ":x": "excel", ":ss": "spreadsheet"}
    attributes = " ".join(f'xmlns{p}="urn:schemas-microsoft-com:office:{n}"' for p, n in spaces.items())
    header = "".join(f'<Cell><Data ss:Type="String">{h}</Data></Cell>' for _, h in EXPORT_COLUMNS)
    return f'<?xml version="1.0"?>\n<?mso-application progid="Excel.Sheet"?>\n<Workbook {attributes}>\n<Worksheet ss:Name="{EXPORT_SHEET}"><Table>\n<Row>{header}</Row>\n'


SHEET_FOOT = "</Table></Worksheet>\n</Workbook>\n"


def write_csv(df: DataFrame, path: str, order: list[Column]) -> bool:
    """One CSV file for a spreadsheet on the driver's disk: byte order mark, CRLF between rows, none at the end. Nothing to write: False.

    Rows are formatted by Spark and streamed to the file; memory holds one partition at a time. ``write_one_file`` is for large results.
    """
    lines = df.orderBy(*order).select(csv_lines(df).alias("line"))
    if lines.isEmpty():
        return False
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(_csv_head())
        for row in lines.toLocalIterator():
            f.write("\r\n" + row["line"])
    return True


def write_spreadsheet(df: DataFrame, path: str, order: list[Column]) -> bool:
    """One workbook in the 2003 XML format on the driver's disk. Nothing to write: False."""
    rows = df.orderBy(*order).select(xml_rows(df).alias("row"))
    if rows.isEmpty():
        return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(_sheet_head())
        for row in rows.toLocalIterator():
            f.write(row["row"] + "\n")
        f.write(SHEET_FOOT)
    return True


def write_one_file(df: DataFrame, path: str, order: list[Column], kind: str = "csv") -> bool:
    """The bytes of ``write_csv`` (or, kind ``xml``, ``write_spreadsheet``) as one file at a path that driver and executors share, however large. Nothing to write: False.

    Executors write the ranges of the sort as files beside the target; their sizes say where each one's bytes belong. File systems that
    can join files by name do so, on a shared disk executors copy their range to its place in the target; elsewhere the driver's
    JVM copies the bytes, file after file. The target appears under its name once it is whole, in place of what was there.
    """
    spark = df.sparkSession
    end, line = ("\r\n", csv_lines(df)) if kind == "csv" else ("\n", xml_rows(df))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    aside = f"{path}.{uuid.uuid4().hex}"
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(line.alias("line")).write.option("lineSep", end).text(f"{aside}/rows")
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, folder = hadoop.Path(path), hadoop.Path(aside)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        parts = sorted((f.getPath().toString(), f.getLen()) for f in fs.listStatus(hadoop.Path(f"{aside}/rows")) if f.getPath().getName().startswith("part-") and f.getLen())
        if not parts:
            return False
        head, foot = (_csv_head() + end, "") if kind == "csv" else (_sheet_head(), SHEET_FOOT)
        if kind == "csv":  # no line break after the last row
            parts[-1] = (parts[-1][0], parts[-1][1] - len(end))
        whole = hadoop.Path(f"{aside}/whole")
        _joined(spark, fs, parts, head.encode(), foot.encode(), whole)
        fs.delete(target, False)
        if not fs.rename(whole, target):
            raise RuntimeError(f"{path} cannot be written")
        return True
    finally:
        fs.delete(folder, True)


def _joined(spark: SparkSession, fs, parts: list[tuple[str, int]], head: bytes, foot: bytes, whole) -> None:
    """Make ``whole`` of head, the first so many bytes of each part, and foot."""
    if fs.getScheme() == "file":
        at, places = len(head), []
        for name, size in parts:
            places.append((name, at, size))
            at += size
        name = whole.toUri().getPath()
        with open(name, "wb") as f:  # not by Hadoop, whose checksum file would be of the head alone
            f.write(head)
        rows = spark.createDataFrame(places, "part string, at long, size long").repartition(len(places), "part")
        rows.mapInPandas(lambda frames: _copied(frames, name), "size long").agg(F.sum("size")).collect()
        with open(name, "r+b") as f:
            f.seek(at)
            f.write(foot)
        return
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p, _ in parts]
    sizes = [fs.getFileStatus(p).getLen() for p in paths]
    joins = fs.getScheme() == "hdfs"
    copied = list(zip(paths, [s for _, s in parts], strict=True))[-1:] if joins and sizes[-1] != parts[-1][1] else [] if joins else list(zip(paths, [s for _, s in parts], strict=True))
    out = fs.create(whole, True)
    out.write(head)
    if joins:
        out.close()
        array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(paths) - len(copied))
        for i, p in enumerate(paths[: len(array)]):
            array[i] = p
        if len(array):
            fs.concat(whole, array)
        out = fs.append(whole)
    for p, size in copied:
        source = fs.open(p)
        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size)
        source.close()
    out.write(foot)
    out.close()


def _copied(frames, name: str):
    """Copy each part's bytes to their place in a file; done twice it gives the same file."""
    import pandas as pd

    for frame in frames:
        for part, at, size in frame.itertuples(index=False):
            with open(part.removeprefix("file:"), "rb") as source, open(name, "r+b") as f:
                f.seek(at)
                left = size
                while left and (block := source.read(min(left, 1 << 20))):
                    f.write(block)
                    left -= len(block)
        yield pd.DataFrame({"size": frame["size"]})


def commit_tables(tables: dict[str, DataFrame], path: str) -> int:
    """Write a new state of one or more tables and make it the current one, all at once; returns the commit's number.

    Each version is a folder of its own, written by Spark before anything changes, so a table may be computed from the state it
    replaces. Then one rename puts the commit in its place in the row; a failure before that leaves the old state as it
    was, and of two writers at once the second fails.
    """
    spark = next(iter(tables.values())).sparkSession
    before = commit_numbers(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    return commit(spark, path, version, before[-1] if before else 0)


def current_table(spark: SparkSession, path: str, name: str, number: int | None = None) -> DataFrame:
    """A table as of a commit of ``commit_tables``, by default the last; an older one stays as it was while new ones land."""
    return spark.read.parquet(f"{path}/{committed(spark, path, number)}/{name}")


def forget_tables(spark: SparkSession, path: str, keep: int = 1, minutes: float = 60) -> list[str]:
    """Delete all but the last ``keep`` commits with their versions, and what failed writers left; versions younger than so many minutes stay, as their writer may be about to commit."""
    return forget(spark, path, keep, lambda text: {text}, minutes=minutes)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Large results: Spark's own distributed writers, to a path that ``df`` is not read from."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(kind).save(path)
