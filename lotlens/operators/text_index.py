"""Substring search at scale: a posting table from three-letter grams to row blocks, and one automaton for many keywords."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.functions.predicates import contains_text
from lotlens.sources.shared import ship

GRAM = 3
BLOCKS = 256
#: Keywords that one automaton holds; more of them take one pass over the texts for so many.
KEYWORDS = 200_000
#: Letters whose grams a task sorts at once.
LETTERS = 1 << 20
POSTING = "__block int, col string, gram string"


def distinct_grams(texts: list[str]) -> list[str]:
    """The grams of some texts, each once: a gram is one number, and those over the seam of two texts are left out."""
    texts = [t for t in texts if len(t) >= GRAM]
    if not texts:
        return []
    x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    seams = np.cumsum([len(t) for t in texts])[:-1]
    codes = np.unique(np.delete(x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:], np.concatenate([seams - 1, seams - 2])))
    letters = np.stack([codes >> np.uint64(42), codes >> np.uint64(21) & np.uint64(0x1FFFFF), codes & np.uint64(0x1FFFFF)], axis=1).astype(np.uint32)
    flat = letters.tobytes().decode("utf-32-le")
    return [flat[i : i + GRAM] for i in range(0, len(flat), GRAM)]


def _pieces(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in lists of about ``LETTERS`` letters; longer texts come in pieces that share the letters of the grams over their seam."""
    some, held = [], 0
    for t in texts:
        t = t.as_py() or ""
        for i in range(0, len(t), LETTERS):
            some.append(t[i : i + LETTERS + GRAM - 1])
            held += len(some[-1])
            if held >= LETTERS:
                yield some
                some, held = [], 0
    yield some


def _postings(columns: list[str]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column("__block").to_numpy()
            for n in np.unique(block):
                mine = b.filter(pa.array(block == n))
                for c in columns:
                    for texts in _pieces(mine.column(c)):
                        grams = distinct_grams(texts)
                        yield pa.RecordBatch.from_arrays([pa.array([n] * len(grams), pa.int32()), pa.array([c] * len(grams), pa.string()), pa.array(grams, pa.string())], names=["__block", "col", "gram"])

    return found


def write_text_index(df: DataFrame, columns: list[str], path: str, key: str, blocks: int = BLOCKS) -> None:
    """Write ``df`` in blocks of rows (by a hash of ``key``), and which lower-cased grams of the columns each block has.

    A gram has at most one posting a column and block, however common it is; postings are sorted by gram, so that a
    search opens the files of its grams only. Null texts have no grams. Work grows with the letters, however they are dealt to texts.
    """
    df.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).repartition("__block").write.partitionBy("__block").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    ship(df.sparkSession)
    low = rows.select("__block", *[F.lower(c).alias(c) for c in columns])
    low.mapInArrow(_postings(columns), POSTING).distinct().repartitionByRange("gram", "col").sortWithinPartitions("gram", "col", "__block").write.parquet(f"{path}/grams")


def pattern_grams(spark: SparkSession, text: str) -> list[str]:
    """The grams that a row matching ``%text%`` must have: those of the stretches between its wildcards."""
    low = spark.range(1).select(F.lower(F.lit(text))).first()[0]
    return sorted({p[i : i + GRAM] for p in re.split("[%_]", low) for i in range(len(p) - GRAM + 1)})


def candidate_blocks(spark: SparkSession, path: str, columns: list[str], text: str) -> list[int] | None:
    """Blocks in which one of the columns has all grams of the pattern; None if it has no gram, so that any block may match."""
    grams = pattern_grams(spark, text)
    if not grams:
        return None
    held = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(*grams) & F.col("col").isin(*columns))
    full = held.groupBy("col", "__block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return sorted(r[0] for r in full.select("__block").distinct().collect())  # at most as many numbers as there are blocks


def _holds(column: str, text: str) -> Column:
    """The predicate's test of one column. The stretches between ``%`` are looked for one after another, each where it comes first
    and never again, as trying all places of one for the next is quadratic in a text that lacks the last.
    """
    if not re.search("[%_]", text):
        return contains_text(column, text)
    low = F.replace(F.replace(F.lower(F.lit(text)), F.lit("%"), F.lit("\\E)(?>.*?\\Q")), F.lit("_"), F.lit("\\E.\\Q"))  # lower-cased, it has no \E of its own
    return F.rlike(F.lower(column), F.concat(F.lit("(?s)\\A(?>.*?\\Q"), low, F.lit("\\E)")))


def search_text(spark: SparkSession, path: str, columns: list[str], text: str) -> DataFrame:
    """The rows of the index in which one of the columns contains ``text``, letter case aside, ``%`` and ``_`` in it being wildcards.

    The same rows as the predicate gives over all of them (an empty text sets no condition): it is checked on the rows of the blocks that
    have all its grams. Patterns without three letters in a row between wildcards read all blocks.
    """
    rows = spark.read.parquet(f"{path}/rows")
    if not text:
        return rows.drop("__block")
    blocks = candidate_blocks(spark, path, columns, text)
    if blocks is not None:
        rows = rows.where(F.col("__block").isin(*blocks) if blocks else F.lit(False))
    return rows.where(reduce(or_, [_holds(c, text) for c in columns])).drop("__block")


def keyword_hits(df: DataFrame, text_col: str, keywords: DataFrame, out_col: str = "hits", limit: int = KEYWORDS) -> DataFrame:
    """``df`` with ``out_col``: which of the keywords (a column ``keyword``, taken as they are) the lower-cased text contains, each once, sorted.

    One automaton finds all of them in a single walk over the text, whatever their number; over ``limit`` keywords, they are dealt into
    parts with a walk for each, so that driver and tasks hold one part at a time. Null and empty keywords are none; a null text
    has no hits; a column of that name is replaced.
    """
    ship(df.sparkSession)
    words = keywords.select("keyword").where("keyword <> ''").distinct()
    parts = max(1, -(-words.count() // limit))
    low, out = "__low", df.withColumns({out_col: F.array().cast("array<string>"), "__low": F.lower(text_col)})
    names = [f.name for f in out.schema.fields]
    for part in range(parts):
        mine = [r[0] for r in words.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == part).collect()]

        def found(batches: Iterator[pa.RecordBatch], mine=mine) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for w in mine:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    s = b.slice(i, 1024)
                    hits = [sorted({*before, *(w for _, w in automaton.iter(t or ""))}) for before, t in zip(s.column(out_col).to_pylist(), s.column(low).to_pylist(), strict=True)]
                    columns = [pa.array(hits, pa.list_(pa.string())) if n == out_col else s.column(n) for n in names]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        if mine:
            out = out.mapInArrow(found, T.StructType([T.StructField(out_col, T.ArrayType(T.StringType())) if f.name == out_col else f for f in out.schema.fields]))
    return out.drop(low)
