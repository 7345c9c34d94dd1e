"""Exact deduplication by a tree merge of sorted digest runs.

Every row belongs to one of ``fan_in ** levels`` runs, chosen by a hash of its identifier. A run holds its distinct digests,
each with the identifier that stays and its count; it is cut into segments by the digests' first bits, so that no task
holds a run. Then the runs exchange in binomial rounds: in round r, those whose r-th digit (base ``fan_in``) isn't 0 send all
they have to the run where it is 0. Each receiver gets its streams in digest order (Spark's sort merges them, spilling where it
must) and folds equal neighbours as they pass, retaining the identifier that stays; memory holds a batch.

Verification: a digest (SHA-256) counts as equal only together with the text's byte length and a second, independent hash (XXH64).
The decision travels back down: the last round's winners reach the runs, and the runs' rows join on (run, digest), so that
a text held by a third of all rows is spread over all runs in both directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.llm.common import empty_if_null, materialise, ship

OUT = ("keep_id", "group_size", "kept", "text_sha256")
KEY = ["__digest", "__bytes", "__check"]


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of neighbours with equal run and digest, in batches of sorted rows, the first, with the sum of their counts."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for c in ("__run", *KEY):
            col = t.column(c)
            new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy()
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(t.column("__n").to_numpy(), starts)
        t = t.take(pa.array(starts))
        t = t.set_column(t.schema.get_field_index("__n"), "__n", pa.array(sums, pa.int64()))
        held = t.slice(t.num_rows - 1)  # it may go on in the next batch
        yield from t.slice(0, t.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def merge_runs(runs: DataFrame, fan_in: int, levels: int, keep: str) -> DataFrame:
    """The digests of all runs as one (run 0), by binomial rounds of sorted streams."""
    ship(runs.sparkSession)
    first = F.desc_nulls_last("__best") if keep == "max" else F.asc_nulls_last("__best")
    segment = F.substring("__digest", 1, 2)
    for r in range(levels):
        receiver = F.col("__run") - F.pmod(F.col("__run"), F.lit(fan_in ** (r + 1))) if r + 1 < levels else F.lit(0)
        sent = runs.withColumn("__run", receiver.cast("int")).repartition("__run", segment)
        runs = sent.sortWithinPartitions("__run", *KEY, first).mapInArrow(fold, runs.schema)
    return runs


def tree_exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 4, levels: int = 4) -> DataFrame:
    """``df`` with keep_id, group_size (long), kept (boolean) and text_sha256 (lowercase hex).

    keep: ``max`` or ``min`` identifier of equal texts stays. Null texts count as empty ones. Rows that repeat the staying
    identifier and text are kept once. A null identifier stays only where its whole group has none. Whole texts of any length
    are hashed. Columns of ``df`` named like an output column are replaced; an empty table gives an empty result.
    """
    best = {"max": F.max, "min": F.min}[keep]
    rows = df.drop(*[c for c in OUT if c != id_col and c != text_col]).withColumns({
        "__digest": F.unhex(F.sha2(empty_if_null(text_col), 256)),
        "__bytes": F.octet_length(empty_if_null(text_col)),
        "__check": F.xxhash64(empty_if_null(text_col)),
        "__run": F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(fan_in**levels)).cast("int"),
    })
    runs = materialise(rows.groupBy("__run", *KEY).agg(best(id_col).alias("__best"), F.count(F.lit(1)).alias("__n")), "runs")
    repeated = merge_runs(runs, fan_in, levels, keep).where("__n > 1").select(*KEY, F.col("__best").alias("__keep"), F.col("__n").alias("__size"))
    told = runs.select("__run", *KEY).join(repeated, KEY).select("__run", *KEY, "__keep", "__size")
    simple = [c for c, t in df.dtypes if c not in (id_col, text_col, *OUT) and not t.startswith(("map", "variant"))]
    first = F.row_number().over(Window.partitionBy("__run", *KEY, id_col).orderBy(F.col(id_col), *simple))
    return (
        rows.join(told, ["__run", *KEY], "left")
        .withColumns({"__size": F.coalesce("__size", F.lit(1).cast("long")), "__keep": F.when(F.col("__size").isNull(), F.col(id_col)).otherwise(F.col("__keep"))})
        .withColumn("__first", first)
        .select(
            *[c for c in df.columns if c not in OUT],
            F.col("__keep").alias("keep_id"),
            F.col("__size").alias("group_size"),
            (F.col(id_col).eqNullSafe(F.col("__keep")) & (F.col("__first") == 1)).alias("kept"),
            F.lower(F.hex("__digest")).alias("text_sha256"),
        )
    )
