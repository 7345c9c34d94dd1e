"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted once into cells (one per combination of categories); the cells' token weights are raked to the target
share of each category of each dimension in turn until all margins fit. A document then occurs ``weight`` times in the mix
on average: its whole part for certain, once more with the probability of its fraction. So the expected tokens of every
category stand in the target proportions and those of the mix equal the input's, however rare the rarest cell is. Everything
after the count works on the cells alone.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lotlens.llm.common import discard, empty_if_null, materialise

#: Cells up to which their table is broadcast to the documents (a few MB); beyond, it is joined by a shuffle.
BROADCAST_CELLS = 50_000
NONE = "\0none"


def surface_topic(text: str | Column) -> Column:
    """A coarse topic from the whole text's surface: figures, lists, markup, short notes or prose."""
    t = empty_if_null(text)
    n = F.length(t) + 1
    share = lambda chars: (n - 1 - F.length(F.translate(t, chars, ""))) / n
    return (
        F.when(share("0123456789") > 0.04, "figures").when(share("{}<>=;|#%&*$") > 0.03, "markup")
        .when(share("\n") > 0.015, "lists").when(n < 400, "notes").otherwise("prose")
    )


def approximate_tokens(text: str | Column) -> Column:
    """Four bytes a token, at least one a document."""
    return F.greatest(F.ceil(F.octet_length(empty_if_null(text)) / 4), F.lit(1)).cast("long")


def _key(dim: str) -> Column:
    return F.coalesce(F.col(dim).cast("string"), F.lit(NONE))


def smoothed_targets(cells: DataFrame, dims: list[str], power: float) -> dict[str, DataFrame]:
    """Target shares proportional to each category's tokens to a power: 1 keeps the mix, 0 evens it out."""
    return {d: cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), power).alias("target")) for d in dims}


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-6, stall: float = 0.98, rounds: int = 4) -> DataFrame:
    """``cells`` (the dimensions, tokens) with a weight whose weighted tokens match every target share.

    targets: dimension -> (dimension, target), in any unit. A category without a target gets none of the mix; targets of
    categories that don't occur are left out. Total weighted tokens equal total tokens. Raking goes on until no factor of a
    round differs from 1 by more than ``tolerance``. Where a job's rounds leave more than ``stall`` of the gap that was there
    before, the targets contradict each other (or almost): the last weights then stand, with a warning that names the gap.

    A round rescales the cells by one window sum a dimension, and a job takes ``rounds`` of them in one plan, always the same,
    and observes its last round's factors as it writes. A window holds the cells of one category, not its documents.
    """
    dims = list(targets)
    now = cells.withColumn("weight", F.lit(1.0))
    for d, t in targets.items():
        t = t.select(_key(d).alias(d), F.col("target").cast("double")).groupBy(d).agg(F.sum("target").alias(f"__goal_{d}"))
        now = now.join(t, d, "left").withColumn(f"__goal_{d}", F.coalesce(f"__goal_{d}", F.lit(0.0)))
    now = materialise(now, "rake")
    # A target's share is taken among the categories that occur: each once, however many cells it has.
    sums = {d: now.groupBy(d).agg(F.first(f"__goal_{d}").alias("goal")).agg(F.sum("goal").alias(f"__sum_{d}")) for d in dims}
    whole = now.agg(F.sum("tokens").alias("__whole"))
    for d in dims:
        whole = whole.crossJoin(sums[d])  # one row each
    totals = whole.first()
    share = {d: F.col(f"__goal_{d}") * F.lit((totals["__whole"] or 0) / (totals[f"__sum_{d}"] or 1.0)) for d in dims}
    gap = float("inf")
    while True:
        fitted = now
        for i in range(rounds):
            for d in dims:
                have = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(d))
                factor = F.when(F.col("__have") > 0, share[d] / F.col("__have")).otherwise(0.0)
                fitted = fitted.withColumn("__have", have).withColumn(f"__factor_{d}", factor).withColumn("weight", F.col("weight") * F.col(f"__factor_{d}"))
        seen = Observation()
        gaps = [F.max(F.when(F.col(f"__goal_{d}") > 0, F.abs(F.col(f"__factor_{d}") - 1))) for d in dims]
        old, now = now, materialise(fitted.select(now.columns + [f"__factor_{d}" for d in dims]).observe(seen, F.greatest(*gaps, F.lit(0.0)).alias("gap")).select(now.columns), "rake")
        discard(old)
        before, gap = gap, seen.get["gap"] or 0.0
        if gap <= tolerance:
            break
        if gap > stall * before:
            warnings.warn(f"target shares cannot all be met: a category's share is off by {gap:.2g} of its target", stacklevel=2)
            break
    return now.select(cells.columns + ["weight"])


def mix(df: DataFrame, dims: dict[str, Column], tokens: Column, targets: dict[str, DataFrame] | None = None, power: float = 0.8, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """``df`` with the dimensions' columns, tokens, weight, probability, kept and copies.

    dims: name -> category. targets: shares by dimension; by default each category's tokens to ``power``. copies says how often
    the row occurs in the mix, ``weight`` times on average. kept is a sample in the same proportions that repeats nothing, with
    probability ``weight / largest weight``: the rarest cell sets its size. Both compare a hash of the identifier with their
    probability: the same document always gets the same, repeated rows go together, and what is kept has a copy. Null
    categories are a category; null and empty texts are what ``dims`` and ``tokens`` make of them (one token, in the query);
    whole texts are read once to be counted and once to be weighted; an empty table gives an empty result; columns of ``df``
    named like an output column are replaced.
    """
    names = {d: f"__m_{d}" for d in dims}
    rows = df.withColumns({names[d]: F.coalesce(c.cast("string"), F.lit(NONE)) for d, c in dims.items()} | {"__tokens": tokens.cast("long")})
    cells = materialise(rows.groupBy(*names.values()).agg(F.sum("__tokens").alias("tokens")).withColumnsRenamed({v: k for k, v in names.items()}), "cells")
    weights = rake(cells, targets or smoothed_targets(cells, list(dims), power))
    n, top = weights.agg(F.count(F.lit(1)), F.max("weight")).first()
    top = top or 1.0
    weights = weights.select(*[F.col(d).alias(names[d]) for d in dims], F.col("weight").alias("__weight"))
    joined = rows.join(F.broadcast(weights) if n <= BROADCAST_CELLS else weights, list(names.values()))
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    whole = F.floor("__weight")
    out = ["tokens", "weight", "probability", "kept", "copies"]
    return joined.select(
        *[c for c in df.columns if c not in (*dims, *out)],
        *[F.nullif(F.col(names[d]), F.lit(NONE)).alias(d) for d in dims],
        F.col("__tokens").alias("tokens"), F.col("__weight").alias("weight"), (F.col("__weight") / top).alias("probability"), (draw < F.col("__weight") / top).alias("kept"),
        (whole + (draw < F.col("__weight") - whole).cast("long")).alias("copies"),
    )
