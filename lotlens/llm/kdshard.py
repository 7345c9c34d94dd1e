"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

The tree is split level by level. A node takes the dimension that is widest there (its span against the whole table's) and
is cut at the weighted median of its bytes, or at the share that its shards need, until a leaf holds the target bytes.
The medians of a level are searched together by distributed histograms: each job sums bytes in at most ``BUCKETS`` ranges a
node and picks the one that holds the node's median, and only that is searched on. The driver gets one row a node and step;
rows meet their node's state by a broadcast join with a table of the open nodes, which the number of shards bounds.
Documents are ordered by (dimension, text checksum, identifier): equal texts lie side by side and stay in one shard
unless their group alone outweighs the tolerance, when it is cut by identifier. The checksum is no dimension; it only breaks ties.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotlens.llm.common import discard, empty_if_null, materialise

BUCKETS = 1024
#: Rows of one slot range; a shard is numbered in as many tasks as it has ranges.
SLOT_ROWS = 500_000
MASK = 0xFFFFFFFF
PARTS = 5


@dataclass
class _Node:
    """Search state of one node: the range of the current phase key, after equal values of the earlier ones."""

    name: int
    shards: int
    bytes: int
    dim: int
    tolerance: float
    lo: list[int]
    hi: list[int]
    equal: list[int] = field(default_factory=list)
    before: int = 0
    cut: list[int] | None = None  # left side: key <= cut

    @property
    def goal(self) -> float:
        return self.bytes * (self.shards // 2) / self.shards

    def state(self) -> dict:
        p = len(self.equal)
        width = -(-(self.hi[p] - self.lo[p] + 1) // BUCKETS)
        return {"__node": self.name, "dim": self.dim + 1, "equal": self.equal, "part": p + 1, "lo": self.lo[p], "hi": self.hi[p], "width": width, "before": self.before, "goal": self.goal}

    def step(self, total: int, whole: int, low: list[int], high: list[int]) -> None:
        """Narrow the range to the bucket that holds the goal (bytes before it and with it, least and greatest keys), or settle the cut there."""
        phase = len(self.equal)
        single = low[: phase + 1] == high[: phase + 1]
        # a cut that leaves the bucket on one side
        if min(self.goal - total, whole - self.goal) <= self.tolerance or (single and phase == PARTS - 1):
            self.cut = [*self.equal, high[phase] if whole - self.goal <= self.goal - total else low[phase] - 1]
            return
        self.before, self.lo, self.hi = total, low, high
        while len(self.equal) < PARTS - 1 and low[len(self.equal)] == high[len(self.equal)]:
            self.equal.append(low[len(self.equal)])


STATE = "__node bigint, dim int, equal array<bigint>, part int, lo bigint, hi bigint, width bigint, before bigint, goal double"


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver, to be broadcast."""
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>"))))


def _key(dims: list[str]) -> Column:
    """The order along a node's dimension in five parts of 32 bits at most."""
    v, i = F.element_at(F.array(*dims), F.col("dim")), F.col("__id")
    return F.array(F.shiftright(v, 32), v.bitwiseAND(F.lit(MASK)), F.col("__crc"), F.shiftright(i, 32), i.bitwiseAND(F.lit(MASK)))


def text_metadata(body: Column) -> dict[str, Column]:
    """Dimensions that equal texts share: bytes, lines, words, the thousandths of bytes beyond one a character, and the hundredths of a word's mean length."""
    chars, size = F.length(body).cast("long"), F.octet_length(body).cast("long") + 1
    count = lambda c: chars - F.length(F.replace(body, F.lit(c)))
    words = count(" ") + count("\n") + 1
    return {"bytes": size, "lines": count("\n"), "words": words, "wide": (size - 1 - chars) * 1000 / size, "word_length": chars * 100 / words}


def kd_tree_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None, target_bytes: int | None = None, shards: int | None = None, tolerance: float = 0.002) -> DataFrame:
    """(id, size long, text_crc32 long, shard int, slot long), one row per row of ``df``.

    size: UTF-8 bytes of the whole text plus 1; a null text has none. dims: name -> numeric column; by default ``text_metadata``.
    shards: number of leaves, or as many as ``target_bytes`` asks for. tolerance: how far, in leaves, a cut may lie from its
    goal to leave equal texts together. slot counts from 0 without gaps in each shard. Null identifiers and dimensions order
    as -1 and 0; repeated rows each get a slot; ties in a dimension are ordered by checksum and identifier. Other columns of
    ``df`` are not carried, so no name clashes; an empty table gives an empty result.
    """
    spark = df.sparkSession
    body = empty_if_null(text_col)
    dims = dims or text_metadata(body)
    names = [f"__d{i}" for i in range(len(dims))]
    thin = materialise(
        df.select(F.col(id_col), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("__crc"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("__id"),
                  *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in zip(names, dims.values(), strict=True)], F.lit(1).cast("long").alias("__node")),
        "meta",
    )
    spans = [f(n).alias(f"{o}{n}") for n in names for o, f in (("lo", F.min), ("hi", F.max))]
    whole = thin.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("w"), *spans).first()
    shards = shards or max(1, round(whole["w"] / target_bytes))
    leaf = max(1.0, whole["w"] / shards)

    ends = [f(F.element_at("key", p + 1)).alias(f"{o}{p}") for p in range(PARTS) for o, f in (("lo", F.min), ("hi", F.max))]
    so_far = Window.partitionBy("__node").orderBy("bucket")
    open_nodes, leaves = {1: shards}, {}
    while True:
        leaves |= {n: k for n, k in open_nodes.items() if k == 1}
        open_nodes = {n: k for n, k in open_nodes.items() if k > 1}
        if not open_nodes:
            break
        here = _table(spark, [{"__node": n} for n in open_nodes], "__node bigint")
        searched: dict[int, _Node] = {}
        for r in thin.join(here, "__node").groupBy("__node").agg(F.sum("size").alias("w"), *spans).collect():
            n = r["__node"]
            width = [(r["hi" + d] - r["lo" + d]) / max(1, whole["hi" + d] - whole["lo" + d]) for d in names]
            d = width.index(max(width))
            lo, hi = r["lo" + names[d]], r["hi" + names[d]]
            s = searched[n] = _Node(n, open_nodes[n], r["w"], d, tolerance * leaf, [lo >> 32, 0], [hi >> 32, MASK])
            if lo >> 32 == hi >> 32:
                s.equal, s.lo[1], s.hi[1] = [lo >> 32], lo & MASK, hi & MASK
        while active := [s for s in searched.values() if s.cut is None]:
            state = _table(spark, [s.state() for s in active], STATE)
            at = F.element_at("key", F.col("part"))
            buckets = (
                thin.join(state, "__node").withColumn("key", _key(names))
                .where((F.slice("key", F.lit(1), F.col("part") - 1) == F.col("equal")) & at.between(F.col("lo"), F.col("hi")))
                .groupBy("__node", "before", "goal", F.floor((at - F.col("lo")) / F.col("width")).alias("bucket"))
                .agg(F.sum("size").alias("w"), *ends)
            )
            held = buckets.withColumn("with", F.col("before") + F.sum("w").over(so_far)).where((F.col("with") >= F.col("goal")) & (F.col("with") - F.col("w") < F.col("goal")))
            for r in held.collect():
                searched[r["__node"]].step(r["with"] - r["w"], r["with"], [r[f"lo{p}"] for p in range(PARTS)], [r[f"hi{p}"] for p in range(PARTS)])
        cuts = _table(spark, [{"__node": n, "dim": s.dim + 1, "cut": s.cut} for n, s in searched.items()], "__node bigint, dim int, cut array<bigint>")
        left = F.slice(_key(names), F.lit(1), F.size("cut")) <= F.col("cut")
        moved = thin.join(cuts, "__node", "left").withColumn("__node", F.when(F.col("cut").isNull(), F.col("__node")).when(left, F.col("__node") * 2).otherwise(F.col("__node") * 2 + 1))
        old, thin = thin, materialise(moved.select(thin.columns), "tree")
        discard(old)
        open_nodes = {c: m for n, m in open_nodes.items() for c, m in ((2 * n, m // 2), (2 * n + 1, m - m // 2))}

    number = [{"__node": n, "shard": i} for i, n in enumerate(sorted(leaves, key=lambda n: bin(n)[3:]))]
    ranges = max(16, -(-whole["rows"] // (SLOT_ROWS * shards)))
    placed = thin.join(_table(spark, number, "__node bigint, shard int"), "__node").withColumn("__range", F.pmod(F.xxhash64("__id", "__crc"), F.lit(ranges)).cast("int"))
    counts = placed.groupBy("shard", "__range").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "__range", (F.sum("n").over(Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "__range").orderBy("__id", "__crc"))
    return (
        placed.withColumn("__n", within).join(starts, ["shard", "__range"])
        .select(id_col, "size", F.col("__crc").alias("text_crc32"), "shard", (F.col("start") + F.col("__n") - 1).cast("long").alias("slot"))
    )
