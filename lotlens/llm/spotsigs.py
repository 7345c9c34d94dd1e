"""SpotSigs: signatures that start at common words.

A signature is a common word (the anchor) with the chain of content words that follow it; common words inside the chain
are passed over. Boilerplate such as menus and link lists has few common words and so few signatures. The fingerprint of
a text is its set of signatures. Sets are partitioned by their length, as one that is too short or too long cannot match, and
within it meet by their rarest signatures; those that meet are compared by Jaccard similarity, which their lengths prune again.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import empty_if_null, in_blocks, materialise, ship, whole_runs
from lotlens.llm.components import merged

#: Common words of four languages; anchors of signatures.
ANCHORS = frozenset(
    """the of and to in a is that it for on are as with they be at this have from or had by but not what all were we when
    der die das und ist in zu den von mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach
    le la les de des et est un une du en que qui dans pour pas sur plus par au ce il sont avec ne se
    el los las del y que es un una por con no para su al lo como más o pero sus este ya""".split()
)
CHAIN = 3
#: Below this many signatures, every word is an anchor, and content words count by themselves; above, fewer and fewer of these
#: do, half as many for each ``FADE`` more signatures, so that near copies on either side stay alike.
FEW = 12
FADE = 24
WORD = re.compile(r"\w+")
#: Buckets in which signatures are counted, to put frequent ones last.
COUNTED = 1 << 14


class Signer:
    """Signatures of texts; word hashes are remembered within a task."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hash of each word, and whether it is an anchor (its lowest bit)."""
        if len(self.seen) > 250_000:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w, 11) & ~1 | (w in ANCHORS)
        h = np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
        return h, (h & np.uint64(1)).astype(bool)

    def signatures(self, text: str | None) -> np.ndarray:
        """Sorted distinct uint32 signatures of the whole text.

        A text with fewer than ``FEW`` anchored chains also gets the chains after every word and its content words; with more
        chains, those whose own hash is under a bound that falls with each chain, so that one chain more or less changes few.
        A text that has none of these gets the hash of its words, and one without words the hash of its text: equal texts
        always have equal, non-empty fingerprints.
        """
        words = WORD.findall((text or "").lower())
        if words:
            h, anchor = self.hashes(words)
            content = np.flatnonzero(~anchor)
            sigs = self.chains(h, np.flatnonzero(anchor), content)
            bound = np.uint32(0xFFFFFFFF * 0.5 ** (max(len(sigs) - FEW + 1, 0) / FADE))
            if bound:
                every = np.arange(len(h))
                more = np.concatenate([self.chains(h, every, every), (h[content] >> np.uint64(32)).astype(np.uint32)])
                sigs = np.unique(np.concatenate([sigs, more[more * np.uint32(0x9E3779B1) <= bound]]))
            if len(sigs):
                return sigs
        return np.array([xxhash.xxh32_intdigest(" ".join(words) if words else text or "", 5)], dtype=np.uint32)

    @staticmethod
    def chains(h: np.ndarray, starts: np.ndarray, content: np.ndarray) -> np.ndarray:
        after = np.searchsorted(content, starts, "right")
        whole = after + CHAIN <= len(content)
        starts, after = starts[whole], after[whole]
        s = h[starts]
        for i in range(CHAIN):
            s = (s ^ (s >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[content[after + i]]
        s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((s >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 where their sizes alone keep it below ``at_least``."""
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def as_text(signatures: np.ndarray) -> str:
    """Eight hex digits a signature, ascending."""
    return signatures.astype(">u4").tobytes().hex()


def edited(text: str, follower: str) -> str:
    """The last third of the code points replaced by as many from the follower's start, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + follower[:n]


def id_cuts(rows: DataFrame, order: str) -> np.ndarray:
    """Values of ``order`` that cut the rows into parts of about equal size, the last one its maximum; twice as many as shuffle partitions."""
    n = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 50 * n), F.max(order)).first()
    return np.array(sorted({*(got[0] or []), got[1] or 0}), dtype=np.int64)


def spot_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", components: DataFrame | None = None) -> DataFrame:
    """Each text's fingerprint, that of its edited text, their likeness and that of the next text, and the texts it matches.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id), one row per row of
    ``df``. The next text is that of the next smaller identifier (after the smallest comes the largest; repeated identifiers
    follow each other by a hash of their texts; null identifiers come last). component_id: from ``components``, as
    ``spotsigs_components`` gives them, else the row's own identifier; without them the column is left out. Null texts count as empty, and texts without words have a fingerprint too; texts may be of any
    length; other columns are not carried, so no name clashes; a lone row is its own next; an empty table gives an empty result.

    Texts are packed and dealt once by identifier range, and compared as a stream within each part, so memory holds one batch.
    A part's first identifier is one of the cuts, so its row knows that it is also the end of the part before; components come in the same stream.
    """
    spark = df.sparkSession
    ship(spark)
    order = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), order(F.col(id_col)).alias("o"), empty_if_null(text_col).alias("t"))
    cuts = id_cuts(rows, "o")
    packed = "part int, kind int, o long, tie long, id long, z binary, root long"
    sent = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("o", pa.int64()), ("tie", pa.int64()), ("id", pa.int64()), ("z", pa.binary()), ("root", pa.int64())])

    def part_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        o = batch.column("o").to_numpy()
        return o, np.searchsorted(cuts, o).astype(np.int32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            o, part = part_of(b)
            z, tie = [], []
            for t in b.column("t"):
                t = t.as_py().encode()
                z.append(squeeze(t))
                tie.append(xxhash.xxh64_intdigest(t) - (1 << 63))
            own = pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.ones(len(o), np.int32)), b.column("o"), pa.array(tie, pa.int64()), b.column("id"), pa.array(z, pa.binary()), pa.nulls(len(o), pa.int64())], schema=sent)
            yield own
            ends = np.flatnonzero(cuts[part] == o)
            if len(ends):
                guests = own.take(pa.array(ends))
                yield guests.set_column(0, "part", pa.array((part[ends] + 1) % len(cuts), pa.int32())).set_column(1, "kind", pa.array(np.full(len(ends), 2, np.int32)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, part = part_of(b)
            none = np.zeros(len(o), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(none.astype(np.int32)), b.column("o"), pa.array(none), b.column("o"), pa.nulls(len(o), pa.binary()), b.column("root")], schema=sent)

    both = rows.mapInArrow(pack, packed)
    if components is not None:
        both = both.unionByName(components.select(F.col(id_col).alias("o"), F.col("component_id").alias("root")).mapInArrow(place, packed))
    # a part: for each identifier, descending, its component and then its rows; the guests last
    dealt = both.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", F.col("kind") == 2, F.desc("o"), "kind", "tie")
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, last, unpack, root = Signer(), None, zstandard.ZstdDecompressor().decompress, (None, None)

        def row(item, follower):
            _, _, i, t, s, component = item
            e = edited(t, follower[3])
            es = s if e == t else signer.signatures(e)
            return i, len(t), hashlib.sha256(e.encode()).hexdigest(), as_text(s), as_text(es), likeness(s, es), likeness(s, follower[4]), component

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b, out = whole.slice(at, 1024), []
                for r in b.to_pylist():
                    if r["kind"] == 0:
                        root = r["o"], r["root"]
                        continue
                    t = unpack(r["z"]).decode()
                    item = (r["part"], r["kind"], r["id"], t, signer.signatures(t), root[1] if r["id"] is not None and root[0] == r["o"] else r["id"])
                    if last is not None and last[0] == item[0] and last[1] == 1:
                        out.append(row(last, item))
                    last = item
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)

    out = dealt.mapInArrow(stream, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long")
    return out if components is not None else out.drop("component_id")


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (part, sig, ..), those whose part and signature an adjacent row shares; holds one row back."""
    held, again = None, False
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
        if not t.num_rows:
            continue
        key = [t.column(c).to_numpy() for c in ("part", "sig")]
        same = np.logical_and.reduce([k[1:] == k[:-1] for k in key])
        keep = np.append(again, same) | np.append(same, False)
        held, again = t.slice(t.num_rows - 1), bool(same[-1]) if len(same) else again
        yield from t.slice(0, t.num_rows - 1).filter(pa.array(keep[:-1])).to_batches()
    if again:
        yield from held.to_batches()


def spotsigs_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, hot: int = 2000) -> DataFrame:
    """(id, component_id) of texts whose signature sets are at least ``similarity`` alike; those without a match are left out.

    Equal sets are one class. Sets are partitioned by length, so that only sets of the same or the next partition can match,
    and meet within it by the first ``size - ceil(similarity * size) + 1`` of their signatures, rare ones before frequent
    ones: two matching sets share one of these. Those that meet are compared shortest first, only with sets that nothing has
    connected yet and whose length allows a match; so a large group of copies gives as many links as it has members. More than
    ``hot`` holders of a signature meet in blocks: at first each by itself, then what is not connected yet with all others.

    How frequent a signature is, all texts tell: they are counted in ``COUNTED`` hash buckets. Null texts are empty; repeated rows
    count once; null identifiers are left out; an empty table gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)

    @F.pandas_udf("binary")
    def signed(texts: pd.Series) -> pd.Series:
        signer = Signer()
        return texts.map(lambda t: signer.signatures(t).tobytes(), na_action=None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTED, np.int64)
        for b in batches:
            total += np.bincount(bucket(np.frombuffer(b"".join(b.column("s").to_pylist()), np.uint32)), minlength=COUNTED)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    own = materialise(df.select(F.col(id_col).cast("long").alias("id"), signed(empty_if_null(text_col)).alias("s")).where("id is not null").withColumn("d", F.unhex(F.md5("s"))), "spotsets")
    same = materialise(own.groupBy("d").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").select("d", "b"), "same")
    copies = own.select("id", "d").join(same, "d").where("id != b").select(F.col("id").alias("a"), "b")
    sets = own.select("id", "s").join(copies.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    often = np.zeros(COUNTED, np.int64)
    for r in own.select("s").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most COUNTED rows
        often[r["bucket"]] = r["n"]
    rarity = spark.sparkContext.broadcast(np.log2(often + 1).astype(np.int64))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = rarity.value
        for b in batches:
            ids, parts, sigs = [], [], []
            for i, s in zip(b.column("id").to_pylist(), b.column("s").to_pylist(), strict=True):
                s = np.frombuffer(s, np.uint32)
                n = len(s)
                first = s[np.lexsort((s * np.uint32(0x9E3779B1), rare[bucket(s)]))][: n - math.ceil(similarity * n - 1e-9) + 1]
                part = length_part(n, similarity)
                for p in (part, part + 1):
                    ids.append(np.full(len(first), i, np.int64))
                    parts.append(np.full(len(first), p, np.int32))
                    sigs.append(first.astype(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (parts, sigs, ids)], names=["part", "sig", "id"])

    group, key = ["part", "sig"], ["part", "sig", "deal"]
    held = sets.mapInArrow(prefixes, "part int, sig long, id long").repartition(*group).sortWithinPartitions(*group).mapInArrow(repeated, "part int, sig long, id long")
    held = materialise(held, "held")
    held = held.join(held.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), group)

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_runs(frames, key):
            out = []
            for (part, *_), one in frame.groupby(key, sort=False):
                out += links_of([(np.frombuffer(s, np.uint32), i, r) for s, i, r in zip(one["s"], one["id"], one["root"], strict=True)], similarity, int(part))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    labels = None
    for first in (True, False):
        if not first and held.where(F.col("n") > hot).isEmpty():
            break
        rooted = held.withColumn("root", F.col("id")) if first else held.where(F.col("n") > hot).join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        met = in_blocks(rooted, group, hot, first).select(*key, "id", "root").join(sets, "id")
        alike = met.repartition(*key).sortWithinPartitions(*key).mapInPandas(link, "a long, b long").distinct()
        labels = merged(labels, alike.unionByName(copies) if first else alike)
    return labels.select(F.col("node").alias(id_col), F.col("root").alias("component_id"))


def bucket(signatures: np.ndarray) -> np.ndarray:
    return ((signatures * np.uint32(0x85EBCA6B)) >> np.uint32(32 - COUNTED.bit_length() + 1)).astype(np.int64)


def length_part(n: int, similarity: float) -> int:
    """The partition of a set's length: matching sets are at most one apart."""
    return math.floor(math.log(n) / -math.log(similarity) + 1e-9)


def links_of(members: list[tuple[np.ndarray, int, int]], similarity: float, part: int) -> list[tuple[int, int]]:
    """Links (id, id) that connect all matching sets (set, id, root) of one length partition and the one below it.

    Members with one root are connected already. Two sets of the partition below are left to their own.
    """
    members = sorted(members, key=lambda x: (len(x[0]), x[1]))
    below = [length_part(len(s), similarity) < part for s, *_ in members]
    classes: list[tuple[list[int], set[int]]] = []  # members, by length, and their roots
    out = []
    for i, (s, mine, root) in enumerate(members):
        hits = []
        for c in classes:
            if root in c[1]:
                hits.append(c)
                continue
            for j in reversed(c[0]):  # the longest first; once one is too short, all are
                other = members[j][0]
                if len(other) < similarity * len(s) - 1e-9:
                    break
                if not (below[i] and below[j]) and likeness(other, s, similarity) >= similarity - 1e-12:
                    hits.append(c)
                    out.append((mine, members[j][1]))
                    break
        rest = [c for c in classes if not any(c is h for h in hits)]
        classes = [*rest, (sorted([x for h in hits for x in h[0]] + [i]), {root}.union(*[h[1] for h in hits]))]
    return out
