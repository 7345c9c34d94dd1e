"""SimHash near-duplicate detection over a Gray-order hierarchical index.

Two entry points share the index of ``gray``:

* ``simhash_components``: 64-bit fingerprints linked at a Hamming distance of at most 2, exactly. Distinct fingerprints are
  dealt by three bit blocks, one of which two linked fingerprints must share; each deal is sorted by Gray rank and searched.
  A block value that too many fingerprints have is dealt again by three blocks of the bits it leaves, one of which any two
  linked fingerprints must share as well, and so on; a deal has fewer possible members each time.
* ``near_duplicates``: five-word shingles, Jaccard similarity of 0.8 or more. At that similarity 64 SimHash bits differ by
  about 10, for which bit blocks no longer divide a corpus, so documents are dealt by min-hash bands of the shingles; within a band the
  same index searches 256-bit SimHash fingerprints, and the surviving links (a shortest spanning forest per band) are
  checked against the whole texts. What a few bands connect, the others needn't search again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.llm.common import discard, empty_if_null, in_blocks, materialise, ship, whole_runs
from lotlens.llm.components import connected_components, merged
from lotlens.llm.gray import GrayIndex, gray_rank

SEED = 42
BANDS, ROWS = 21, 6
#: Bands that are searched first.
FIRST = 3
WORDS = 4
#: Differing bits, of 256, up to which a pair is compared: at a similarity of 0.8 long texts differ in 39, give or take 6;
#: the bits of texts of few shingles scatter more.
RADIUS, MORE = 56, 128
_STEP = 1 << 16


def shingle_hashes(text: str | None, k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every k-word shingle (repeats included) of the text with A-Z lowered; words are split at ASCII white space.

    Fewer than k words: the whole sequence; no words or null: an empty array.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - k + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    h = xxhash.xxh64_intdigest
    last = ends[-1:] if len(words) < k else ends[k - 1 :]
    return np.fromiter((h(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=n)


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; no hashes: zero."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _STEP):
        part = np.ascontiguousarray(hashes[i : i + _STEP])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def simhash_fingerprints(df: DataFrame, text_col: str = "text", k: int = 3) -> F.Column:
    """The text's SimHash as a signed long column.

    Whole texts of any length count, one shingle of each at a time in memory besides 8 bytes a shingle; null and empty texts and
    those without words give zero. It is a function of the text alone: repeated rows agree, and no other column plays a part.
    """
    ship(df.sparkSession)

    @F.pandas_udf(T.LongType())
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((simhash(shingle_hashes(t, k)) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64))

    return fingerprint(F.col(text_col))


def _linker(radius: int | str, key: list[str], code_cols: list[str], id_col: str, similarity: float | None = None):
    """mapInPandas function: rows sorted by ``key`` in, links (key, a, b) between ``id_col`` values out.

    radius: a number or a column. Rows with equal ``root`` (a column that may be there) are connected already. A row that is
    ``told`` (a column that may be there) says that the pair (id, ``other``) is no link. With a similarity, the Jaccard similarity
    of the rows' ``hashes`` (sorted uint64, as bytes) decides, so that no further pair has to be told.
    """

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(search, whole_runs(frames, key))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        told = frame[frame["told"]] if "told" in frame else frame.iloc[:0]
        frame = frame[~frame["told"]] if "told" in frame else frame
        keys = frame[key].to_numpy()
        run = np.cumsum(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) - 1 if len(frame) else np.zeros(0, np.int64)
        label = np.unique(frame["root"] if "root" in frame else np.arange(len(frame)), return_inverse=True)[1]
        # runs whose members are all connected have no links to give
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(frame) else run
        idle = (np.maximum.reduceat(label, first) == np.minimum.reduceat(label, first))[run] if len(frame) else run == 0
        if idle.all():
            return pd.DataFrame({**{k: np.zeros(0, np.int64) for k in key}, "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        run, label, frame = run[~idle], label[~idle], frame[~idle]
        codes = np.ascontiguousarray(frame[code_cols].to_numpy(dtype=np.int64)).view(np.uint64)
        order = np.lexsort((gray_rank(codes), run))
        codes, run, label, frame = codes[order], run[order], label[order], frame.iloc[order]
        ids = frame[id_col].to_numpy()
        starts = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(run))
        barred = None
        if len(told):
            at = frame[[*key, id_col]].assign(pos=np.arange(len(frame)))
            both = told[[*key, id_col, "other"]].merge(at, on=[*key, id_col]).merge(at.rename(columns={id_col: "other", "pos": "pos2"}), on=[*key, "other"])
            barred = np.sort(both[["pos", "pos2"]].to_numpy(dtype=np.int64), axis=1)[:, ::-1]
        reach = frame[radius].to_numpy() if isinstance(radius, str) else radius
        holds = None
        if similarity is not None:
            sets = [np.frombuffer(h, np.uint64) for h in frame["hashes"]]
            holds = lambda a, b: alike_sets(sets, a, b, similarity)
        e = GrayIndex(codes, starts).tree_edges(reach, label=label, barred=barred, holds=holds)
        return pd.DataFrame({**{k: frame[k].to_numpy()[e[:, 0]] for k in key}, "a": ids[e[:, 0]], "b": ids[e[:, 1]]})

    return links


def alike_sets(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of positions have sets of at least that Jaccard similarity; each set of ``a`` is looked up once for all its partners."""
    out = np.zeros(len(a), dtype=bool)
    order = np.argsort(a, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(a[order]) != 0)), len(a))
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = order[start:end]
        mine, others = sets[a[at[0]]], [sets[x] for x in b[at].tolist()]
        sizes = np.array([len(x) for x in others])
        whole = np.concatenate(others)
        hit = mine[np.minimum(np.searchsorted(mine, whole), len(mine) - 1)] == whole if len(mine) else np.zeros(len(whole), bool)
        ends = np.cumsum(sizes)
        found = np.append(0, np.cumsum(hit))
        common = found[ends] - found[ends - sizes]
        both = len(mine) + sizes - common
        out[at] = np.where(both == 0, True, common >= similarity * both - 1e-9)
    return out


def thirds(mask: int) -> list[int]:
    """Three masks that each add a third of the bits that ``mask`` leaves; codes alike under it and 2 bits apart agree under one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in part) for part in (free[: -(-len(free) // 3)], free[-(-len(free) // 3) : -(-len(free) * 2 // 3)], free[-(-len(free) * 2 // 3) :])]


def hamming_edges(fps: DataFrame, fp: str = "fp", radius: int = 2, hot: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct 64-bit fingerprints that keep every fingerprint within ``radius`` (2) connected.

    Block values of more than ``hot`` fingerprints are dealt again by the bits they leave, at most until ``hot`` codes differ
    in these. Null fingerprints have no edges.
    """
    ship(fps.sparkSession)
    if radius != 2:
        raise ValueError("three blocks are exact for a radius of 2")
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    key, masks, found = ["mask", "value"], thirds(0), None
    rows = fps.select(F.col(fp).alias("fp"), F.explode(F.array(*map(signed, masks))).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    while True:
        crowded = materialise(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(*key, F.lit(True).alias("crowded")), "crowded")
        last = all(64 - m.bit_count() <= max(2, hot.bit_length() - 1) for m in masks) or crowded.isEmpty()
        rows = rows if last else rows.join(crowded, key, "left")
        usual = (rows if last else rows.where("crowded is null")).select(*key, "fp").repartition(*key).sortWithinPartitions(*key)
        got = usual.mapInPandas(_linker(radius, key, ["fp"], "fp"), "mask long, value long, a long, b long").select("a", "b")
        found = got if found is None else found.unionByName(got)
        if last:
            return found
        finer = F.create_map(*[x for m in masks for x in (signed(m), F.array(*map(signed, thirds(m))))])
        masks = list(dict.fromkeys(t for m in masks for t in thirds(m)))
        rows = materialise(rows.where("crowded").select("fp", F.explode(F.element_at(finer, F.col("mask"))).alias("mask")).distinct().withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "crowded")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2, hot: int = 4096) -> DataFrame:
    """(id, fp long, component_id long), one row per row of ``df``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest identifier reachable. Texts without
    words (null ones too) have fingerprint zero and link like any other; repeated rows stay; null identifiers are ignored for
    component_id, which is null where a component has no other. An empty table gives an empty result.
    """
    thin = materialise(df.select(F.col(id_col).alias(id_col), simhash_fingerprints(df, text_col, k).alias("fp")), "fp")
    fps = thin.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected_components(hamming_edges(fps, radius=radius, hot=hot))
    rooted = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return thin.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


# --- Jaccard near-duplicates ---

_rng = np.random.default_rng(2024)
_MUL = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_SALT = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    h = h * salt
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sketch(text: str | None, k: int = 5) -> tuple[list[int], int, np.ndarray]:
    """256 SimHash bits (four signed words) of the set of shingles, its search radius, and its min-hash band keys (signed)."""
    h = np.unique(shingle_hashes(text, k))
    words = [simhash(_mix(h, s)) for s in _SALT]
    low = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(h), 512):
        low = np.minimum(low, ((h[i : i + 512, None] * _MUL) + _ADD).min(axis=0))
    key = np.zeros(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key ^ low.reshape(BANDS, ROWS)[:, r], _SALT[0])
    return [w - (1 << 64) if w >> 63 else w for w in words], RADIUS + MORE // max(len(h), 8), key.view(np.int64)


def jaccard(a: str | None, b: str | None, k: int = 5) -> float:
    """Of the sets of k-word shingles; two texts without words are equal."""
    return set_likeness(np.unique(shingle_hashes(a, k)), np.unique(shingle_hashes(b, k)))


def set_likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) + len(y) else 1.0


def near_duplicate_links(df: DataFrame, id_col: str, text_col: str, k: int = 5, similarity: float = 0.8, hot: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between identifiers that keep near-duplicates connected, and the components (node, root) they give.

    The first bands are searched, each giving a shortest spanning forest of its SimHash links, whose edges are checked on whole
    texts; then the other bands, for links between what is not connected yet. Groups where a check failed are searched again
    without the pairs that failed there, now with the members' shingle hashes at hand, so that the search itself drops links
    that don't hold; this goes on until every link holds. Then no pair that shares a band and is alike is left unconnected, and
    what is written and joined grows with the members, not with their pairs.

    Rows of one identifier count as one document, whose text is the smallest; null texts are empty, null identifiers are left out.
    """
    spark = df.sparkSession
    ship(spark)
    code = [f"w{i}" for i in range(WORDS)]

    def sketches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 2048):
                part = frame.iloc[i : i + 2048]
                got = [sketch(t, k) for t in part["t"]]
                out = pd.DataFrame(np.repeat(np.array([w for w, *_ in got], dtype=np.int64), BANDS, axis=0), columns=code)
                out.insert(0, "value", np.concatenate([b for *_, b in got]))
                out.insert(0, "band", np.tile(np.arange(BANDS, dtype=np.int32), len(part)))
                out["reach"] = np.repeat(np.array([r for _, r, _ in got], dtype=np.int32), BANDS)
                out["id"] = np.repeat(part["id"].to_numpy(), BANDS)
                yield out

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = [np.unique(shingle_hashes(t.as_py(), k)).tobytes() for t in part.column("t")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "hashes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hashes = None, None  # pairs come ordered by b
        for batch in batches:
            alike = []
            for i, b in enumerate(batch.column("b").to_pylist()):
                if b != last:
                    last, hashes = b, np.unique(shingle_hashes(batch.column("tb")[i].as_py(), k))
                alike.append(set_likeness(np.unique(shingle_hashes(batch.column("ta")[i].as_py(), k)), hashes) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(alike, pa.bool_())], names=["a", "b", "alike"])

    texts = df.select(F.col(id_col).cast("long").alias("id"), empty_if_null(text_col).alias("t")).where("id is not null")
    group, key, member = ["band", "value"], ["band", "value", "deal"], [*code, "reach", "id", "root"]
    bands = materialise(texts.mapInPandas(sketches, "band int, value long, " + ", ".join(f"{c} long" for c in code) + ", reach int, id long"), "bands")
    met = materialise(bands.join(bands.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), group).withColumn("root", F.col("id")).select(*group, "n", *member), "met")
    linked = materialise(texts.join(met.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("t").alias("t")), "linked")
    discard(bands)
    # Few bytes, much work: a stated number of tasks, which Spark does not merge by size.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    active, labels, exact, judged, failed = met.where(F.col("band") < FIRST), None, None, [], []
    while True:
        if labels is not None:
            active = active.drop("root").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        rows = in_blocks(active, group, hot, first=labels is None).select(*key, *member, F.lit(False).alias("told"), F.lit(0).cast("long").alias("other"))
        if failed:
            # a pair of a large group is told to all blocks of its first member
            blocks = rows.where("deal >= 0").select(*key, F.col("id").alias("a"))
            no = reduce(DataFrame.unionByName, failed).join(again, group, "left_semi")
            no = no.where("deal < 0").unionByName(no.where("deal >= 0").drop("deal").distinct().join(blocks, [*group, "a"]))
            nothing = [F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in member if c != "id"]
            rows = rows.unionByName(no.select(*key, *nothing, F.col("a").alias("id"), F.lit(True).alias("told"), F.col("b").alias("other")))
        if exact is not None:
            sets = linked.join(active.select("id").distinct(), "id", "left_semi").select("id", "t").mapInArrow(hashed, "id long, hashes binary")
            rows = rows.join(sets, "id", "left").withColumn("hashes", F.when(F.col("told"), F.lit(b"")).otherwise(F.col("hashes")))
        found = rows.repartition(tasks, *key).sortWithinPartitions(*key).mapInPandas(_linker("reach", key, code, "id", exact), "band int, value long, deal long, a long, b long")
        found = materialise(found.select(*key, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), "found")
        if labels is not None and found.isEmpty():
            break
        pairs = found.select("a", "b").distinct()
        if judged:
            pairs = pairs.join(reduce(DataFrame.unionByName, judged), ["a", "b"], "left_anti")
        both = pairs.join(linked.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(linked.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
        judged.append(materialise(both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long, alike boolean"), "judged"))
        # Where a link of a group's forest fails, the group is searched again without it: a longer link may hold what it held.
        bad = reduce(DataFrame.unionByName, judged).where("not alike").select("a", "b")
        failed.append(materialise(found.join(bad, ["a", "b"], "left_semi"), "failed"))
        discard(found)
        first, old = labels is None, labels
        if first or not judged[-1].where("alike").isEmpty():
            labels = merged(labels, judged[-1].where("alike"))
            discard(old)
        if not first and failed[-1].isEmpty():
            break
        # next, the groups that failed; after the first bands also all others, and large groups' links between blocks
        again = failed[-1].select(*group).distinct()
        active = met.join(again.withColumn("again", F.lit(True)), group, "left")
        active = active.where(F.col("again") | (F.lit(first) & ((F.col("band") >= FIRST) | (F.col("n") > hot)))).drop("again")
        exact = None if first else similarity
    for df in [met, linked, found, *failed]:
        discard(df)
    return reduce(DataFrame.unionByName, judged).where("alike").select("a", "b"), labels


def near_duplicate_edges(df: DataFrame, id_col: str, text_col: str, k: int = 5, similarity: float = 0.8, hot: int = 4096) -> DataFrame:
    """The verified links (a, b) of ``near_duplicate_links``."""
    return near_duplicate_links(df, id_col, text_col, k, similarity, hot)[0]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id): the smallest identifier reachable over texts whose k-word shingle sets are at least ``similarity`` alike.

    One row per distinct identifier that has a near-duplicate; all others stand alone. Texts without words (null ones too) are
    alike; repeated identifiers count once, with their smallest text; null identifiers are left out; other columns don't
    count; an empty table gives an empty result.
    """
    roots = near_duplicate_links(df, id_col, text_col, k, similarity)[1]
    return roots.select(F.col("node").alias(id_col), F.col("root").alias("component_id"))
