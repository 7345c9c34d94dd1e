"""Periodic runs: stretches of words that repeat with a period at least three times over.

Block matching: at every scale B (8, 16, 32, ...) the document is cut into aligned blocks of B words, and the blocks are searched
across the document by one automaton whose keys are sequences of numbers: of words at first, then of stretches of 2, 4, ... words,
so that a key is eight numbers long at every scale. A block that occurs again at a distance of the scale (under 16 at the first
one, else from B to under 2 B) is a seed; from it, equal words at that distance are followed in both directions to the last one. A run of period q is at least 3 q (and 24) words long, so that at the scale of q it holds
an aligned block together with its repetition one period later: no run is missed, and a seed's stretch is measured exactly.

Pruning is exact: a block is only searched if each of its windows of eight words occurs twice (by hash, which can only err
towards searching), and a seed inside a known run whose period divides its distance would give that run again. The automaton
holds one section of the document at a time, so that its size doesn't grow with the text's.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.llm.common import ship

LEAST, TIMES = 24, 3
#: The smallest block, and the words whose blocks one automaton holds.
BLOCK, SECTION = 8, 1 << 16
NOTHING = (1 << 32) - 1
#: Rows of one Arrow batch that is given back.
BATCH = 256
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
OUT = ("n_words", "runs", "collapsed")


def _windows(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the BLOCK words from each place on."""
    h = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    factor, width = 0xBF58476D1CE4E5B9, 1
    while width < BLOCK:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    return h


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words of two stretches of one length agree."""
    at, step = 0, 32
    while at < len(a):
        differ = a[at : at + step] != b[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return len(a)


def _seeds(names: np.ndarray, torn: np.ndarray, size: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block's place, distance) of all aligned blocks of ``size`` of n words that occur again at a distance of this scale.

    names: a number for each stretch of size / BLOCK words. A block is the key of BLOCK such numbers, and the document is read
    once for each remainder of places by that stride.
    """
    stride, section = size // BLOCK, max(SECTION, size)
    least, most = (1, 2 * BLOCK - 1) if size == BLOCK else (size, 2 * size - 1)
    for start in range(0, n - size + 1, section):
        places = np.arange(start, min(start + section, n - size + 1), size)
        places = places[torn[places + size - BLOCK + 1] == torn[places]]
        if not len(places):
            continue
        keys: dict[tuple[int, ...], int] = {}
        of = np.full(section // size + 1, -1)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for p, key in zip(places.tolist(), map(tuple, names[places[:, None] + stride * np.arange(BLOCK)].tolist()), strict=True):
            if key not in keys:
                keys[key] = len(keys)
                automaton.add_word(key, keys[key])
            of[(p - start) // size] = keys[key]
        automaton.make_automaton()
        stretch = names[start : start + section + 3 * size]
        lines = -(-len(stretch) // stride) + 1  # and one number that no block has, between two remainders
        read = np.full(lines * stride, NOTHING, np.uint32)
        read[: len(stretch)] = stretch
        found = np.array(list(automaton.iter(tuple(read.reshape(lines, stride).T.ravel().tolist()))), dtype=np.int64).reshape(-1, 2)
        at, which = (found[:, 0] % lines - BLOCK + 1) * stride + found[:, 0] // lines, found[:, 1]
        for back in range(2 if size == BLOCK else 1):
            block = (at - least) // size - back
            distance = at - block * size
            hit = (block >= 0) & (block * size < section) & (distance <= most)
            hit[hit] = of[block[hit]] == which[hit]
            yield start + block[hit] * size, distance[hit]


def periodic_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run among word numbers, by start, then period."""
    n, runs = len(words), []
    if n < LEAST:
        return runs
    hashes = _windows(words)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return runs
    torn = np.append(0, np.cumsum(~np.isin(hashes, twice)))  # windows so far that occur once
    reach, period_at = np.zeros(n, np.int64), np.ones(n, np.int64)  # of the run at a place that goes on longest
    size, names = BLOCK, words
    while size == BLOCK or TIMES * size <= n:
        seeds = list(_seeds(names, torn, size, n))
        if not seeds:
            break
        places, distances = (np.concatenate(x) for x in zip(*seeds, strict=True))
        order = np.lexsort((places, distances))
        places, distances = places[order], distances[order]
        cuts = np.append(np.flatnonzero(np.append(True, distances[1:] != distances[:-1])), len(distances)) if len(distances) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            d, own, end = int(distances[a]), places[a:b], 0
            known = (reach[own] >= own + d + size) & (d % period_at[own] == 0)
            for p in own[~known].tolist():
                if p < end:
                    continue
                left = p - _same(words[:p][::-1], words[d : p + d][::-1])
                end = p + size + _same(words[p + size : n - d], words[p + size + d :])
                length = end - left + d
                if length >= max(LEAST, TIMES * d):
                    runs.append((left, length, d))
                    part = slice(left, left + length)
                    further = reach[part] < left + length
                    reach[part][further], period_at[part][further] = left + length, d
        if TIMES * (size := 2 * size) <= n:
            half = size // BLOCK // 2
            names = np.unique(names[:-half].astype(np.uint64) * np.uint64(n) + names[half:], return_inverse=True)[1].astype(np.uint32)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(text: bytes) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """(number of words, runs, words that are left when each run keeps its first period, joined by a space)."""
    words = text.split()
    n, numbers = len(words), {}
    runs = periodic_runs(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint32, count=len(words)))
    if runs:
        kept = np.ones(n, dtype=bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return n, runs, b" ".join(words)


def collapse_runs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words (long), runs (array of start, length, period; by start, then period) and collapsed (string) in place of the text.

    Words are what ASCII white space parts. A run is a stretch of at least 24 words and of three times its smallest period, as
    long as it goes. Null and empty texts have no words, no runs and an empty collapsed text; texts of any length are read
    whole, one at a time. Repeated rows fare alike, and other columns stay; those named like an output column are
    replaced. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in (text_col, *OUT)]
    schema = T.StructType([*keep, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                b = whole.slice(i, BATCH)
                out = [collapse(t or b"") for t in b.column(text_col).cast(pa.binary()).to_pylist()]
                more = [
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([[dict(zip(RUN.names, r, strict=True)) for r in x[1]] for x in out], run_type),
                    pa.array([x[2] for x in out], pa.binary()).view(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), *more], names=schema.names)

    return df.mapInArrow(rows, schema)


def strongest(runs: str) -> F.Column:
    """The run with the greatest length / period, compared exactly; of equals the first of the list. No runs: null."""
    longer = lambda a, r: r["length"] * a["period"] > a["length"] * r["period"]
    return F.reduce(runs, F.try_element_at(runs, F.lit(1)), lambda a, r: F.when(longer(a, r), r).otherwise(a))
