"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

A task treats the distinct pre-tokens of a batch as one corpus. Their bytes lie in flat arrays with links to the
neighbours, and an inverted index maps each token pair (by the rank of its merge) to the positions where it stands. Merges
are replayed in rank order: a merge visits its own positions only and re-indexes just the two neighbours it touches.
Encoded pre-tokens are remembered, so that a frequent word is merged once a task.
"""

from __future__ import annotations

import base64
import gc
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lotlens.llm.common import ship

#: Pre-tokens that a task remembers before it starts anew.
REMEMBERED = 250_000
#: Pairs whose merge a task remembers before it starts anew.
PAIRS = 250_000
#: Documents that are one corpus, at most.
BATCH = 512


class MergeReplay:
    """Encoder and decoder for one rank file, given as {token bytes: rank}."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.tokens = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.byte_merges = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int64)
        self.merges: dict[int, int] = {}
        self.known: dict[str, bytes] = {}  # int32 ids of a pre-token

    def _merge(self, left: int, right: int) -> int:
        """Rank of the token that the pair becomes, or -1; remembered."""
        rank = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        if len(self.merges) > PAIRS:
            self.merges.clear()
        self.merges[left << 20 | right] = rank
        return rank

    def learn(self, words: list[str]) -> None:
        """Encode distinct pre-tokens as one corpus and remember them."""
        raws, open_words, known, whole, pack = [], [], self.known, self.ranks.get, struct.Struct("=i").pack
        for word in words:
            raw = word.encode("utf-8")
            rank = whole(raw)
            if rank is None:
                raws.append(raw)
                open_words.append(word)
            else:
                known[word] = pack(rank)
        if not raws:
            return
        # Words stand apart by a gap that no pair crosses.
        ends = np.cumsum([len(r) + 1 for r in raws]) - 1
        flat = np.frombuffer(b"\0".join(raws) + b"\0", dtype=np.uint8)
        letters = self.byte_ids[flat]
        letters[ends] = -1
        ranks = np.append(self.byte_merges[flat[:-1], flat[1:]], -1)
        ranks[ends] = -1
        ranks[ends[:-1]], ranks[ends - 1] = -1, -1
        # The inverted index: rank of a merge -> positions of its pairs.
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        cuts = np.flatnonzero(np.append(True, np.diff(ranks[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        index = {r: p.tolist() for r, p in zip(ranks[order[cuts]].tolist(), np.split(order, cuts[1:]), strict=True)} if len(order) else {}
        due = sorted(index)
        spell, pair = letters.tolist(), ranks.tolist()
        after, before = list(range(1, len(spell) + 1)), list(range(-1, len(spell) - 1))
        merges, merge = self.merges, self._merge
        while due:
            rank = heappop(due)
            places = index.pop(rank)
            places.sort()
            for i, at in enumerate(places):
                if pair[at] != rank:
                    continue  # an earlier merge took one of its tokens
                gone = after[at]
                nxt = after[gone]
                after[at], before[nxt], spell[at], pair[gone] = nxt, at, rank, -1
                right, prev = spell[nxt], before[at]
                new = -1
                if right >= 0:
                    new = merges.get(rank << 20 | right)
                    if new is None:
                        new = merge(rank, right)
                    if new >= 0:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heappush(due, new)
                pair[at] = new
                if prev >= 0 and (left := spell[prev]) >= 0:
                    new = merges.get(left << 20 | rank)
                    if new is None:
                        new = merge(left, rank)
                    pair[prev] = new
                    if new >= 0:
                        if new in index:
                            index[new].append(prev)
                        else:
                            index[new] = [prev]
                            heappush(due, new)
                if due and due[0] < rank:
                    # the touched neighbours merge first, the other positions wait
                    if rest := places[i + 1 :]:
                        if rank in index:
                            index[rank] += rest
                        else:
                            index[rank] = rest
                            heappush(due, rank)
                    break
        start = 0
        for word, end in zip(open_words, ends.tolist(), strict=True):
            ids, at = array("i"), start
            while at < end:
                ids.append(spell[at])
                at = after[at]
            known[word] = ids.tobytes()
            start = end + 1

    def encode(self, texts: list[str]) -> list[list[str]]:
        """Pre-tokens of each text, all of them remembered in ``known``."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        pieces = [self.split.findall(t) for t in texts]
        fresh = set(chain.from_iterable(pieces)).difference(self.known)
        if fresh:
            self.learn(sorted(fresh))
        return pieces

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), dtype=np.int32) for p in self.encode(texts)]

    def text_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> MergeReplay:
    """The encoder of a rank file: a base64 token and its rank a line. The file must lie at ``path`` on every machine."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return MergeReplay(ranks, pattern)


def _schema(df: DataFrame, out: T.StructField) -> tuple[T.StructType, list[str]]:
    keep = [f for f in df.schema.fields if f.name != out.name]
    return T.StructType([*keep, out]), [f.name for f in keep]


def bpe_encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with ``out_col`` (array<int>): ids of the whole text; special tokens are ordinary text.

    With ``decoded_col``, that column (binary), what the ids decode to, takes the text's place: one pass instead of two.

    A null or empty text has no ids; texts may be of any length. A column named ``out_col`` is replaced; all other columns and
    repeated rows stay; an empty table gives an empty result.
    """
    ship(df.sparkSession)
    ids_field = T.StructField(out_col, T.ArrayType(T.IntegerType(), False))
    schema, names = _schema(df.drop(text_col, decoded_col) if decoded_col else df, ids_field)
    if decoded_col:
        schema = schema.add(decoded_col, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        gc.disable()  # no cycles here, and many small objects to walk
        try:
            for whole in batches:
                for i in range(0, whole.num_rows, BATCH):
                    b = whole.slice(i, BATCH)
                    ids = bpe.ids([t or "" for t in b.column(text_col).to_pylist()])
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                    column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                    more = [pa.array([bpe.text_bytes(x.tolist()) for x in ids], pa.binary())] if decoded_col else []
                    yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), column, *more], names=schema.names)
        finally:
            gc.enable()
            load.cache_clear()  # the worker goes on to other tasks, whose memory this one's words would take

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col`` (binary): the bytes that the ids stand for; null ids give empty bytes, an unknown id is an error.

    A column named ``out_col`` is replaced; all other columns and repeated rows stay; an empty table gives an empty result.
    """
    ship(df.sparkSession)
    schema, names = _schema(df, T.StructField(out_col, T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                b = whole.slice(i, BATCH)
                listed = b.column(ids_col).fill_null([])
                ids, ends = listed.flatten().to_numpy().tolist(), [0, *np.cumsum(pc.list_value_length(listed).to_numpy()).tolist()]
                column = pa.array([bpe.text_bytes(ids[x:y]) for x, y in zip(ends, ends[1:], strict=False)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), column], names=[*names, out_col])

    return df.mapInArrow(run, schema)
