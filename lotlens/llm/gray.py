"""Hierarchical index over Gray-ordered fingerprints: search by accumulated differences.

Fingerprints of one run (a set that may hold links) are sorted by Gray rank, so that neighbours share long bit patterns.
Blocks of ``FAN`` neighbours form a node that keeps the bits all of its fingerprints share (mask and pattern); nodes form
upper nodes in the same way. A query walks down, adds up its differences from the shared patterns, and leaves a whole
group as soon as the sum exceeds the radius.
"""

from __future__ import annotations

import numpy as np

FAN = 16
#: Queries of one step, whose runs hold at most as many pairs as the square of its block.
QUERIES = 1 << 14


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each uint64 code in Gray order; for rows of several words, of the first word."""
    r = np.array(codes if codes.ndim == 1 else codes[:, 0], dtype=np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


class GrayIndex:
    """Index over ``codes`` (n, words; uint64), already ordered by (run, Gray rank); ``runs``: start of each run, then n."""

    def __init__(self, codes: np.ndarray, runs: np.ndarray):
        self.codes = codes
        ones = np.full_like(codes, np.uint64(0xFFFFFFFFFFFFFFFF))
        # a level: start of each node among the nodes below (and the end), shared mask, shared pattern
        self.levels, below, mask, pattern, starts = [], runs, ones, codes, runs
        while True:
            sizes = np.diff(starts)
            per = -(-sizes // FAN)
            first = np.repeat(starts[:-1], per) + FAN * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
            low = np.append(first, starts[-1]).astype(np.int64)
            all_and = np.bitwise_and.reduceat(pattern, first, axis=0)
            all_or = np.bitwise_or.reduceat(pattern, first, axis=0)
            m = np.bitwise_and.reduceat(mask, first, axis=0) & ~(all_and ^ all_or)
            self.levels.append((low, m, all_and & m))
            starts = np.append(0, np.cumsum(per)).astype(np.int64)
            mask, pattern = m, all_and & m
            if (per <= 1).all():
                self.roots = starts
                return

    def pairs(self, radius: int | np.ndarray, queries: np.ndarray, root: np.ndarray, asked: np.ndarray | None = None):
        """(query position, other position, distance) arrays of all links at most ``radius`` (one for each code) apart; root: top node of each query.

        asked: which positions are queries at all, every one by default. A link of two queries comes from the later one.
        """
        radius = np.broadcast_to(radius, len(self.codes))
        q, node = queries, root
        low, mask, pattern = self.levels[-1]
        acc = _bits((self.codes[q] ^ pattern[node]) & mask[node])
        seen = mask[node]
        keep = acc <= radius[q]
        q, node, acc, seen = q[keep], node[keep], acc[keep], seen[keep]
        for depth in range(len(self.levels) - 1, -1, -1):
            low = self.levels[depth][0]
            n = low[node + 1] - low[node]
            child = np.repeat(low[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, acc, seen = np.repeat(q, n), np.repeat(acc, n), np.repeat(seen, n, axis=0)
            if depth:
                _, mask, pattern = self.levels[depth - 1]
                more = _bits((self.codes[q] ^ pattern[child]) & mask[child] & ~seen)
                acc = acc + more
                keep = acc <= radius[q]
                seen = seen | mask[child]
            else:
                keep = child < q if asked is None else (child < q) | ~asked[child]
                q, acc, seen, child = q[keep], acc[keep], seen[keep], child[keep]
                acc = acc + _bits((self.codes[q] ^ self.codes[child]) & ~seen)
                keep = acc <= radius[q]
                return q[keep], child[keep], acc[keep]
            q, node, acc, seen = q[keep], child[keep], acc[keep], seen[keep]
        raise AssertionError

    def tree_edges(self, radius: int | np.ndarray, block: int = 256, label: np.ndarray | None = None, barred: np.ndarray | None = None, holds=None):
        """Edges (position, position, distance) of a shortest spanning forest of all links: no link is lost, no group is paired out.

        label: positions with equal ones are connected already, and only links between different ones count; so all but the
        members of each run's commonest label are the queries. barred: (a, b) positions, a > b, that are no links after all.
        holds: a further test of links, (a, b) position arrays -> which are some. Queries go through the index in blocks; after
        each, the forest so far and the new links are thinned by Kruskal's rule.
        """
        n = len(self.codes)
        done = [np.zeros((0, 3), dtype=np.int64)]
        if not n:
            return done[0]
        kept = done[0]
        label = np.arange(n) if label is None else label
        low_of_run = self._run_starts()
        run = np.searchsorted(low_of_run, np.arange(n), "right") - 1  # also the run's root
        size = np.diff(np.append(low_of_run, n))
        asked = label != commonest(run, label, len(size))[run]
        busy = np.flatnonzero(asked)
        no = np.sort(barred[:, 0] * n + barred[:, 1]) if barred is not None else np.zeros(0, dtype=np.int64)
        at = 0
        while at < len(busy):
            # a block of queries whose runs hold at most so many pairs
            cost = np.cumsum(size[run[busy[at : at + QUERIES]]])
            take = max(1, int(np.searchsorted(cost, block * block, "right")))
            q = busy[at : at + take]
            e = np.column_stack(self.pairs(radius, q, run[q], asked)).astype(np.int64)
            e = e[label[e[:, 0]] != label[e[:, 1]]]
            e[:, :2] = -np.sort(-e[:, :2], axis=1)
            if len(no) and len(e):
                code = e[:, 0] * n + e[:, 1]
                e = e[no[np.minimum(np.searchsorted(no, code), len(no) - 1)] != code]
            if holds is not None and len(e):
                e = e[holds(e[:, 0], e[:, 1])]
            if len(e):
                e = np.concatenate([kept, e])
                kept = e[spanning(e, label)]
            at += take
            # runs that are over need not be thinned again
            now = run[busy[at]] if at < len(busy) else n
            over = run[kept[:, 0]] < now
            done.append(kept[over])
            kept = kept[~over]
        return np.concatenate(done)

    def _run_starts(self) -> np.ndarray:
        starts = np.arange(len(self.roots) - 1)
        for low, _, _ in reversed(self.levels):
            starts = low[starts]
        return starts


class _Sets:
    """Disjoint sets of small integers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def unite(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def commonest(run: np.ndarray, label: np.ndarray, runs: int) -> np.ndarray:
    """The label that most positions of each run have."""
    order = np.lexsort((label, run))
    r, v = run[order], label[order]
    first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])))
    count = np.diff(np.append(first, len(r)))
    out = np.zeros(runs, dtype=label.dtype)
    by_count = np.argsort(count, kind="stable")
    out[r[first[by_count]]] = v[first[by_count]]  # the last one written has the largest count
    return out


def spanning(edges: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which edges (a, b, distance) between labelled sets Kruskal's rule keeps, shortest first."""
    nodes, flat = np.unique(label[edges[:, :2]], return_inverse=True)
    sets = _Sets(len(nodes))
    kept = np.zeros(len(edges), dtype=bool)
    order = np.argsort(edges[:, 2], kind="stable")
    for i, (a, b) in zip(order.tolist(), flat.reshape(-1, 2)[order].tolist(), strict=True):
        kept[i] = sets.unite(a, b)
    return kept
