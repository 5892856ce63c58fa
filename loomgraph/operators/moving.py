"""Local moving of one level's graph, and of all levels above it, in arrays: what ``community`` does in
joins, round for round, for graphs that one task can hold.  Weights are whole numbers, so sums are
exact and both ways give the same communities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Ends of edges that are judged at once; temporary arrays have about as many elements.
CHUNK = 2_000_000
ROUNDS, LEVELS = 1, 2


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one bigint column."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(v, n):
        return (v << np.uint64(n)) | (v >> np.uint64(64 - n))

    h = turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1 ^ (p5 + np.uint64(50))
    h = turn(h, 27) * p1 + p4
    for shift, p in ((33, p2), (29, p3)):
        h = (h ^ (h >> np.uint64(shift))) * p
    return h ^ (h >> np.uint64(32))


def _by_key(key: np.ndarray, w: np.ndarray, most: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order (at most ``most``) and their weights (at most ``top``).  Key and weight
    are sorted as one number where 63 bits hold both; ``key`` is overwritten."""
    bits = int(top).bit_length()
    if int(most).bit_length() + bits > 63:
        at = np.argsort(key)
        return key[at], w[at]
    key <<= bits
    key |= w
    key.sort()
    np.bitwise_and(key, (1 << bits) - 1, out=w, casting="unsafe")
    key >>= bits
    return key, w


class Level:
    """A weighted graph: nodes 0 to n - 1, ``h`` their hashes, ``k`` their degrees; of every node its
    neighbours in ``b`` with weights ``w``, without loops.  ``pairs``: a, b, w, without loops; the list is
    emptied, so that they don't take memory beside what is made of them."""

    def __init__(self, pairs: list[np.ndarray], h: np.ndarray, k: np.ndarray):
        a, b, w = pairs
        pairs.clear()
        self.n, self.h, self.k, m = len(h), h, k, len(a)
        self.top = int(w.max(initial=0))
        key, ww = np.empty(2 * m, np.int64), np.empty(2 * m, np.min_scalar_type(max(self.top, 1)) if self.top < 1 << 32 else np.int64)
        for at, x, y in ((slice(m), a, b), (slice(m, None), b, a)):
            np.multiply(x, self.n, out=key[at], casting="unsafe", dtype=np.int64)
            key[at] += y
            ww[at] = w
        del a, b, w, x, y
        key, self.w = _by_key(key, ww, self.n * self.n, self.top)
        self.first = np.searchsorted(key, np.arange(self.n + 1, dtype=np.int64) * self.n)
        self.b = np.empty(2 * m, np.int32)
        np.remainder(key, self.n, out=self.b, casting="unsafe")

    def _parts(self) -> Iterator[tuple[int, int]]:
        """Ranges of nodes with CHUNK ends of edges at most, or of one node."""
        lo = 0
        while lo < self.n:
            hi = max(lo + 1, min(int(np.searchsorted(self.first, self.first[lo] + CHUNK, "right")) - 1, lo + CHUNK, self.n))
            yield lo, hi
            lo = hi

    def _best(self, lo: int, hi: int, comm: np.ndarray, tot: np.ndarray, size: np.ndarray, gamma: float, two_m: float) -> np.ndarray:
        """For nodes lo to hi - 1 the community each wants to be in."""
        ends, nodes = slice(self.first[lo], self.first[hi]), np.arange(hi - lo, dtype=np.int64)
        own = comm[lo:hi]
        # beside the neighbours' communities stands the own one, with no weight
        key = np.concatenate([np.repeat(nodes * self.n, np.diff(self.first[lo : hi + 1])) + comm[self.b[ends]], nodes * self.n + own])
        key, w = _by_key(key, np.concatenate([self.w[ends].astype(np.int64), np.zeros(hi - lo, np.int64)]), (hi - lo) * self.n, self.top)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        w = np.add.reduceat(w, start)
        i, c = np.divmod(key[start], self.n)
        mine, k = c == own[i], self.k[lo:hi][i]
        gain = w * two_m - (gamma * k) * (tot[c] - np.where(mine, k, 0.0))
        # of two singletons that want each other only the one with the greater id moves
        gain[~mine & (size[c] == 1) & (c > own[i])] = -np.inf
        start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        hit = gain == np.maximum.reduceat(gain, start)[i]
        stays = np.logical_or.reduceat(hit & mine, start)
        return np.where(stays, own, np.minimum.reduceat(np.where(hit, c, self.n), start))

    def move(self, gamma: float, two_m: float, max_rounds: int) -> tuple[np.ndarray, bool, bool]:
        """Every node's community, whether anything moved, whether nodes still want to after all rounds."""
        comm, moved = np.arange(self.n, dtype=np.int64), False
        for r in range(max_rounds):
            tot, size = np.bincount(comm, self.k, self.n), np.bincount(comm, minlength=self.n)
            best = np.concatenate([self._best(lo, hi, comm, tot, size, gamma, two_m) for lo, hi in self._parts()])
            wish = best != comm
            if not wish.any():
                return comm, moved, False
            go = wish & ((self.h >> np.uint64(r % 64)) & np.uint64(1) == 0)
            comm[go] = best[go]
            moved |= bool(go.any())
        return comm, moved, True


    def above(self, to: np.ndarray, n: int) -> list[np.ndarray]:
        """The pairs a, b, w between the ``n`` communities, where ``to`` gives each node's; no loops."""
        keys, ws = [], []
        for lo, hi in self._parts():
            ends = slice(self.first[lo], self.first[hi])
            a, b = np.repeat(to[lo:hi], np.diff(self.first[lo : hi + 1])), to[self.b[ends]]
            keep = a < b  # one of both directions
            keys.append(a[keep] * n + b[keep])
            ws.append(self.w[ends][keep])
        key, w = np.concatenate(keys), np.concatenate(ws)
        del keys, ws
        key, w = _by_key(key, w, n * n, self.top)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        w = np.add.reduceat(w, start, dtype=np.int64) if len(start) else w.astype(np.int64)
        return [*np.divmod(key[start], n), w]


def levels(pairs: list[np.ndarray], gamma: float, two_m: float, max_levels: int, max_rounds: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Nodes in ascending order, the community of each (one of the nodes), and which limits were hit.
    ``pairs``: a, b, w, whole numbers; loops count twice in degrees.  The list is emptied and its arrays
    are overwritten."""
    a, b, w = pairs
    pairs.clear()
    most = max(int(a.max()), int(b.max()))
    if most < 16 * len(a) + 1_000_000:
        there = np.zeros(most + 1, bool)
        there[a] = there[b] = True
        ids = np.flatnonzero(there)
        place = np.cumsum(there, dtype=np.int32) - np.int32(1)
        a[:], b[:] = place[a], place[b]
        del there, place
    else:
        ids = np.unique(np.concatenate([a, b]))
        a[:], b[:] = np.searchsorted(ids, a), np.searchsorted(ids, b)
    n, short = len(ids), 0
    h, k, now, member = spark_hash(ids), np.bincount(a, w, n) + np.bincount(b, w, n), np.arange(n), np.arange(n)
    pairs = [x[a != b] for x in (a, b, w)] if (a == b).any() else [a, b, w]
    del a, b, w
    for level in range(max_levels + 1):
        if level == max_levels:
            short |= LEVELS
            break
        here = Level(pairs, h, k)
        comm, moved, rest = here.move(gamma, two_m, max_rounds)
        short |= ROUNDS * rest
        if not moved:
            break
        up, to = np.unique(comm, return_inverse=True)
        pairs = here.above(to, len(up))
        member, now, h, k = to[member], now[up], h[up], np.bincount(to, k, len(up))
        del here
    return ids, ids[now[member]], short


def in_tasks(counts: dict[int, int], gammas: dict[int, float], two_m: float, max_levels: int, max_rounds: int):
    """For mapInArrow over r, a, b, w with each resolution r in one partition; ``counts``: pairs of each.
    Gives r, id, comm, short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for x in batches:
            own, *cols = (c.to_numpy(zero_copy_only=False) for c in x.columns)
            for r in map(int, np.unique(own)):
                if r not in held:
                    held[r] = [*(np.empty(counts[r], np.int32) for _ in cols), 0]
                filled, part = held[r][3], [c[own == r] for c in cols]
                for j, c in enumerate(part):
                    if held[r][j].dtype == np.int32 and c.max() >= 1 << 31:
                        held[r][j] = held[r][j].astype(np.int64)
                    held[r][j][filled : filled + len(c)] = c
                held[r][3] += len(part[0])
        for r in sorted(held):
            ids, comm, short = levels(held.pop(r)[:3], gammas[r], two_m, max_levels, max_rounds)
            for lo in range(0, len(ids), 100_000):
                own = slice(lo, lo + 100_000)
                n = len(ids[own])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r, np.int32)), pa.array(ids[own].astype(np.int64)), pa.array(comm[own].astype(np.int64)), pa.array(np.full(n, short, np.int32))], ["r", "id", "comm", "short"])

    return run
