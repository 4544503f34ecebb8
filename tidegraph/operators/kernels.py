"""Graph kernels that run in one task, on graphs of a checked size (MAX_EDGES); each has a DataFrame version beyond it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MAX_EDGES = 2_000_000


def compact(src: np.ndarray, dest: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, and the ends as places among them."""
    ids = np.unique(np.concatenate([src, dest] + ([extra] if extra is not None else [])))
    return ids, np.searchsorted(ids, src), np.searchsorted(ids, dest)


def csr(n: int, src: np.ndarray, dest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(src, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dest[by]


def strong_components(n: int, src: np.ndarray, dest: np.ndarray) -> np.ndarray:
    """Each vertex's component, named by its least member: one depth-first pass with low points on an explicit stack."""
    starts, to = (x.tolist() for x in csr(n, src, dest))
    order, low, comp = [-1] * n, [0] * n, [-1] * n
    clock, open_ = 0, []
    for root in range(n):
        if order[root] >= 0:
            continue
        path = [(root, starts[root])]
        order[root] = low[root] = clock
        clock += 1
        open_.append(root)
        while path:
            v, at = path[-1]
            if at < starts[v + 1]:
                path[-1] = (v, at + 1)
                u = to[at]
                if order[u] < 0:
                    order[u] = low[u] = clock
                    clock += 1
                    open_.append(u)
                    path.append((u, starts[u]))
                elif comp[u] < 0:
                    low[v] = min(low[v], order[u])
                continue
            path.pop()
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[v])
            if low[v] == order[v]:
                members = []
                while not members or members[-1] != v:
                    members.append(open_.pop())
                least = min(members)
                for u in members:
                    comp[u] = least
    return np.array(comp, dtype=np.int64)


def longest_levels(n: int, src: np.ndarray, dest: np.ndarray) -> np.ndarray:
    """1 for sources of a DAG, else one more than the highest level before it; a whole layer at a time."""
    level, left = np.ones(n, dtype=np.int64), np.bincount(dest, minlength=n)
    starts, to = csr(n, src, dest)
    ready = np.flatnonzero(left == 0)
    while len(ready):
        size = starts[ready + 1] - starts[ready]
        at = np.repeat(starts[ready] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        np.maximum.at(level, to[at], np.repeat(level[ready], size) + 1)
        hit, n_hit = np.unique(to[at], return_counts=True)
        left[hit] -= n_hit
        ready = hit[left[hit] == 0]
    return level


def distances(starts: np.ndarray, to: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices reached from root, itself included, and their distances; a frontier at a time."""
    n = len(starts) - 1
    dist = np.full(n, -1)
    dist[root] = 0
    front, far = np.array([root]), 0
    while len(front):
        far += 1
        size = starts[front + 1] - starts[front]
        at = np.repeat(starts[front] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        front = np.unique(to[at])
        front = front[dist[front] < 0]
        dist[front] = far
    found = np.flatnonzero(dist >= 0)
    return found, dist[found]


def pagerank(n: int, src: np.ndarray, dest: np.ndarray, share: np.ndarray, d: float, steps: int, tol: float | None) -> tuple[np.ndarray, int, bool]:
    """Ranks of n vertices, each of which gives its shares along its edges; how many steps were made, and whether the last one's summed change was below tol."""
    now = np.full(n, 1.0 / max(n, 1))
    for step in range(1, steps + 1):
        new = (1 - d) / max(n, 1) + d * np.bincount(dest, weights=now[src] * share, minlength=n)
        moved, now = np.abs(new - now).sum(), new
        if tol is not None and moved < tol:
            return now, step, True
    return now, steps, False


def turned(starts: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the edges, in order of where they go."""
    src, by = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts)), np.argsort(to, kind="stable")
    return src[by], to[by]


def reached(starts: np.ndarray, to: np.ndarray, roots: np.ndarray, edges: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many vertices each root reaches, itself included, and the sum of their distances: one bit a root, all of a word's roots at a time."""
    n, words = len(starts) - 1, -(-len(roots) // 64)
    bit = np.uint64(1) << (np.arange(len(roots)) % 64).astype(np.uint64)
    seen = np.zeros((n, words), dtype=np.uint64)
    np.bitwise_or.at(seen, (roots, np.arange(len(roots)) // 64), bit)
    # Per vertex, what its predecessors hold: edges in order of their ends.
    src, ends = edges or turned(starts, to)
    size, total, far, front = np.ones(len(roots), np.int64), np.zeros(len(roots), np.int64), 0, seen.copy()
    full = np.bitwise_or.reduce(seen, axis=0)
    while True:
        far += 1
        new = np.zeros_like(seen)
        # Edges from vertices of the front to such as some root hasn't reached, some at a time.
        live, open_ = front.any(axis=1), (seen != full).any(axis=1)
        for low in range(0, len(ends), 1 << 20):
            at = slice(low, low + (1 << 20))
            some = np.flatnonzero(live[src[at]] & open_[ends[at]]) + low
            if not len(some):
                continue
            first = np.flatnonzero(np.concatenate([[True], ends[some[1:]] != ends[some[:-1]]]))
            new[ends[some[first]]] |= np.bitwise_or.reduceat(front[src[some]], first, axis=0)
        new &= ~seen
        some = np.flatnonzero(new.any(axis=1))
        if not len(some):
            break
        seen |= new
        found = np.zeros(words * 64, np.int64)
        for at in range(0, len(some), 8192):
            found += np.unpackbits(new[some[at : at + 8192]].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        size += found[: len(roots)]
        total += far * found[: len(roots)]
        front = new
    return size, total


def by_degree(starts: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Vertices, those that most edges leave first, and between their ranks in that order the adjacency and that of the edges turned."""
    n, degree = len(starts) - 1, np.diff(starts)
    order = np.argsort(-degree, kind="stable").astype(np.int32)
    rank = np.empty_like(order)
    rank[order] = np.arange(n)
    src, dest = np.repeat(rank, degree), rank[to]
    return order, csr(n, src, dest), csr(n, dest, src)


def sums_to(links: tuple[np.ndarray, np.ndarray], back: tuple[np.ndarray, np.ndarray], targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vertex, how many of the different targets it reaches, and the sum of its distances to them: a bit a target, all of them at a time, moved against
    the edges, so that a vertex's bits are counted along its own row. The graph is as by_degree gives it."""
    (starts, to), n, words, places = links, len(links[0]) - 1, -(-len(targets) // 64), np.arange(len(targets))
    degree, chunk = np.diff(starts), max(64, 16384 // words)
    front, spare = np.zeros((n, words), np.uint64), np.zeros((n, words), np.uint64)
    front[targets, places // 64] = np.uint64(1) << (places % 64).astype(np.uint64)
    seen, (buffer, sums) = front.copy(), np.empty((2, chunk, words), np.uint64)
    size, total, far, live = np.bitwise_count(front).sum(axis=1, dtype=np.int64), np.zeros(n, np.int64), 0, targets

    def pushed(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What the live vertices' predecessors get."""
        at = np.repeat(back[0][live] - np.cumsum(count) + count, count) + np.arange(count.sum())
        src, dest = back[1][at], np.repeat(live, count)
        by = np.argsort(src, kind="stable")
        first = np.flatnonzero(np.append(True, src[by][1:] != src[by][:-1]))
        rows = src[by][first]
        yield rows, np.bitwise_or.reduceat(front[dest[by]], first, axis=0) & ~seen[rows]

    def pulled() -> Iterator[tuple[slice | np.ndarray, np.ndarray]]:
        """What vertices that lack some of the bits under way take, some vertices at a time: of each its first edge, then its second, and so on."""
        moving = np.bitwise_or.reduce(front, axis=0)
        for low in range(0, np.count_nonzero(degree), chunk):
            rows: slice | np.ndarray = slice(low, low + chunk)
            lacks = ~seen[rows] & moving
            some = np.flatnonzero(np.bitwise_or.reduce(lacks, axis=1))
            if 2 * len(some) < len(lacks):
                rows, lacks = some + low, lacks[some]
            begins, most, got = starts[:-1][rows], degree[rows], sums[: len(lacks)]
            got[:] = 0
            for k, m in enumerate(np.searchsorted(-most, -np.arange(most[0] if len(most) else 0))):
                np.bitwise_or(got[:m], np.take(front, to[begins[:m] + k], axis=0, out=buffer[:m], mode="clip"), out=got[:m])
            yield rows, np.bitwise_and(got, lacks, out=lacks)

    while len(live):
        count, far, hit = back[0][live + 1] - back[0][live], far + 1, [live[:0]]
        for rows, new in pulled() if count.sum() > len(to) // 8 else pushed(count) if count.any() else ():
            found = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
            spare[rows] = new
            seen[rows] |= new
            size[rows] += found
            total[rows] += far * found
            some = np.flatnonzero(found)
            hit.append(some + rows.start if isinstance(rows, slice) else rows[some])
        front[live] = 0
        front, spare, live = spare, front, np.concatenate(hit)
    return size, total


def reach_sums(target: np.ndarray, values: np.ndarray, src: np.ndarray, dest: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Per vertex of a DAG, the sums of values over what it reaches among the targets (itself included): a bit for each, filled from the sinks up."""
    words = -(-len(target) // 64)
    reach = np.zeros((len(level), words), dtype=np.uint64)
    np.bitwise_or.at(reach, (target, np.arange(len(target)) // 64), np.uint64(1) << (np.arange(len(target)) % 64).astype(np.uint64))
    order = np.lexsort((src, -level[src])) if len(src) else np.zeros(0, np.int64)
    s, d = src[order], dest[order]
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(level[s]) != 0])) if len(s) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(s))[: len(cuts)], strict=True):
        first = np.flatnonzero(np.concatenate([[True], s[a + 1 : b] != s[a : b - 1]]))
        reach[s[a:b][first]] |= np.bitwise_or.reduceat(reach[d[a:b]], first, axis=0)
    out, own = np.zeros((len(level), values.shape[1]), dtype=np.int64), values[target]
    some = np.flatnonzero(reach.any(axis=1))
    for at in range(0, len(some), 4096):  # sums stay below 2**53, so that floats give them exactly
        rows = some[at : at + 4096]
        out[rows] = (np.unpackbits(reach[rows].view(np.uint8), axis=1, bitorder="little")[:, : len(target)].astype(np.float64) @ own.astype(np.float64)).astype(np.int64)
    return out
