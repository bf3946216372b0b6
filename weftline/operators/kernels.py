"""NumPy kernels over a graph of bounded size: nodes are positions 0..n-1, edges two position arrays.

They run inside a task (``whole_graph``) or over sources spread across tasks with the graph broadcast
(``per_source``). Only graphs that were counted and found small come here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from math import ceil, log2

import numpy as np

from weftline.errors import ComputeError
from weftline.operators.draws import draw

__all__ = ["Csr", "pagerank", "weak_roots", "strong_roots", "triangles", "degree_pairs", "distances", "within", "cheapest", "brandes", "brandes_weighted", "batches", "label_propagation", "louvain", "louvain_levels", "chosen", "in_order", "scaled", "SETTLED", "SWEEPS", "LEVELS"]

#: Numbers of the arrays that sources worked on together have, about: they stay within a core's cache.
BATCH_NUMBERS = 1 << 16

#: A level of Louvain is done once no more than this share of its nodes moves in a half-sweep, or after so many; and
#: there are so many levels at most.
SETTLED = 0.005
SWEEPS = 16
LEVELS = 12


class Csr:
    """Adjacency by source; ``slots`` are edges in order of (source, destination, row)."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray | None = None):
        step = np.diff(src)
        sorted_already = not ((step < 0).any() or (np.diff(dst)[step == 0] < 0).any())
        order = slice(None) if sorted_already else np.lexsort((dst, src))
        self.n, self.src, self.dst = n, src[order], dst[order]
        self.w = None if w is None else w[order]
        self.start = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(src, minlength=n), out=self.start[1:])

    def reversed(self) -> Csr:
        return Csr(self.n, self.dst, self.src, self.w)

    @cached_property
    def back(self) -> Csr:
        """The reversed graph, made once."""
        return self.reversed()

    def out_slots(self, nodes: np.ndarray) -> np.ndarray:
        """The slots of all edges out of ``nodes``, node by node."""
        first, size = self.start[nodes], self.start[nodes + 1] - self.start[nodes]
        total = int(size.sum())
        if not total:
            return np.zeros(0, np.int64)
        return np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)


def pagerank(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, damping: float, max_iter: int, tol: float) -> np.ndarray:
    strength = np.bincount(src, weights=w, minlength=n)
    sink = strength <= 0
    share = np.divide(w, strength[src], out=np.zeros(len(w)), where=~sink[src])
    rank = np.full(n, 1.0 / n)
    for _ in range(max_iter):
        pulled = np.bincount(dst, weights=rank[src] * share, minlength=n)
        new = (1 - damping) / n + damping * rank[sink].sum() / n + damping * pulled
        moved, rank = np.abs(new - rank).sum(), new
        if moved < tol:
            break
    return rank


def weak_roots(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each node the least node connected to it, by hooking roots together and halving paths."""
    root = np.arange(n)
    while len(src):
        a, b = root[src], root[dst]
        apart = a != b
        if not apart.any():
            break
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def strong_roots(graph: Csr) -> np.ndarray:
    """For each node the least node of its strongly connected component: one depth-first pass, no recursion."""
    n, start, dst = graph.n, graph.start.tolist(), graph.dst.tolist()
    index, low, on_stack = [-1] * n, [0] * n, [False] * n
    root, stack, counter = [0] * n, [], 0
    for origin in range(n):
        if index[origin] >= 0:
            continue
        index[origin] = low[origin] = counter
        counter += 1
        stack.append(origin)
        on_stack[origin] = True
        path = [(origin, start[origin])]
        while path:
            v, at = path.pop()
            end = start[v + 1]
            while at < end:
                u = dst[at]
                at += 1
                if index[u] < 0:
                    path.append((v, at))
                    index[u] = low[u] = counter
                    counter += 1
                    stack.append(u)
                    on_stack[u] = True
                    path.append((u, start[u]))
                    break
                if on_stack[u] and index[u] < low[v]:
                    low[v] = index[u]
            else:
                if low[v] == index[v]:
                    members = []
                    while True:
                        u = stack.pop()
                        on_stack[u] = False
                        members.append(u)
                        if u == v:
                            break
                    least = min(members)
                    for u in members:
                        root[u] = least
                if path and low[v] < low[path[-1][0]]:
                    low[path[-1][0]] = low[v]
    return np.array(root, np.int64)


def _lookup(keys: np.ndarray, span: int):
    """Whether numbers below ``span`` are among the sorted ``keys``: by one bit each while that is at most 128 MB."""
    if span > 1 << 30:
        return lambda x: keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x
    bits = np.zeros((span >> 3) + 1, np.uint8)
    np.bitwise_or.at(bits, keys >> 3, (1 << (keys & 7)).astype(np.uint8))
    return lambda x: (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1


def triangles(n: int, a: np.ndarray, b: np.ndarray, chunk: int = 2_000_000) -> np.ndarray:
    """Triangles at each node of a simple undirected graph given once by edge.

    Edges point from lower to higher degree, so wedges stay few; each wedge's third side is looked up.
    """
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    swap = (degree[a] > degree[b]) | ((degree[a] == degree[b]) & (a > b))
    low, high = np.where(swap, b, a), np.where(swap, a, b)
    g = Csr(n, low, high)
    sides = g.src * n + g.dst
    closed = _lookup(sides, n * n)
    wedges = (g.start[1:] - g.start[:-1])[g.dst]
    count = np.zeros(n, np.int64)
    cuts = np.searchsorted(np.cumsum(wedges), np.arange(chunk, wedges.sum() + chunk, chunk), side="left") + 1
    at = 0
    for end in np.unique(np.minimum(cuts, len(sides))):
        third = g.dst[g.out_slots(g.dst[at:end])]
        first = np.repeat(g.src[at:end], wedges[at:end])
        second = np.repeat(g.dst[at:end], wedges[at:end])
        found = closed(first * n + third)
        for corner in (first, second, third):
            count += np.bincount(corner[found], minlength=n)
        at = end
    return count


def degree_pairs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of neighbours of each node of a simple undirected graph given once by edge."""
    k = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    return k * (k - 1) // 2


def distances(back: Csr, sources: np.ndarray) -> list[np.ndarray]:
    """How many nodes are first reached at distance 1, 2, ... from each of up to 64 sources at once.

    ``back`` is the reversed graph: its rows gather, for every node, the nodes that lead to it. Each source is a
    bit of a word per node, so one pass over the edges advances all of them.
    """
    n = back.n
    seen = np.zeros(n, np.uint64)
    np.bitwise_or.at(seen, sources, np.uint64(1) << np.arange(len(sources), dtype=np.uint64))
    front, out = seen.copy(), []
    fed = np.flatnonzero(back.start[1:] > back.start[:-1])
    if not len(fed):
        return out
    while True:
        new = np.zeros(n, np.uint64)
        new[fed] = np.bitwise_or.reduceat(front[back.dst], back.start[fed])
        new &= ~seen
        hit = new[new != 0]
        if not len(hit):
            return out
        seen |= new
        bits = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(bits.sum(axis=0, dtype=np.int64)[: len(sources)])
        front = new


def within(graph: Csr, at: int, hops: int, seen: np.ndarray) -> np.ndarray:
    """The nodes that 1 to ``hops`` edges lead to from ``at``, in order and without it; ``seen`` is false everywhere, before and after."""
    front, found = np.array([at]), []
    seen[at] = True
    for _ in range(hops):
        new = graph.dst[graph.out_slots(front)]
        new = new[~seen[new]]
        if not len(new):
            break
        seen[new] = True
        if 16 * len(new) < graph.n:
            front = np.unique(new)
        else:
            now = seen.copy()
            now[at] = False
            for part in found:
                now[part] = False
            front = np.flatnonzero(now)
        found.append(front)
    seen[at] = False
    for part in found:
        seen[part] = False
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def batches(at: np.ndarray, numbers: int) -> Iterator[np.ndarray]:
    """The sources, so many at a time that arrays of ``numbers`` for each stay small."""
    size = 1 << max(0, (BATCH_NUMBERS // max(1, numbers)).bit_length() - 1)
    return (at[k : k + size] for k in range(0, len(at), size))


def _distinct(at: np.ndarray, size: int) -> np.ndarray:
    """Distinct positions below ``size`` in order; many of them by flags, which takes no sort."""
    if 64 * len(at) < size:
        return np.unique(at) if len(at) else at
    there = np.zeros(size, bool)
    there[at] = True
    return np.flatnonzero(there)


def cheapest(graph: Csr, at: np.ndarray) -> np.ndarray:
    """Least costs, a row a node and a column a source, infinite where no path leads.

    They are relaxed from the nodes that came nearer last, for all sources together.
    """
    bits = max(0, len(at) - 1).bit_length()
    width, out = 1 << bits, graph.start[1:] - graph.start[:-1]
    cost = np.full(graph.n << bits, np.inf)
    front = (at << bits) | np.arange(len(at))
    cost[front] = 0.0
    while len(front):
        nodes = front >> bits
        slots, size = graph.out_slots(nodes), out[nodes]
        to = (graph.dst[slots] << bits) | np.repeat(front & (width - 1), size)
        offer = np.repeat(cost[front], size) + graph.w[slots]
        nearer = offer < cost[to]
        to = to[nearer]
        np.minimum.at(cost, to, offer[nearer])
        front = _distinct(to, len(cost))
    return cost.reshape(graph.n, width)


def brandes(graph: Csr, at: np.ndarray, total: np.ndarray) -> None:
    """Add the dependencies of some sources: level by level out, then back. Parallel edges are paths of their own.

    All sources advance together: a number for each node and source is at ``node << bits | source``. Few edges out of the
    newest nodes, or into those not yet reached, are followed one by one; otherwise the edges into a new level are those that lead from the
    newest nodes to ones not yet reached, found for all edges and sources at once. On the way back each node passes on
    ``(1 + dependency) / paths``, which its predecessors sum.
    """
    bits = max(0, len(at) - 1).bit_length()
    back = graph.back
    width, out, into = 1 << bits, graph.start[1:] - graph.start[:-1], back.start[1:] - back.start[:-1]
    size, every = graph.n << bits, len(graph.src) << bits
    sources = (at << bits) | np.arange(len(at))
    unseen, newest, sigma = np.ones(size, bool), np.zeros(size, bool), np.zeros(size)
    front, steps, left = sources, [], (graph.n - 1) * len(at)
    unseen[front], sigma[front] = False, 1.0
    while left:
        nodes = front >> bits
        ahead = int(out[nodes].sum())
        open_ = np.flatnonzero(unseen) if 16 * ahead >= every else None
        behind = every if open_ is None else int(into[open_ >> bits].sum())
        if (8 if bits else 2) * min(ahead, behind) >= every:
            newest[front] = True
            hit = newest.reshape(-1, width)[graph.src]
            hit &= unseen.reshape(-1, width)[graph.dst]
            newest[front] = False
            at_edge = np.flatnonzero(hit)
            slots, source = at_edge >> bits, at_edge & (width - 1)
            origin, to = (graph.src[slots] << bits) | source, (graph.dst[slots] << bits) | source
        elif ahead <= behind:
            origin = np.repeat(front, out[nodes])
            to = graph.dst[graph.out_slots(nodes)]
            to = (to << bits) | (origin & (width - 1)) if bits else to
            fresh = np.flatnonzero(unseen[to])
            origin, to = origin[fresh], to[fresh]
        else:
            newest[front] = True
            to = np.repeat(open_, into[open_ >> bits])
            origin = back.dst[back.out_slots(open_ >> bits)]
            origin = (origin << bits) | (to & (width - 1)) if bits else origin
            fresh = np.flatnonzero(newest[origin])
            newest[front] = False
            origin, to = origin[fresh], to[fresh]
        if not len(to):
            break
        unseen[to] = False
        if 8 * len(to) > size:
            gained = np.bincount(to, weights=sigma[origin], minlength=size)
            front = np.flatnonzero(gained > 0)
            sigma += gained
        else:
            np.add.at(sigma, to, sigma[origin])
            front = np.unique(to)
        left -= len(front)
        steps.append((origin, to))
    _passed_back(steps, sigma, sources, total, bits)


def _passed_back(steps: list, sigma: np.ndarray, sources: np.ndarray, total: np.ndarray, bits: int) -> None:
    gathered = np.zeros(len(sigma))
    shares = np.divide(1.0, sigma, out=np.zeros(len(sigma)), where=sigma > 0)
    for origin, to in reversed(steps):
        if 8 * len(to) > len(sigma):
            gathered += np.bincount(origin, weights=(gathered + shares)[to], minlength=len(sigma))
        else:
            np.add.at(gathered, origin, gathered[to] + shares[to])
    gathered[sources] = 0
    total += (gathered * sigma).reshape(len(total), 1 << bits).sum(axis=1)


def brandes_weighted(graph: Csr, at: np.ndarray, total: np.ndarray) -> None:
    """As :func:`brandes`, along edges that lie on cheapest paths, each node once all edges into it have been taken.

    Edges of weight 0 count like others; in circles of them paths cannot be counted, which is an error.
    """
    bits = max(0, len(at) - 1).bit_length()
    sources = (at << bits) | np.arange(len(at))
    cost = cheapest(graph, at)
    slots, source = np.nonzero(np.isfinite(cost[graph.src]) & (cost[graph.src] + graph.w[:, None] == cost[graph.dst]) & (graph.src != graph.dst)[:, None])
    some = Csr(graph.n << bits, (graph.src[slots] << bits) | source, (graph.dst[slots] << bits) | source)
    waits = np.bincount(some.dst, minlength=some.n)
    sigma, steps, taken = np.zeros(some.n), [], 0
    sigma[sources] = 1.0
    front = sources[waits[sources] == 0]
    while len(front):
        found = some.out_slots(front)
        origin, to = some.src[found], some.dst[found]
        np.add.at(sigma, to, sigma[origin])
        np.subtract.at(waits, to, 1)
        steps.append((origin, to))
        taken += len(to)
        front = _distinct(to[waits[to] == 0], some.n)
    if taken < len(some.dst):
        raise ComputeError(ZERO_CIRCLE)
    _passed_back(steps, sigma, sources, total, bits)


ZERO_CIRCLE = "shortest paths cannot be counted where edges of weight 0 run in circles"


def label_propagation(n: int, src: np.ndarray, dst: np.ndarray, numbers: np.ndarray, max_iter: int, seed: int) -> np.ndarray:
    """Majority votes over edges of both directions in seeded half-sweeps; ties go to the least label."""
    label = np.arange(n)
    pair, times = np.unique(np.concatenate((src * n + dst, dst * n + src)), return_counts=True)
    a, b = pair // n, pair % n
    for sweep in range(max_iter):
        coin, changed = draw(seed, numbers, sweep) & 1, False
        for half in (0, 1):
            vote, at = np.unique(a * n + label[b], return_inverse=True)
            votes = np.bincount(at, weights=times, minlength=len(vote))
            who, what = vote // n, vote % n
            start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
            most = np.repeat(np.maximum.reduceat(votes, start), np.diff(np.r_[start, len(who)])) if len(who) else votes
            best = np.minimum.reduceat(np.where(votes == most, what, n), start) if len(who) else what
            new = label.copy()
            voter = who[start]
            turn = coin[voter] == half
            new[voter[turn]] = best[turn]
            changed |= bool((new != label).any())
            label = new
        if not changed:
            break
    return label


def scaled(total: float) -> float:
    """The power of two by which weights of this sum become whole numbers whose sums are exact in any order."""
    return 2.0 ** (50 - ceil(log2(total)))


def louvain(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, numbers: np.ndarray, resolution: float, seed: int) -> np.ndarray:
    """Modularity by half-sweeps of synchronous moves and aggregation. Communities are numbered from 0 by first member."""
    weight = float(w.sum()) if len(w) else 0.0
    if weight <= 0:
        return np.arange(n)
    scale = scaled(weight)
    return in_order(louvain_levels(n, np.minimum(src, dst), np.maximum(src, dst), np.rint(w * scale), numbers, resolution, seed, 0, 1e-12 * scale))


def louvain_levels(n: int, low: np.ndarray, high: np.ndarray, w: np.ndarray, numbers: np.ndarray, resolution: float, seed: int, first: int, least: float) -> np.ndarray:
    """The community of each node from level ``first`` on, named by a node of it; weights of pairs are whole numbers."""
    member, total = np.arange(n), 2.0 * w.sum()
    for level in range(first, LEVELS):
        there = np.unique(np.concatenate((low, high)))
        place = np.full(n, -1)
        place[there] = np.arange(len(there))
        pair, at = np.unique(place[low] * len(there) + place[high], return_inverse=True)
        w = np.bincount(at, weights=w, minlength=len(pair))
        low, high = pair // len(there), pair % len(there)
        own = low == high
        a, b, x = low[~own], high[~own], w[~own]
        links = Csr(len(there), np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((x, x)))
        k = np.bincount(links.src, weights=links.w, minlength=len(there)) + 2 * np.bincount(low[own], weights=w[own], minlength=len(there))
        c, ever = _moves(links, k, total, numbers[there], resolution, seed, level, least)
        inside = place[member] >= 0
        member[inside] = there[c[place[member[inside]]]]
        if not ever:
            break
        low, high = there[c[low]], there[c[high]]
        low, high = np.minimum(low, high), np.maximum(low, high)
    return member


def _moves(g: Csr, k: np.ndarray, total: float, numbers: np.ndarray, resolution: float, seed: int, level: int, least: float) -> tuple[np.ndarray, bool]:
    """Each node's community after the half-sweeps of a level, and whether any moved; in a half-sweep half of the nodes choose."""
    n, ever = g.n, False
    c = np.arange(n)
    if not len(g.src):
        return c, False
    for sweep in range(SWEEPS):
        turn = draw(seed, numbers, level * SWEEPS + sweep) & 1 == 0
        size = np.bincount(c, weights=k, minlength=n)
        mine = np.flatnonzero(turn[g.src])
        if not len(mine):
            if sweep:
                break
            continue
        who, best = chosen(g.src[mine], g.dst[mine], g.w[mine], c, k, size, total, resolution, least)
        changed = len(who)
        c[who] = best
        ever |= changed > 0
        if sweep and changed <= SETTLED * n:
            break
    return c, ever


def chosen(at: np.ndarray, to: np.ndarray, w: np.ndarray, c: np.ndarray, k: np.ndarray, size: np.ndarray, total: float, resolution: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes among ``at`` that move, all links of each being given, and the communities where they go.

    They choose by what holds now the community of most gain; of equal ones their own, else the last.
    """
    n = len(c)
    key = at * n + c[to]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    into = np.add.reduceat(w[order], first)
    who, to = key[first] // n, key[first] % n
    stays = to == c[who]
    gain = into - resolution * (size[to] - np.where(stays, k[who], 0.0)) * k[who] / total
    start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(who)]))
    most = np.maximum.reduceat(gain, start)
    best = np.maximum.reduceat(np.where(gain == most[group], to + n * stays, -1), start) % n
    here = np.zeros(len(start))
    here[group[stays]] = into[stays]
    voter = who[start]
    now = here - resolution * (size[c[voter]] - k[voter]) * k[voter] / total
    go = (most > now + least) & (best != c[voter])
    return voter[go], best[go]


def in_order(labels: np.ndarray) -> np.ndarray:
    """Labels replaced by 0, 1, ... in order of first appearance."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inverse]
