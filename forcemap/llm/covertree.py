"""A cover tree over norm-augmented integer vectors, with exact inner-product searches.

Each vector gets one more component that brings all of them to the block's largest norm, so they lie on a sphere and the
inner product with a query falls with the angle between them. A node is a vector with a covering angle: every vector below
is within it. Level by level the covering distance shrinks by ``SHRINK``; a node's children are a net of vectors that far
apart, and each vector goes to the nearest of them. Vectors whose cluster is smaller than ``FEW`` stay in the node itself.

For a query, the angle to a node's centre and its covering angle give the largest and the smallest inner product below it.
Searches take nodes best first and compute the products of the vectors they meet exactly; bounds have a margin, so rounding
never hides a vector.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

SHRINK = 1.3
FEW = 12
LEAF = 64
#: Share of the largest possible product by which bounds are widened against rounding.
MARGIN = 1e-7
#: Below every score: scores are cut at one more.
NOTHING = -(2**63) + 1


@dataclass
class Tree:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # In the order of the nodes' own rows.
    own: np.ndarray  # (first, after) of each node's own rows.
    children: list[list[int]]
    centers: np.ndarray  # Row of each node's centre.
    angles: np.ndarray  # Covering angle of each node.
    has: np.ndarray  # Which labels (of ``names``) are below each node.
    names: np.ndarray
    norm: float


def padded(vectors: list, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
    points = vectors.astype(np.float64)
    squares = np.einsum("ij,ij->i", points, points)
    norm = float(np.sqrt(squares.max(initial=0.0)))
    points = np.column_stack([points, np.sqrt(np.maximum(norm * norm - squares, 0.0))])

    def distances(rows: np.ndarray, center: int) -> np.ndarray:
        off = points[rows] - points[center]
        return np.sqrt(np.einsum("ij,ij->i", off, off))

    own, children, centers, radii, parts, subtree = [], [], [], [], [], []
    everything = np.argsort(ids, kind="stable")
    root = int(everything[0])
    todo = [(everything, root, distances(everything, root), -1)]
    while todo:
        rows, center, far, parent = todo.pop()
        node = len(centers)
        centers.append(center)
        radii.append(float(far.max(initial=0.0)))
        children.append([])
        subtree.append(rows)
        if parent >= 0:
            children[parent].append(node)
        if len(rows) <= LEAF or radii[-1] == 0.0:
            parts.append(rows)
            continue
        apart, net, best, nearest = radii[-1] / SHRINK, [], np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        at = int(np.flatnonzero(rows == center)[0])
        while True:
            d = distances(rows, int(rows[at]))
            closer = d < best
            best[closer], nearest[closer] = d[closer], len(net)
            net.append(int(rows[at]))
            uncovered = np.flatnonzero(best > apart)
            if not len(uncovered):
                break
            at = int(uncovered[0])
        sizes = np.bincount(nearest, minlength=len(net))
        stay = sizes[nearest] < FEW
        parts.append(rows[stay])
        for k in np.flatnonzero(sizes >= FEW):
            mine = nearest == k
            todo.append((rows[mine], net[k], best[mine], node))
    order = np.concatenate(parts)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(order))
    stops = np.cumsum([len(p) for p in parts])
    own = np.column_stack([stops - [len(p) for p in parts], stops])
    names, of = np.unique(labels, return_inverse=True)
    has = np.zeros((len(centers), len(names)), bool)
    for node, rows in enumerate(subtree):
        has[node, of[rows]] = True
    chord = np.array(radii) / (2 * norm) if norm else np.zeros(len(radii))
    return Tree(ids[order], labels[order], vectors[order], own, children, place[centers], 2 * np.arcsin(np.minimum(chord, 1.0)), has, names, norm)


class Search:
    """Searches of many queries in one tree."""

    def __init__(self, tree: Tree, queries: np.ndarray):
        self.tree, self.queries = tree, queries
        width = max(tree.vectors.shape[1], queries.shape[1], 1)
        widen = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        rows, wanted = widen(tree.vectors), widen(queries)
        most = float(np.abs(rows).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * width
        # Doubles hold all sums exactly up to 2^53, longs up to 2^63, and Python's integers always.
        self.kind = np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object
        self.rows, self.wanted = rows.astype(self.kind), wanted.astype(self.kind)
        norms = np.sqrt(np.einsum("ij,ij->i", wanted.astype(np.float64), wanted.astype(np.float64)))
        reach = norms * tree.norm
        product = wanted.astype(np.float64) @ rows[tree.centers].astype(np.float64).T
        angle = np.arccos(np.clip(product / np.maximum(reach, 1e-300)[:, None], -1.0, 1.0))
        slack = (reach * MARGIN + 1e-3)[:, None]
        self.above = reach[:, None] * np.cos(np.maximum(angle - tree.angles, 0.0)) + slack
        # Scores beyond 64 bits are cut, so no bound from below may lie above the largest one.
        self.below = np.minimum(reach[:, None] * np.cos(np.minimum(angle + tree.angles, np.pi)) - slack, 2.0**63 - 1024)
        self.visited = 0

    def _block(self, queries: np.ndarray, first: int, after: int) -> np.ndarray:
        """Exact scores of some queries with the rows of a node."""
        self.visited += len(queries) * int(after - first)
        scores = self.wanted[queries] @ self.rows[first:after].T
        if self.kind is object:
            scores = np.array([[max(2 - 2**63, min(2**63 - 1, int(s))) for s in line] for line in scores], np.int64).reshape(scores.shape)
        return scores.astype(np.int64)

    def sweep(self, k: int, ids: np.ndarray, labels: np.ndarray, same: bool, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For every query (its id and label) and each of its windows the first ``k`` rows of its label, or of all others.

        One descent for all queries: nodes come best first by the best bound of any query, and a query takes part only
        where its own bounds reach its window and can still better what it has. ``low`` and ``high`` are (queries, windows);
        a window without room is left out. Returns scores and ids, (queries, windows, k), ``NOTHING`` where there is none.
        """
        tree, n = self.tree, len(self.queries)
        if low is None:
            low, high = np.full((n, 1), 2 - 2**63), np.full((n, 1), 2**63 - 1)
        score, found = np.full((*low.shape, k), NOTHING), np.full((*low.shape, k), NOTHING)
        at = np.searchsorted(tree.names, labels)
        known = (at < len(tree.names)) & (tree.names[np.minimum(at, len(tree.names) - 1)] == labels)
        mine = np.where(known, tree.has[:, np.minimum(at, len(tree.names) - 1)], False)  # nodes x queries
        below = mine if same else tree.has.sum(axis=1)[:, None] > mine
        queue = [(0.0, 0, low <= high)]
        while queue:
            _, node, active = heapq.heappop(queue)
            above, under = self.above[:, node, None], self.below[:, node, None]
            active = active & below[node][:, None] & (above >= low) & (under <= high) & (np.minimum(above, high) >= score[:, :, -1])
            who = np.flatnonzero(active.any(axis=1))
            if not len(who):
                continue
            first, after = tree.own[node]
            if after > first:
                own = tree.labels[first:after] == labels[who][:, None]
                fits = own & (tree.ids[first:after] != ids[who][:, None]) if same else ~own
                scores = self._block(who, first, after)
                for w in range(low.shape[1]):
                    ok = fits & active[who, w][:, None] & (scores >= np.maximum(low[who, w], score[who, w, -1])[:, None]) & (scores <= high[who, w][:, None])
                    line, column = np.nonzero(ok)
                    if len(line):
                        self._merge(score[:, w], found[:, w], who[line], scores[line, column], tree.ids[first + column])
            for child in tree.children[node]:
                reach = np.where(active, np.minimum(self.above[:, child, None], high), -np.inf).max()
                heapq.heappush(queue, (-float(reach), child, active))
        return score, found

    @staticmethod
    def _merge(score: np.ndarray, found: np.ndarray, query: np.ndarray, more: np.ndarray, ids: np.ndarray) -> None:
        """The first k of what queries have and get, in place."""
        who, k = np.unique(query), score.shape[1]
        q = np.concatenate([query, np.repeat(who, k)])
        s, i = np.concatenate([more, score[who].ravel()]), np.concatenate([ids, found[who].ravel()])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(q)]))))
        top = rank < k
        score[who], found[who] = s[top].reshape(-1, k), i[top].reshape(-1, k)

    def _scores(self, query: int, node: int, met: dict[int, np.ndarray]) -> np.ndarray:
        if node not in met:
            first, after = self.tree.own[node]
            self.visited += int(after - first)
            scores = self.rows[first:after] @ self.wanted[query]
            if self.kind is object:
                scores = np.array([max(2 - 2**63, min(2**63 - 1, int(s))) for s in scores], np.int64)
            met[node] = scores.astype(np.int64)
        return met[node]

    def best(self, query: int, k: int, allowed: np.ndarray, nodes: np.ndarray, low: int | None = None, high: int | None = None, met: dict | None = None) -> list[tuple[int, int]]:
        """The first ``k`` (score, id) of the ``allowed`` rows with scores in the window, highest first, smaller id in ties.

        ``nodes`` says which nodes have allowed rows at all.
        """
        tree, met = self.tree, {} if met is None else met
        above, below = self.above[query], self.below[query]
        found: list[tuple[int, int]] = []  # (-score, id)
        queue = [(-above[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if len(found) == k and -bound < -found[-1][0]:
                break
            first, after = tree.own[node]
            if after > first:
                scores = self._scores(query, node, met)
                fits = allowed[first:after]
                if low is not None:
                    fits = fits & (scores >= low) & (scores <= high)
                if len(found) == k:
                    fits = fits & (scores >= -found[-1][0])
                at = np.flatnonzero(fits)
                if len(at) > k:
                    at = at[np.lexsort((tree.ids[first:after][at], -scores[at]))[:k]]
                if len(at):
                    found = sorted(found + [(-int(scores[i]), int(tree.ids[first + i])) for i in at])[:k]
            for child in tree.children[node]:
                if not nodes[child] or low is not None and (above[child] < low or below[child] > high):
                    continue
                queue_bound = above[child] if high is None else min(above[child], high)
                if len(found) < k or queue_bound >= -found[-1][0]:
                    heapq.heappush(queue, (-queue_bound, child))
        return [(-s, i) for s, i in found]
