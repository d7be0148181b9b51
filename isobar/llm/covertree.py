"""Cover trees over unit vectors, and their dual traversal for exact threshold pairs (numpy, one block at a time)."""

from __future__ import annotations

import numpy as np

# Candidate centres that are tried at a time, and rows of a distance block.
BATCH, ROWS = 256, 512
# Slack on distances, far above rounding and far below any use.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first so that no square overflows or vanishes."""
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def net(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(centre, distance) per point: greedily, a point that no centre covers within the radius becomes one; the first point does."""
    n = len(points)
    centre, far = np.full(n, -1), np.zeros(n)
    left = np.arange(n)
    while len(left):
        tried = left[:BATCH]
        d = distances(points[tried], points[left])
        free = np.ones(len(left), bool)
        for k, c in enumerate(tried):
            if free[k]:
                new = free & (d[k] <= radius)
                new[k] = True
                centre[left[new]] = c
                far[left[new]] = d[k][new]
                far[c] = 0.0
                free &= ~new
        left = left[free]
    return centre, far


class CoverTree:
    """Nested levels: a node's children are centres of half its radius among its points, its own centre first.

    `order` lists points so that a node's points are neighbours; per level, node k has points order[lo[k]:hi[k]], its centre first,
    a measured covering radius, and children first[k] to first[k + 1] - 1 on the next level.
    """

    def __init__(self, points: np.ndarray, finest: float):
        self.points = points
        n = len(points)
        self.order = np.arange(n)
        lo, hi = np.array([0]), np.array([n])
        far = distances(points[:1], points)[0]
        self.lo, self.hi, self.radius, self.first = [lo], [hi], [np.array([far.max()])], []
        scale = 1.0
        while scale >= finest and (hi - lo > 1).any():
            new_lo, new_hi, new_r, owner = [], [], [], []
            for k in np.flatnonzero(hi - lo > 1):
                mine = self.order[lo[k]:hi[k]]
                centre, far = net(points[mine], scale)
                by = np.argsort(centre, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(centre[by]) > 0])
                self.order[lo[k]:hi[k]] = mine[by]
                new_lo.append(lo[k] + starts)
                new_hi.append(lo[k] + np.r_[starts[1:], len(by)])
                new_r.append(np.maximum.reduceat(far[by], starts))
                owner.append(np.full(len(starts), k))
            alone = np.flatnonzero(hi - lo == 1)
            new_lo.append(lo[alone])
            new_hi.append(hi[alone])
            new_r.append(np.zeros(len(alone)))
            owner.append(alone)
            lo, hi, r, owner = map(np.concatenate, (new_lo, new_hi, new_r, owner))
            by = np.argsort(lo, kind="stable")
            lo, hi, r, owner = lo[by], hi[by], r[by], owner[by]
            self.first.append(np.searchsorted(owner, np.arange(len(self.lo[-1]) + 1)))
            self.lo.append(lo)
            self.hi.append(hi)
            self.radius.append(r)
            scale /= 2

    @property
    def depth(self) -> int:
        return len(self.first)

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Children of nodes of a level on the next one; nodes of the last level are their own."""
        if level >= self.depth:
            return nodes
        start, n = self.first[level][nodes], self.first[level][nodes + 1] - self.first[level][nodes]
        return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())

    def at(self, level: int) -> int:
        return min(level, self.depth)

    def centres(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return self.points[self.order[self.lo[self.at(level)][nodes]]]

    def reach(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return self.radius[self.at(level)][nodes]

    def members(self, nodes: np.ndarray) -> np.ndarray:
        """Points below nodes of the last level."""
        lo, n = self.lo[-1][nodes], (self.hi[-1] - self.lo[-1])[nodes]
        return self.order[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]


def near_nodes(a: CoverTree, b: CoverTree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of last-level nodes of two trees that may hold points within the threshold; of one tree, each pair once.

    Level by level, the children of every pair left are compared, and a pair goes if its centres are further apart than the
    threshold and both covering radii.
    """
    left, right = np.array([0]), np.array([0])
    for level in range(max(a.depth, b.depth)):
        if not len(left):
            break
        starts = np.flatnonzero(np.r_[True, np.diff(left) > 0])
        out_left, out_right = [], []
        for s, e in zip(starts, np.r_[starts[1:], len(left)]):
            mine, theirs = a.children(level, left[s:s + 1]), b.children(level, right[s:e])
            y, ry = b.centres(level + 1, theirs), b.reach(level + 1, theirs)
            for at in range(0, len(mine), ROWS):
                some = mine[at:at + ROWS]
                bound = a.reach(level + 1, some)[:, None] + ry[None, :] + (threshold + SLACK)
                close = distances(a.centres(level + 1, some), y) <= bound
                if a is b:
                    close &= theirs[None, :] >= some[:, None]
                i, j = np.nonzero(close)
                out_left.append(some[i])
                out_right.append(theirs[j])
        left, right = np.concatenate(out_left), np.concatenate(out_right)
        # Nodes of a tree that has ended keep their numbers, so pairs stay in order of the left node.
        by = np.lexsort((right, left))
        left, right = left[by], right[by]
    return left, right


class Forest:
    """Groups of points under links; a group's name is its smallest point."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if (up == root).all():
                self.parent[x] = root
                return root
            root = up

    def join(self, x: np.ndarray):
        roots = self.find(x)
        self.parent[roots] = roots.min()


def linked(a: CoverTree, b: CoverTree, cosine: float, weight_a: np.ndarray, weight_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, Forest]:
    """(weight of links per point of a, the same of b, groups of the points of a and then b) for pairs with at least the cosine.

    Of one tree, both results hold only part of each point's links; their sum is right.
    """
    n = len(a.points)
    of_a, of_b, forest = np.zeros(n, np.int64), np.zeros(len(b.points), np.int64), Forest(n + (0 if a is b else len(b.points)))
    shift = 0 if a is b else n
    left, right = near_nodes(a, b, float(np.sqrt(max(2 - 2 * cosine, 0))))
    starts = np.flatnonzero(np.r_[True, np.diff(left) > 0]) if len(left) else []
    for s, e in zip(starts, np.r_[starts[1:], len(left)] if len(left) else []):
        mine, theirs = a.members(left[s:s + 1]), b.members(right[s:e])
        own = len(a.members(left[s:s + 1])) if a is b and right[s] == left[s] else 0
        for at in range(0, len(mine), ROWS):
            some = mine[at:at + ROWS]
            hit = a.points[some] @ b.points[theirs].T >= cosine
            if own:
                # The node's own points come first on both sides: only later ones count.
                hit[:, :own] &= np.arange(own)[None, :] > np.arange(at, at + len(some))[:, None]
            of_a[some] += hit @ weight_b[theirs]
            of_b[theirs] += weight_a[some] @ hit
            for i in np.flatnonzero(hit.any(1)):
                forest.join(np.r_[some[i], theirs[hit[i]] + shift])
    return of_a, of_b, forest
