"""A ball tree over sparse integer vectors for exact inner-product search.

A node holds a run of vectors, a centre c and the radius R of a ball around it that holds them all. For any query q and
vector x of the node, q·x = q·c + q·(x − c) ≤ q·c + |q| R. Centres and radii are doubles; every bound is widened by more
than the error that rounding can cause, so a subtree is passed over only if none of its vectors can reach the
score sought. Scores are sums of 64-bit integers, taken at the leaves, and have no error.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

LEAF = 48
#: relative widening of squares and products: sums of n doubles err by n · 2⁻⁵³, n is far below 10⁶
SLACK = 1e-9


class BallTree:
    """Vectors as rows (indptr, columns, values) over columns 0 … width − 1; values are not negative."""

    def __init__(self, indptr: np.ndarray, columns: np.ndarray, values: np.ndarray, leaf: int = LEAF):
        # only the columns that occur take part, so that centres are no wider than the vectors need
        self.used, local = np.unique(columns, return_inverse=True)
        self.indptr, self.columns, self.values = indptr, local.astype(np.int64), values
        self.order = np.arange(len(indptr) - 1)
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        centres, radii = [], []
        squares = self._per_row(values.astype(np.float64) ** 2)
        todo = [(0, len(self.order), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.spans)
            if parent >= 0:
                both = list(self.children[parent])
                both[side] = node
                self.children[parent] = (both[0], both[1])
            self.spans.append((a, b))
            self.children.append((-1, -1))
            rows = self.order[a:b]
            entries, owner = self._entries(rows)
            centre = np.bincount(self.columns[entries], self.values[entries], len(self.used)) / max(1, b - a)
            norm = float(centre @ centre)
            away = squares[rows] - 2 * np.bincount(owner, self.values[entries] * centre[self.columns[entries]], b - a) + norm
            away = np.maximum(away, 0) + SLACK * (squares[rows] + norm)
            centres.append(centre)
            radii.append(float(np.sqrt(away.max(initial=0.0))) * (1 + SLACK))
            if b - a > leaf:
                # halves along the line between two far vectors
                far = rows[int(np.argmax(away))]
                to_far = np.bincount(owner, self.values[entries] * self._dense(far)[self.columns[entries]], b - a)
                other = rows[int(np.argmax(squares[rows] + squares[far] - 2 * to_far))]
                side_of = to_far - np.bincount(owner, self.values[entries] * self._dense(other)[self.columns[entries]], b - a)
                self.order[a:b] = rows[np.argsort(side_of, kind="stable")]
                middle = (a + b) // 2
                todo += [(a, middle, node, 0), (middle, b, node, 1)]
        self.centres = np.array(centres).reshape(len(centres), len(self.used))
        self.radii = np.array(radii)
        # entries in the order of the leaves, so that a leaf is one slice
        entries, _ = self._entries(self.order)
        sizes = np.diff(indptr)[self.order]
        self.leaf_ptr = np.concatenate(([0], np.cumsum(sizes)))
        self.leaf_columns, self.leaf_values = self.columns[entries], self.values[entries]
        self.scored = 0

    def _per_row(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr)), x, len(self.indptr) - 1)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some rows, and for each the place of its row in `rows`."""
        sizes = self.indptr[rows + 1] - self.indptr[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        ahead = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(rows) else np.zeros(0, np.int64)
        return np.arange(len(owner)) - ahead[owner] + self.indptr[rows][owner], owner

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(len(self.used))
        at = slice(self.indptr[row], self.indptr[row + 1])
        out[self.columns[at]] = self.values[at]
        return out

    def bounds(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores inside each node, for a query over local columns."""
        w = weights.astype(np.float64)
        middle = self.centres[:, columns] @ w
        reach = np.sqrt(float(w @ w)) * self.radii
        return middle + reach + SLACK * (np.abs(middle) + reach) + 1e-3

    def search(self, columns: np.ndarray, weights: np.ndarray, least, found) -> None:
        """Visit leaves best-first: `found(rows, scores)` gets each leaf's positive scores, `least()` the score sought.

        Nodes whose bound lies below `least()` hold no row with that score; equal scores are looked at.
        """
        # columns of the query that occur here; all others add nothing to any score
        at = np.searchsorted(self.used, columns)
        inside = at < len(self.used)
        inside[inside] = self.used[at[inside]] == columns[inside]
        columns, weights = at[inside], weights[inside]
        if not len(columns):
            return
        bound = self.bounds(columns, weights)
        dense = np.zeros(len(self.used), np.int64)
        dense[columns] = weights
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heappop(heap)
            if -top < least():
                return
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= least():
                        heappush(heap, (-bound[child], child))
                continue
            a, b = self.spans[node]
            self.scored += b - a
            lo, hi = self.leaf_ptr[a], self.leaf_ptr[b]
            sums = np.zeros(hi - lo + 1, np.int64)
            np.cumsum(dense[self.leaf_columns[lo:hi]] * self.leaf_values[lo:hi], out=sums[1:])
            score = sums[self.leaf_ptr[a + 1 : b + 1] - lo] - sums[self.leaf_ptr[a:b] - lo]
            hit = np.flatnonzero((score > 0) & (score >= least()))
            if len(hit):
                found(self.order[a:b][hit], score[hit])
