"""BK-trees over 64-bit fingerprints, as flat arrays; many small trees live in one forest.

A node's children are keyed by their integer Hamming distance to it. A query within ``radius`` of a
node at distance d can only have matches under the children keyed d - radius to d + radius, so the
search follows just these edges. Building and searching go level by level over all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

KEYS = 65  # Hamming distances 0 to 64
FRONTIER = 1 << 21  # (query, node) pairs looked at together, about


class BKForest:
    def __init__(self, values: np.ndarray, tree: np.ndarray):
        """``values``: unsigned 64-bit, distinct within a tree; ``tree``: the tree of each, ascending."""
        n = len(values)
        self.values, self.tree = values, tree
        first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, n])
        self.root = np.repeat(first, sizes)
        self.size = np.repeat(sizes, sizes)
        edges, nodes = [], []
        at = self.root.copy()
        waiting = np.flatnonzero(np.arange(n) != self.root)
        while waiting.size:
            key = at[waiting] * KEYS + np.bitwise_count(values[waiting] ^ values[at[waiting]])
            key, child, where = np.unique(key, return_index=True, return_inverse=True)
            edges.append(key)
            nodes.append(waiting[child])
            at[waiting] = waiting[child][where]
            waiting = waiting[np.isin(waiting, waiting[child], invert=True, assume_unique=True)]
        keys = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.edge_keys = keys[order]  # parent * KEYS + distance
        self.edge_nodes = np.concatenate(nodes)[order] if nodes else np.zeros(0, np.int64)

    def near(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs of values within ``radius`` in one tree, query > node, in blocks."""
        n = len(self.values)
        ends = np.cumsum(self.size)
        start = 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + FRONTIER)))
            query = np.arange(start, min(stop, n))
            node = self.root[query]
            while query.size:
                d = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                hit = (d <= radius) & (node < query)
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.edge_keys, node * KEYS + np.maximum(d - radius, 0))
                high = np.searchsorted(self.edge_keys, node * KEYS + np.minimum(d + radius, KEYS - 1), "right")
                many = high - low
                query = np.repeat(query, many)
                shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                node = self.edge_nodes[np.repeat(low, many) + shift]
            start = stop

    def groups(self, radius: int) -> np.ndarray:
        """Per value the index of the first value of its tree that a chain of matches reaches."""
        label = np.arange(len(self.values))
        for a, b in self.near(radius):
            while True:
                la, lb = label[a], label[b]
                apart = la != lb
                if not apart.any():
                    break
                a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
                least = np.minimum(la, lb)
                np.minimum.at(label, np.maximum(la, lb), least)
                while True:
                    up = label[label]
                    if (up == label).all():
                        break
                    label = up
        return label
