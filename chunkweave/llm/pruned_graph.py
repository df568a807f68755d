"""A robust-pruned directed graph over unit vectors, built and searched in batches with numpy."""

from __future__ import annotations

import numpy as np


class PrunedGraph:
    """Nodes are the rows of ``x`` (unit float32). Each node keeps at most ``degree`` out-edges.

    Nodes enter in random order and in batches: a greedy beam search on the graph so far proposes
    neighbours, members of the same batch are proposed as well, and relaxed distance pruning (a candidate
    is dropped if ``alpha`` times its distance to a kept neighbour is at most its distance to the node)
    keeps the diverse ones. Reverse edges are added and over-full nodes are pruned again. Searches begin at
    the best few of the first ``pivots`` nodes, which are spread over the whole set by the random order.
    """

    def __init__(self, x: np.ndarray, degree: int = 16, beam: int = 24, alpha: float = 1.2, batch: int = 512, pivots: int = 1024, seed: int = 1) -> None:
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.degree, self.beam, self.alpha = degree, beam, alpha
        n = len(self.x)
        self.edges = np.full((n, degree), -1, np.int32)
        self._own = np.arange(n, dtype=np.int32)[:, None]
        self._hops = np.repeat(self._own, degree, axis=1)  # edges, with the node itself for missing ones
        self.entry = int(np.argmax(self.x @ self.x.mean(axis=0))) if n else 0
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        order = np.concatenate(([self.entry], order[order != self.entry])).astype(np.int32) if n else order
        self.pivots = order[:1]
        done = 1
        while done < n:
            size = min(batch, max(16, done), n - done)
            self._insert(order[done : done + size])
            done += size
            self.pivots = order[: min(done, pivots)]

    def _insert(self, new: np.ndarray) -> None:
        found, sims = self.search(self.x[new], self.beam)
        mates = self.x[new] @ self.x[new].T
        np.fill_diagonal(mates, -2)
        few = min(self.degree // 2, len(new) - 1)
        if few > 0:
            at = np.argpartition(-mates, few - 1, axis=1)[:, :few]
            found = np.concatenate([found, new[at]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(mates, at, 1)], axis=1)
        self.edges[new] = self._pruned(found, sims)
        src = np.repeat(new, self.degree)
        dst = self.edges[new].ravel()
        ok = dst >= 0
        self._add_reverse(dst[ok], src[ok])
        self._hops = np.where(self.edges < 0, self._own, self.edges)

    def _pruned(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Relaxed pruning of candidates per row; ids of -1 are empty."""
        order = np.argsort(-np.where(ids >= 0, sims, -3.0), axis=1, kind="stable")
        ids = np.take_along_axis(ids, order, 1)
        sims = np.take_along_axis(sims, order, 1)
        alive = ids >= 0
        vectors = self.x[np.maximum(ids, 0)]
        # hides[m, k, j]: if k is kept, j is too near to it.
        hides = np.matmul(vectors, vectors.transpose(0, 2, 1)) >= (1.0 - (1.0 - sims) / self.alpha)[:, None, :]
        kept = np.full((len(ids), self.degree), -1, np.int32)
        count = np.zeros(len(ids), np.int64)
        for k in range(ids.shape[1]):
            take = alive[:, k] & (count < self.degree)
            r = np.flatnonzero(take)
            if not len(r):
                continue
            kept[r, count[r]] = ids[r, k]
            count[r] += 1
            alive &= ~(hides[:, k] & take[:, None])
        return kept

    def _add_reverse(self, node: np.ndarray, new: np.ndarray) -> None:
        order = np.argsort(node, kind="stable")
        node, new = node[order], new[order]
        heads, first, counts = np.unique(node, return_index=True, return_counts=True)
        width = min(int(counts.max()), self.degree) if len(counts) else 0
        if not width:
            return
        within = np.arange(len(node)) - np.repeat(first, counts)
        if int(counts.max()) > width:  # keep the nearest ones of a node that many point to
            sim = np.einsum("kd,kd->k", self.x[node], self.x[new])
            order = np.lexsort((-sim, node))
            node, new = node[order], new[order]
        added = np.full((len(heads), width), -1, np.int32)
        row = np.repeat(np.arange(len(heads)), counts)
        ok = within < width
        added[row[ok], within[ok]] = new[ok]
        pool = np.concatenate([self.edges[heads], added], axis=1)
        old = self.edges[heads]
        twice = (added[:, :, None] == old[:, None, :]).any(axis=2)
        pool[:, self.degree :][twice] = -1
        room = (pool >= 0).sum(axis=1) <= self.degree
        if room.any():  # still fits: move the edges to the front
            front = np.argsort(pool[room] < 0, axis=1, kind="stable")[:, : self.degree]
            self.edges[heads[room]] = np.take_along_axis(pool[room], front, 1)
        full = ~room
        if full.any():
            ids = pool[full]
            sims = np.matmul(self.x[np.maximum(ids, 0)], self.x[heads[full]][:, :, None])[:, :, 0]
            self.edges[heads[full]] = self._pruned(ids, sims)

    def search(self, queries: np.ndarray, beam: int, width: int = 4, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once: ``(ids, similarities)`` of the ``beam`` best, best first; -1 pads.

        ``start``: one node per query to begin at instead of the best pivots.
        """
        q = np.ascontiguousarray(queries, dtype=np.float32)
        m, n = len(q), len(self.x)
        ids = np.full((m, beam), -1, np.int32)
        sims = np.full((m, beam), -2.0, np.float32)
        opened = np.ones((m, beam), bool)
        flat = np.zeros(m * n, bool)  # seen, by query and node
        if start is None:
            near = q @ self.x[self.pivots].T
            few = min(width, beam, len(self.pivots))
            at = np.argpartition(-near, few - 1, axis=1)[:, :few]
            first, first_sims = self.pivots[at], np.take_along_axis(near, at, 1)
        else:
            first = start.astype(np.int32)[:, None]
            first_sims = np.einsum("qd,qd->q", q, self.x[first[:, 0]])[:, None]
            few = 1
        ids[:, :few], sims[:, :few], opened[:, :few] = first, first_sims, False
        flat[(np.arange(m)[:, None] * n + first).ravel()] = True
        base = np.arange(m)[:, None] * n
        active = np.arange(m)
        while len(active):
            closed = np.where(opened[active], -3.0, sims[active])
            at = np.argpartition(-closed, width - 1, axis=1)[:, :width] if beam > width else np.tile(np.arange(beam), (len(active), 1))
            good = np.take_along_axis(closed, at, 1) > -2.5
            more = good.any(axis=1)
            active, at, good = active[more], at[more], good[more]
            if not len(active):
                break
            opened[active[:, None], at] = True
            node = ids[active[:, None], at]
            # A place without a node to open repeats one whose neighbours are all seen by then.
            node = np.where(good, node, node[np.arange(len(node)), good.argmax(axis=1)][:, None])
            near = self._hops.take(node, axis=0).reshape(len(active), -1).astype(np.int64)
            fresh_at = ~flat.take(near + base[active])
            # A node may be reached twice in one step.
            once = (near + base[: len(active)])[fresh_at]
            once.sort()
            if len(once):
                once = once[np.concatenate(([True], once[1:] != once[:-1]))]
            row = once // n
            node = (once - row * n).astype(np.int32)
            flat[active[row] * n + node] = True
            s = np.einsum("kd,kd->k", self.x.take(node, axis=0), q.take(active[row], axis=0))
            better = s > sims[active].min(axis=1)[row]  # the others can't enter the beam
            row, node, s = row[better], node[better], s[better]
            count = np.bincount(row, minlength=len(active))
            most = int(count.max()) if len(count) else 0
            if not most:
                continue
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            fresh = np.full((len(active), most), -2.0, np.float32)
            fresh_ids = np.full((len(active), most), -1, np.int32)
            fresh[row, place] = s
            fresh_ids[row, place] = node
            all_sims = np.concatenate([sims[active], fresh], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, best, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], fresh_ids], axis=1), best, 1)
            opened[active] = np.take_along_axis(np.concatenate([opened[active], fresh_ids < 0], axis=1), best, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
