"""Hierarchical navigable small-world graph of one shard, kept as flat neighbour arrays.

Layers are nested samples of the nodes (one in ``THIN``), the top one so small that it is read whole; every other layer
has a neighbour array of its own. A search enters each layer at the nodes it found in the one above and walks along
the neighbour array, best first, keeping a beam; all queries advance together. The graph is bulk-loaded from the top:
the nodes of a layer are handed to the nodes of the layer above that a search for them finds, and linked to the
closest of those that were handed to the same ones. Links are made mutual.
"""

from __future__ import annotations

import numpy as np

#: One node in THIN rises a layer; nodes of the top layer at most; links of a node; nearest upper nodes a node is handed
#: to; candidates kept of those; links chosen on an upper layer; queries in step.
THIN, TOP, LINKS, HANDED, SEEDS, ABOVE, STEP = 16, 64, 16, 8, 24, 32, 2048
#: Walking an upper layer: candidates kept, expanded in a round, nodes by which the layer is entered, rounds, and the
#: similarity under which a node leads nowhere.
KEPT, BEAM, ENTER, ROUNDS, UNLIKE = 24, 6, 8, 4, 0.0
_ID = (1 << 24) - 1


def _pack(row: np.ndarray, sim: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Sortable keys: by row, then falling similarity (about 6 decimals), then column."""
    far = np.clip((1.0 - sim) * 500_000, 0, (1 << 20) - 1).astype(np.uint64)
    return (row.astype(np.uint64) << np.uint64(44)) | (far << np.uint64(24)) | col.astype(np.uint64)


def _first(keys: np.ndarray, rows: int, k: int) -> np.ndarray:
    """The first ``k`` different columns of every row of packed keys, -1 where there are fewer."""
    return _best(keys, rows, k)[0]


def _best(keys: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``_first`` and the keys of what it took."""
    keys = np.sort(keys)
    if len(keys) > 1:
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    row, col = (keys >> np.uint64(44)).astype(np.int64), (keys & np.uint64(_ID)).astype(np.int32)
    start = np.searchsorted(row, np.arange(rows))
    place = np.arange(len(row)) - start[row]
    out = np.full((rows, k), -1, np.int32)
    keep = place < k
    out[row[keep], place[keep]] = col[keep]
    return out, keys[keep]


class Graph:
    """``x``: unit vectors as float32 rows. At most 2**20 of them (a shard)."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = x
        n = len(x)
        rank = np.random.default_rng(seed).permutation(n)
        self.layers: list[np.ndarray] = [np.arange(n)]
        while len(self.layers[-1]) > TOP:
            last = self.layers[-1]
            self.layers.append(np.sort(last[np.argsort(rank[last], kind="stable")[: max(1, len(last) // THIN)]]))
        #: For each layer but the top one: its vectors, its neighbour array and the places of the next upper layer's nodes in it.
        self.vectors = [x, *(x[nodes] for nodes in self.layers[1:])]
        self.links: list[np.ndarray] = [np.empty((0, LINKS), np.int32)] * len(self.layers)
        self.down = [np.searchsorted(low, up).astype(np.int32) for low, up in zip(self.layers, self.layers[1:])]
        self.seeds: np.ndarray | None = None
        self.children: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.zeros(1, np.int64))
        for depth in range(len(self.layers) - 2, -1, -1):
            handed = self._descend(self.vectors[depth], depth + 1)
            order = np.argsort(handed[:, 0], kind="stable")
            self.children = order, np.searchsorted(handed[order, 0], np.arange(len(self.layers[depth + 1]) + 1))
            self._link(depth, handed)

    def _descend(self, q: np.ndarray, depth: int, k: int = HANDED) -> np.ndarray:
        """Places, within layer ``depth``, of the ``k`` nodes nearest to each query, best first."""
        x = self.vectors[depth]
        k = min(k, len(x))
        if depth == len(self.layers) - 1:
            out = np.empty((len(q), k), np.int32)
            for s in range(0, len(q), STEP):
                sim = q[s:s + STEP] @ x.T
                part = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(k), (len(sim), 1))
                best = np.argsort(-np.take_along_axis(sim, part, 1), axis=1, kind="stable")
                out[s:s + STEP] = np.take_along_axis(part, best, 1)
            return out
        # Walk: in each round the best candidates not yet expanded are, all queries that expand one node together.
        links = self.links[depth]
        ways = links.ravel(), np.arange(len(links) + 1) * links.shape[1]
        opened = self.down[depth][self._descend(q, depth + 1, ENTER)]
        row = np.repeat(np.arange(len(q)), opened.shape[1])
        keys = _pack(row, np.einsum("id,ijd->ij", q, x[opened]).ravel(), opened.ravel())
        cand, fresh = opened, opened
        for _ in range(ROUNDS):
            keys = np.concatenate([keys, self._scan(depth, q, fresh, UNLIKE, ways)])
            cand, keys = _best(keys, len(q), max(k, KEPT))
            best = cand[:, :BEAM]
            fresh = np.where((best[:, :, None] == opened[:, None, :]).any(2), -1, best)
            opened = np.concatenate([opened, fresh], 1)
        out = cand[:, :k]
        return np.where(out < 0, out[:, :1], out)

    def _scan(self, depth: int, q: np.ndarray, handed: np.ndarray, floor: float = -2.0, ways: tuple | None = None) -> np.ndarray:
        """Packed (query, similarity, place) of the nodes of layer ``depth`` that were handed to the given upper nodes, or to
        which the given nodes' links (``ways``) lead."""
        (order_of, bounds), x = ways or self.children, self.vectors[depth]
        flat, row = handed.ravel(), np.repeat(np.arange(len(handed)), handed.shape[1])
        order = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[order], np.arange(len(bounds)))
        keys = []
        for u in np.nonzero(cuts[1:] > cuts[:-1])[0]:
            kids = order_of[bounds[u]:bounds[u + 1]]
            kids = kids[kids >= 0]
            if not len(kids):
                continue
            for s in range(cuts[u], cuts[u + 1], STEP):
                rows = row[order[s:min(cuts[u + 1], s + STEP)]]
                sim = q[rows] @ x[kids].T
                a, b = np.nonzero(sim > floor)
                keys.append(_pack(rows[a], sim[a, b], kids[b]))
        return np.concatenate(keys) if keys else np.empty(0, np.uint64)

    def _link(self, depth: int, handed: np.ndarray) -> None:
        x = self.vectors[depth]
        keys = self._scan(depth, x, handed)
        row, col = (keys >> np.uint64(44)).astype(np.int64), (keys & np.uint64(_ID)).astype(np.int64)
        seeds = _first(keys[row != col], len(x), SEEDS if depth == 0 else 2 * ABOVE)
        near = self._spread(x, seeds) if depth else seeds[:, :LINKS]
        # Mutual links: half of a node's places for its own choice, the rest for the closest that chose it too.
        a, b = np.nonzero(near >= 0)
        dst = near[a, b]
        sim = np.einsum("ij,ij->i", x[a], x[dst])
        back = _first(np.concatenate([_pack(a, sim, dst), _pack(dst, sim, a)]), len(x), LINKS)
        # Above, a node keeps its own spread links beside the closest that chose it.
        self.links[depth] = back if depth == 0 else np.concatenate([near, back], 1)
        if depth == 0:
            self.seeds = seeds  # where a node's own search begins

    def _spread(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of every node's candidates, nearest first, those that no chosen one is closer to than the node is: links that lead
        out of dense places. What places are left over go to the nearest others."""
        out = np.full((len(near), ABOVE), -1, np.int32)
        for s in range(0, len(near), 256):
            c = near[s:s + 256]
            y = x[np.maximum(c, 0)]
            sim = np.where(c >= 0, np.einsum("id,ijd->ij", x[s:s + 256], y), -3)
            between = y @ y.transpose(0, 2, 1)
            open_, chosen = c >= 0, np.zeros(c.shape, bool)
            for j in range(c.shape[1]):
                take = open_[:, j] & (chosen.sum(1) < ABOVE)
                chosen[take, j] = True
                open_[take] &= between[take, j] <= sim[take]
            order = np.argsort(np.where(chosen, 0, np.where(c >= 0, 1, 2)), axis=1, kind="stable")[:, :ABOVE]
            got = np.take_along_axis(c, order, 1)
            out[s:s + 256, : got.shape[1]] = got
        return out

    def neighbours(self, k: int, ef: int = SEEDS, beam: int = 6, rounds: int = 8, floor: float = -1.0) -> np.ndarray:
        """``search`` for all nodes themselves, without themselves, from where linking found them."""
        if self.seeds is None:
            found = self.search(self.x, k + 1)
            rest = np.where(found == np.arange(len(found))[:, None], -1, found)
            order = np.argsort(rest < 0, axis=1, kind="stable")
            return np.take_along_axis(rest, order, 1)[:, :k]
        return self.search(self.x, k, ef, beam, rounds, floor, self.seeds)

    def search(self, q: np.ndarray, k: int, ef: int = SEEDS, beam: int = 6, rounds: int = 8, floor: float = -1.0, seeds: np.ndarray | None = None) -> np.ndarray:
        """The ``k`` nodes nearest to each query (positions, -1 where there are fewer), best first.

        ``ef`` candidates are kept, the best ``beam`` unexpanded ones are expanded in a round, and a query
        rests when all its candidates are expanded. Candidates under similarity ``floor`` are not expanded.
        """
        n, out = len(self.x), np.full((len(q), k), -1, np.int32)
        if not n or not len(q):
            return out
        entered = self._descend(q, 0, ef) if seeds is None and len(self.layers) > 1 else None
        for s in range(0, len(q), STEP):
            qs = q[s:s + STEP]
            if len(self.layers) == 1:
                sim = qs @ self.x.T
                a, b = np.nonzero(sim > -2)
                out[s:s + STEP] = _first(_pack(a, sim[a, b], b), len(qs), k)
                continue
            if seeds is None:
                cand = self._walk(qs, 0, entered[s:s + STEP], beam, rounds, floor)
            else:
                cand = self._walk(qs, 0, seeds[s:s + STEP, :ef].copy(), beam, rounds, floor, s)
            out[s:s + STEP, :min(k, ef)] = cand[:, :k]
        return out

    def _walk(self, qs: np.ndarray, depth: int, cand: np.ndarray, beam: int, rounds: int, floor: float, own: int | None = None) -> np.ndarray:
        """The candidates after walking along the neighbour array of layer ``depth``, best first. ``own``: the queries are the
        nodes from that one on, which are not to find themselves."""
        x, links, ef = self.vectors[depth], self.links[depth], cand.shape[1]
        known = np.where(cand >= 0, np.einsum("id,ijd->ij", qs, x[np.maximum(cand, 0)]), -3).astype(np.float32)
        order = np.argsort(-known, axis=1, kind="stable")
        cand, known = np.take_along_axis(cand, order, 1), np.take_along_axis(known, order, 1)
        same = np.concatenate([np.zeros((len(cand), 1), bool), cand[:, 1:] == cand[:, :-1]], 1)
        cand[same], known[same] = -1, -3
        done = np.zeros(cand.shape, bool)
        live = np.arange(len(qs))
        for _ in range(rounds):
            openings = (cand[live] >= 0) & ~done[live] & (known[live] >= floor)
            some = openings.any(1)
            live, openings = live[some], openings[some]
            if not len(live):
                break
            pick = openings & (np.cumsum(openings, 1) <= beam)
            done[live] |= pick
            a, b = np.nonzero(pick)
            nxt = links[cand[live[a], b]]
            row = np.repeat(live[a], links.shape[1])
            nxt = nxt.ravel()
            fresh = nxt >= 0
            pair = np.unique(row[fresh].astype(np.int64) << 24 | nxt[fresh])
            row, nxt = pair >> 24, pair & _ID
            # Leave out what is a candidate already.
            a, b = np.nonzero(cand[live] >= 0)
            old = np.sort(live[a].astype(np.int64) << 24 | cand[live[a], b])
            at = np.minimum(np.searchsorted(old, pair), len(old) - 1)
            new = old[at] != pair
            if own is not None:
                new &= row + own != nxt
            row, nxt = row[new], nxt[new]
            sim = np.einsum("ij,ij->i", qs[row], x[nxt])
            good = sim > known[row].min(1)
            row, nxt, sim = row[good], nxt[good], sim[good]
            if not len(row):
                continue
            # Merge the new ones into the kept candidates, carrying what is expanded.
            touched = np.unique(row)
            pos = np.searchsorted(touched, row)
            place = np.arange(len(row)) - np.searchsorted(row, touched)[pos]
            width = int(place.max()) + 1
            c = np.full((len(touched), width), -1, np.int32)
            v = np.full((len(touched), width), -3, np.float32)
            c[pos, place], v[pos, place] = nxt, sim
            c = np.concatenate([cand[touched], c], 1)
            v = np.concatenate([known[touched], v], 1)
            d = np.concatenate([done[touched], np.zeros((len(touched), width), bool)], 1)
            order = np.argsort(-v, axis=1, kind="stable")[:, :ef]
            cand[touched], known[touched], done[touched] = (np.take_along_axis(z, order, 1) for z in (c, v, d))
        return cand
