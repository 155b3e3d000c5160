"""Block-max inverted index over a bounded set of entries (labelled examples, test items).

Entries are dealt to blocks of consecutive entries. A term's postings lie in runs, one for each block that holds
the term, with the largest weight of the run; a query's upper bound for a block is the sum of the maxima of its runs there.
Blocks are scored exactly in descending order of their bounds until no remaining bound can matter, so results equal
exhaustive scoring. Memory is linear in the postings: a rare term costs the few runs that it has.
"""

from __future__ import annotations

import numpy as np


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (first, length), one after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


class BlockMaxIndex:
    def __init__(self, entry: np.ndarray, term: np.ndarray, weight: np.ndarray, n_entries: int, n_terms: int, block: int, order: np.ndarray | None = None):
        """Postings as three parallel arrays; (entry, term) pairs are distinct and weights positive.

        order: the entries in the order in which ``top`` deals them to blocks (entries of like weights together make
        tighter bounds); results don't depend on it. ``above`` is for indexes in the order of the entries.
        """
        self.n_entries, self.block = n_entries, block
        self.n_blocks = max(1, -(-n_entries // block))
        self.number = np.arange(n_entries) if order is None else order
        if order is not None:
            entry = np.argsort(order)[entry]
        key = term.astype(np.int64) * self.n_blocks + entry // block
        order = np.lexsort((entry, key))
        key, self.entry, self.weight = key[order], entry[order].astype(np.int32), weight[order].astype(np.float64)
        runs, first = np.unique(key, return_index=True)
        self.run_start = np.append(first, len(key)).astype(np.int64)
        self.run_block = (runs % self.n_blocks).astype(np.int32)
        # rounded up, so that the bounds hold for the sums of the exact weights
        most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.run_most = np.nextafter(most.astype(np.float32), np.float32(np.inf))
        self.term_start = np.searchsorted(runs, np.arange(n_terms + 1, dtype=np.int64) * self.n_blocks)

    def _runs(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of the query's terms, with the query's weight of each."""
        first = self.term_start[terms]
        n = self.term_start[terms + 1] - first
        return spread(first, n), np.repeat(np.asarray(weights, float), n)

    def _bounds(self, runs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.run_block[runs], self.run_most[runs] * weights, minlength=self.n_blocks) * (1 + 1e-9)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Upper bound of the score of any entry, by block."""
        return self._bounds(*self._runs(terms, weights))

    def _score(self, blocks: np.ndarray, runs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of all entries of the blocks, in an array over all entries."""
        wanted = np.zeros(self.n_blocks, bool)
        wanted[blocks] = True
        has = wanted[self.run_block[runs]]
        first = self.run_start[runs[has]]
        n = self.run_start[runs[has] + 1] - first
        rows = spread(first, n)
        return np.bincount(self.entry[rows], self.weight[rows] * np.repeat(weights[has], n), minlength=self.n_entries)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, at_once: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of largest positive score, ties by entry number; exact. Each round scores twice the blocks of the last."""
        runs, w = self._runs(terms, weights)
        ub = self._bounds(runs, w)
        order = np.argsort(-ub, kind="stable")
        best, scores, at = np.zeros(0, np.int64), np.zeros(0), 0
        while at < len(order):
            blocks = order[at : at + at_once]
            at, at_once = at + at_once, 2 * at_once
            floor = scores[-1] if len(best) == k else 0.0
            blocks = blocks[(ub[blocks] >= floor) & (ub[blocks] > 0)]
            if not len(blocks):
                break
            found = self._score(blocks, runs, w)
            ids = np.flatnonzero(found > floor) if len(best) < k else np.flatnonzero(found >= floor)
            ids = ids[found[ids] > 0]
            best, scores = np.concatenate([best, ids]), np.concatenate([scores, found[ids]])
            keep = np.lexsort((self.number[best], -scores))[:k]
            best, scores = best[keep], scores[keep]
        return self.number[best], scores

    def above(self, terms: np.ndarray, weights: np.ndarray, floors: np.ndarray, block_floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All entries whose score reaches their own floor; block_floor is the least floor in each block."""
        runs, w = self._runs(terms, weights)
        blocks = np.flatnonzero(self._bounds(runs, w) >= block_floor)
        if not len(blocks):
            return np.zeros(0, np.int64), np.zeros(0)
        found = self._score(blocks, runs, w)
        ids = np.flatnonzero(found >= floors)
        return ids, found[ids]

    def least_by_block(self, floors: np.ndarray) -> np.ndarray:
        padded = np.full(self.n_blocks * self.block, np.inf)
        padded[: self.n_entries] = floors
        return padded.reshape(self.n_blocks, self.block).min(axis=1)
