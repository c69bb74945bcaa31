"""Bounded blocks of vectors with a bound on the score that two blocks, or a query and a block, can reach.

Vectors are binned by their nearest pivot and the angle to it. Neighbouring rings of a pivot form a block
of about ``block_rows`` vectors; a ring holding more than that is split by hash into several blocks with
the same bounds, so no block, however popular its place, grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.arrow import unit_rows

RINGS = 1024  # of a pivot, while pivots are few
RING_CELLS = 1 << 20  # pivots x rings that are counted at most
MARGIN = 1e-8  # scores are compared at 9 decimals
COSINE_DIGITS = 9
SINGLE_ERROR = 4e-6  # between two scores of unit vectors in single precision
SCAN_ROWS, SCAN_COLUMNS = 256, 2048  # of the scores that are looked at together
SUM_CELLS = 1 << 18  # the same, of scores that are sums of two
EXACT_CELLS = 4_000_000  # scores in double precision that are held at once


def cosine_scores(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    return q @ s.T


def plane_scores(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Negated squared distance, so that higher is nearer."""
    dx = q[:, 0][:, None] - s[:, 0][None, :]
    dy = q[:, 1][:, None] - s[:, 1][None, :]
    return -(dx * dx + dy * dy)


def spread_hash(ids: np.ndarray) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(33)).astype(np.int64)


def ring_gap(low: np.ndarray, high: np.ndarray, own_low, own_high) -> np.ndarray:
    """The least difference between an angle in [low, high] and one in [own_low, own_high]."""
    return np.maximum(0, np.maximum(low - own_high, own_low - high))


@dataclass
class PlaneKernel:
    """Plane coordinates: negated squared distances, compared as they are."""

    scores = staticmethod(plane_scores)
    digits = None

    @staticmethod
    def prepare(m: np.ndarray) -> np.ndarray:
        return m


@dataclass
class AngleKernel:
    """Cosine, compared at 9 decimals."""

    scores = staticmethod(cosine_scores)
    prepare = staticmethod(unit_rows)
    digits = COSINE_DIGITS


@dataclass
class AngleBlocks(AngleKernel):
    """Blocks of vectors at angles [low, high] from their pivot. By the triangle inequality for angles, what
    lies in such a ring is no nearer to a query than the gap between the ring and the query's own angle to
    the pivot, and two rings are no nearer than the gap between one ring and the angles that the other one
    can have to its pivot. All of it is bounded by the number of blocks and of pivots."""

    pivots: np.ndarray = field(default=None)
    first: np.ndarray = None
    splits: np.ndarray = None
    group: np.ndarray = None
    low: np.ndarray = None
    high: np.ndarray = None
    rows: np.ndarray = None

    @property
    def rings(self) -> int:
        return int(max(64, min(RINGS, RING_CELLS // (len(self.pivots) + 1))))

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.pivots) + 1, self.rings  # last group: vectors too short to normalise

    @staticmethod
    def _short(m: np.ndarray) -> np.ndarray:
        return np.linalg.norm(m, axis=1) < 1 - 1e-6

    def bin_of(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sims = np.clip(m @ self.pivots.T, -1, 1)
        groups = sims.argmax(1)
        angles = np.arccos(sims[np.arange(len(m)), groups])
        bins = np.minimum((angles / np.pi * self.rings).astype(np.int64), self.rings - 1)
        short = self._short(m)
        return np.where(short, len(self.pivots), groups), np.where(short, 0, bins)

    def cut(self, counts: np.ndarray, block_rows: int) -> AngleBlocks:
        """These pivots with blocks for the ``counts`` of (group, ring)."""
        first, splits = np.full(counts.shape, -1, np.int64), np.ones(counts.shape, np.int64)
        blocks: list[tuple[int, int, int, int]] = []

        def close(g: int, run: list[int], total: int) -> None:
            parts = max(1, -(-total // block_rows)) if len(run) == 1 else 1
            first[g, run] = len(blocks)
            splits[g, run] = parts
            blocks.extend([(g, run[0], run[-1], -(-total // parts))] * parts)

        for g in range(counts.shape[0]):
            run, total = [], 0
            for b in np.flatnonzero(counts[g]):
                n = int(counts[g, b])
                if run and total + n > block_rows:
                    close(g, run, total)
                    run, total = [], 0
                run.append(int(b))
                total += n
            if run:
                close(g, run, total)
        group, low, high, rows = np.array(blocks, np.int64).reshape(-1, 4).T
        step = np.pi / self.rings
        return AngleBlocks(self.pivots, first, splits, group, low * step, (high + 1) * step, rows)

    def block_of(self, groups: np.ndarray, bins: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.first[groups, bins] + spread_hash(ids) % self.splits[groups, bins]

    def count(self) -> int:
        return len(self.group)

    def query_bound(self, q: np.ndarray, block: int) -> np.ndarray:
        """The highest score that each query can have in ``block``."""
        g = self.group[block]
        if g == len(self.pivots):
            return np.ones(len(q))
        angles = np.arccos(np.clip(q @ self.pivots[g], -1, 1))
        bound = np.cos(ring_gap(angles, angles, self.low[block], self.high[block])) + MARGIN
        return np.where(self._short(q), 1.0, bound)

    def block_bound(self, block: int, others: AngleBlocks) -> tuple[np.ndarray, np.ndarray]:
        """The highest score between ``block`` and every block of ``others``, and a guess at the score of
        their middles; both have the same pivots."""
        short, g = len(self.pivots), self.group[block]
        if g == short:
            return np.ones(others.count()), np.zeros(others.count())
        own_low, own_high = self.low[block], self.high[block]
        known = np.minimum(others.group, short - 1)
        between = np.arccos(np.clip(self.pivots @ self.pivots[g], -1, 1))
        between[g] = 0.0
        between = between[known]
        # the angle of anything in the block to the other pivot
        low = np.maximum(0, np.maximum(between - own_high, own_low - between))
        high = np.minimum(np.pi, between + own_high)
        bound = np.cos(ring_gap(low, high, others.low, others.high)) + MARGIN
        middle = np.hypot(between, (others.low + others.high - own_low - own_high) / 2)
        return np.where(others.group == short, 1.0, bound), np.where(others.group == short, 0.0, np.cos(np.minimum(middle, np.pi)))


def best_one(scores: np.ndarray, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Column and value of the best score of every row, compared at ``digits`` decimals, the first
    column on ties. Only the maximum is rounded: a cell ties with it from half a unit below."""
    at = scores.argmax(1)
    value = scores[np.arange(len(scores)), at]
    if digits is not None:
        value = np.round(value, digits)
        at = (scores >= (value - 0.5 * 10.0 ** -digits)[:, None]).argmax(1)
    return at, value


def best_k(scores: np.ndarray, ids: np.ndarray, k: int, floor: float = -np.inf,
           digits: int | None = None):
    """The ``k`` best columns of every row above ``floor``; ``ids`` ascend, so equal scores go
    to the lower id. Returns (row, id, score, rank)."""
    n, width = scores.shape
    if k == 1 and width:
        at, value = best_one(scores, digits)
        rows = np.flatnonzero(value > floor)
        return rows, ids[at[rows]], value[rows], np.ones(len(rows), np.int32)
    if width > k:
        worst = np.partition(scores, width - k, axis=1)[:, width - k]
        slack = 0.0 if digits is None else 10.0 ** -digits
        rows, at = np.nonzero(scores >= (worst - slack)[:, None])
    else:
        rows, at = np.nonzero(np.ones((n, width), bool))
    value = scores[rows, at]
    if digits is not None:
        value = np.round(value, digits)
    above = value > floor
    rows, at, value = rows[above], at[above], value[above]
    order = np.lexsort((at, -value, rows))
    rows, at, value = rows[order], at[order], value[order]
    starts = np.searchsorted(rows, np.arange(n))
    rank = np.arange(len(rows)) - starts[rows] + 1
    keep = rank <= k
    return rows[keep], ids[at[keep]], value[keep], rank[keep].astype(np.int32)


def mask_excluded(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, banned: np.ndarray) -> None:
    """Rule out the banned ids of each row; ``ids`` ascend."""
    at = np.searchsorted(ids, banned)
    inside = at < len(ids)
    inside[inside] = ids[at[inside]] == banned[inside]
    scores[rows[inside], at[inside]] = -np.inf


def two_best(q: np.ndarray, table: np.ndarray, rows: np.ndarray, places: np.ndarray):
    """(place, score, runner-up's score) of the best row of ``table`` for every query, in single precision and by
    blocks that stay in a core's cache; query ``rows`` may not have ``places``."""
    mine = np.arange(len(q))
    at, best = np.zeros(len(q), np.int64), np.full(len(q), -np.inf, np.float32)
    second = best.copy()
    for lo in range(0, len(table), SCAN_COLUMNS):
        scores = q @ table[lo: lo + SCAN_COLUMNS].T
        inside = (places >= lo) & (places < lo + scores.shape[1])
        scores[rows[inside], places[inside] - lo] = -np.inf
        column = scores.argmax(1)
        top = scores[mine, column]
        scores[mine, column] = -np.inf
        second = np.maximum(np.maximum(second, scores.max(1)), np.minimum(best, top))
        at = np.where(top > best, column + lo, at)
        best = np.maximum(best, top)
    return at, best, second


def places_of(ids: np.ndarray, rows: np.ndarray, banned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``ids``) of the banned ids of rows that are there; ``ids`` ascend."""
    at = np.searchsorted(ids, banned)
    there = at < len(ids)
    there[there] = ids[at[there]] == banned[there]
    return rows[there], at[there]


def best_in_single(q: np.ndarray, vectors: np.ndarray, rough: np.ndarray, ids: np.ndarray, rows: np.ndarray, banned: np.ndarray):
    """``best_one`` of unit queries at ``COSINE_DIGITS``, found in single precision (``rough``); queries whose best two scores
    are too close for that are done again in double. Query ``rows`` may not have the ids ``banned``."""
    at, best, second = two_best(q.astype(np.float32), rough, *places_of(ids, rows, banned))
    value = np.round(np.einsum("ij,ij->i", q, vectors[at]), COSINE_DIGITS)
    value[best == -np.inf] = -np.inf
    close = np.flatnonzero(~(best - second > SINGLE_ERROR))
    at[close], value[close] = best_in_double(q[close], vectors, ids, *of_rows(close, len(q), rows, banned))
    return at, value


def of_rows(some: np.ndarray, n: int, rows: np.ndarray, banned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, id) of the banned ids of ``some`` of ``n`` rows, counted among these."""
    row_of = np.full(n, -1)
    row_of[some] = np.arange(len(some))
    mine = row_of[rows] >= 0
    return row_of[rows[mine]], banned[mine]


def best_in_double(q: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, banned: np.ndarray):
    """``best_one`` of unit queries at ``COSINE_DIGITS``; query ``rows`` may not have the ids ``banned``."""
    at, value = np.zeros(len(q), np.int64), np.empty(len(q))
    step = max(1, EXACT_CELLS // max(1, len(ids)))
    for lo in range(0, len(q), step):
        some = np.arange(lo, min(lo + step, len(q)))
        exact = q[some] @ vectors.T
        mask_excluded(exact, ids, *of_rows(some, len(q), rows, banned))
        at[some], value[some] = best_one(exact, COSINE_DIGITS)
    return at, value


def unit_sums(f: np.ndarray, a: np.ndarray, fi: np.ndarray, ai: np.ndarray) -> np.ndarray:
    return unit_rows(unit_rows(f[fi] + a[ai]))


def sum_error(a: np.ndarray) -> np.ndarray:
    """``SINGLE_ERROR`` of scores that are sums of those of a unit vector and of a row of ``a``."""
    return (SINGLE_ERROR * (1 + np.linalg.norm(a, axis=1))).astype(np.float32)


def best_of_grid(f: np.ndarray, a: np.ndarray, table: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, score) of the best row at ``places`` of ``table`` for every row of ``a`` plus every row of ``f``, not normalised and in
    single precision: each part meets the table once, and their scores are added."""
    at, best = np.zeros((len(a), len(f)), np.int64), np.full((len(a), len(f)), -np.inf, np.float32)
    mine, width = np.arange(len(f)), max(SCAN_COLUMNS // 2, SUM_CELLS // max(1, len(f)))
    for lo in range(0, len(places), width):
        part = table[places[lo: lo + width]]
        own, other = f @ part.T, a @ part.T
        scores = np.empty_like(own)
        for j in range(len(a)):
            np.add(own, other[j], out=scores)
            column = scores.argmax(1)
            top = scores[mine, column]
            better = ~(top <= best[j])
            at[j, better], best[j, better] = places[column[better] + lo], top[better]
    return at, best


def two_best_sums(f: np.ndarray, a: np.ndarray, fi: np.ndarray, ai: np.ndarray, slack: np.ndarray, table: np.ndarray, rows: np.ndarray,
                  places: np.ndarray):
    """``two_best`` of the sums ``f[fi] + a[ai]``, not normalised: each part meets the table once, whatever the number of pairs.
    Runners-up are told as far as they are within ``slack`` of the best. Pair ``rows`` may not have ``places``."""
    n = len(fi)
    at, best = np.zeros(n, np.int64), np.full(n, -np.inf, np.float32)
    second = best.copy()
    order = np.argsort(rows, kind="stable")
    rows, places = rows[order], places[order]
    step = max(1, min(n, SUM_CELLS // 2 // SCAN_COLUMNS))
    width = max(SCAN_COLUMNS, SUM_CELLS // 2 // step)
    starts = np.arange(0, n, step)
    for lo in range(0, len(table), width):
        part = table[lo: lo + width]
        own, other = f @ part.T, a @ part.T
        inside = (places >= lo) & (places < lo + len(part))
        row, place = rows[inside], places[inside] - lo
        bounds = np.searchsorted(row, np.append(starts, n))
        held, added = np.empty((2, step, len(part)), np.float32)
        for start, first, last in zip(starts, bounds[:-1], bounds[1:], strict=True):
            some = slice(start, min(start + step, n))
            scores = np.take(own, fi[some], axis=0, out=held[: some.stop - start], mode="clip")
            scores += np.take(other, ai[some], axis=0, out=added[: some.stop - start], mode="clip")
            scores[row[first:last] - start, place[first:last]] = -np.inf
            column = scores.argmax(1)
            top = scores[np.arange(len(scores)), column]
            near = np.flatnonzero(~(top <= best[some] - slack[some]))
            if not len(near):
                continue
            others, column, top, to = scores[near], column[near], top[near], near + start
            others[np.arange(len(near)), column] = -np.inf
            second[to] = np.maximum(np.maximum(second[to], others.max(1)), np.minimum(best[to], top))
            at[to] = np.where(top > best[to], column + lo, at[to])
            best[to] = np.maximum(best[to], top)
    return at, best, second


def best_of_sums(f: np.ndarray, a: np.ndarray, fi: np.ndarray, ai: np.ndarray, vectors: np.ndarray, rough: np.ndarray, ids: np.ndarray,
                 rows: np.ndarray, banned: np.ndarray):
    """``best_in_single`` of the normalised sums ``f[fi] + a[ai]``: (place, whether there is one). Pair ``rows`` may not
    have the ids ``banned``."""
    slack = (sum_error(a)[ai] + sum_error(f)[fi])
    at, best, second = two_best_sums(f.astype(np.float32), a.astype(np.float32), fi, ai, slack, rough, *places_of(ids, rows, banned))
    there = best != -np.inf
    close = np.flatnonzero(~(best - second > slack))
    q = unit_sums(f, a, fi[close], ai[close])
    at[close], value = best_in_double(q, vectors, ids, *of_rows(close, len(fi), rows, banned))
    there[close] = value > -np.inf
    return at, there
