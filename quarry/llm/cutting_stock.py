"""The cutting-stock linear program by column generation, in NumPy: how often to use which pattern of piece lengths.

Minimise the number of sequences so that every length's pieces are covered.  A column is a pattern, a multiset of lengths
that fits a sequence.  The revised simplex method keeps the inverse of the basis; a knapsack dynamic program over the
dual prices finds the best patterns (one for each length that it must hold), and the simplex pivots among these until
none improves, when the knapsack prices anew.  The search ends within GAP of the bound that the prices prove.
The size of the problem depends on the sequence length only, never on the number of documents.
"""

from __future__ import annotations

import numpy as np

#: The search stops this close to the bound, or after so many pivots: what patterns don't cover well, the packer cuts.
GAP = 1e-3
PIVOTS = 400
EPS = 1e-9


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best value, last item) for every capacity from 0; item -1 leaves one unit unused."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    sizes, worth, cut = lengths[order], prices[order], np.searchsorted(lengths[order], np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if cut[c]:
            value = best[c - sizes[: cut[c]]] + worth[: cut[c]]
            k = int(value.argmax())
            if value[k] > best[c] + EPS:
                best[c], last[c] = value[k], order[k]
    return best, last


def _trace(last: np.ndarray, lengths: np.ndarray, c: int) -> list[int]:
    items = []
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            items.append(int(last[c]))
            c -= int(lengths[last[c]])
    return items


def first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Starting columns and their uses: the longest length left, filled up exactly by one, two or three others if that can be, else by the knapsack.

    Each column is used until one of its lengths is covered, so the columns form a triangular basis.
    """
    m = len(lengths)
    where = np.full(capacity + 1, -1)
    where[lengths] = np.arange(m)
    left = demand.astype(np.float64).copy()
    has = np.zeros(capacity + 1, bool)
    has[lengths] = True
    columns, uses, owner = [], [], np.full(m, -1)

    def two(rest: int) -> list[int] | None:
        pair = np.flatnonzero(has[: rest + 1] & has[rest::-1])
        return [int(pair[-1]), rest - int(pair[-1])] if len(pair) else None

    while has.any():
        longest = int(np.flatnonzero(has)[-1])
        rest = capacity - longest
        items = [longest]
        if rest:
            if has[rest]:
                items.append(rest)
            elif pair := two(rest):
                items += pair
            else:
                for a in np.flatnonzero(has[:rest])[::-1][:64]:
                    if pair := two(rest - int(a)):
                        items += [int(a), *pair]
                        break
                else:
                    sizes = np.flatnonzero(has)
                    _, last = knapsack(sizes / capacity, sizes, rest)
                    items += [int(sizes[k]) for k in _trace(last, sizes, rest)]
        column = np.bincount(where[items], minlength=m).astype(np.float64)
        at = np.flatnonzero(column)
        t = float((left[at] / column[at]).min())
        left[at] -= t * column[at]
        done = at[left[at] <= 1e-9 * np.maximum(1, demand[at])]
        left[done] = 0
        has[lengths[done]] = False
        owner[done[0]] = len(columns)
        columns.append(column)
        uses.append(t)
        for k in done[1:]:  # covered at the same time: a column of its own, not used
            owner[k] = len(columns)
            columns.append(np.bincount([k], minlength=m) * float(capacity // lengths[k]))
            uses.append(0.0)
    return np.stack(columns, 1), np.array(uses)


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns as rows of counts per length, how often each, lower bound) of the linear program; lengths distinct, demand positive."""
    m = len(lengths)
    if not m:
        return np.zeros((0, 0), np.int64), np.zeros(0), 0.0
    d = demand.astype(np.float64)
    basis, x = first_basis(lengths, d, capacity)  # columns are patterns
    inverse = np.linalg.inv(basis)
    cost = np.ones(m)
    bound = float(lengths @ d) / capacity
    pivots = 0
    while pivots < PIVOTS:
        prices = cost @ inverse
        best, last = knapsack(np.maximum(prices, 0), lengths, capacity)
        if best[capacity] > EPS and prices.min() > -1e-7:
            bound = max(bound, float(prices @ d) / max(1.0, best[capacity]))
        if x @ cost <= bound * (1 + GAP) or (best[capacity] <= 1 + 1e-7 and prices.min() > -1e-7):
            break
        pool = {tuple(sorted(_trace(last, lengths, capacity)))}
        worth = prices + best[capacity - lengths]
        for i in np.argsort(-worth)[: min(m, 400)]:
            if worth[i] > 1 + 1e-7:
                pool.add(tuple(sorted([int(i), *_trace(last, lengths, capacity - int(lengths[i]))])))
        columns = np.stack([np.bincount(p, minlength=m) if p else np.zeros(m, np.int64) for p in pool], 1).astype(np.float64)
        moved = False
        for _ in range(200):
            low = int(prices.argmin())
            gain = prices @ columns - 1
            k = int(gain.argmax())
            if prices[low] < -1e-7:
                column, c = np.zeros(m), 0.0
                column[low] = -1
            elif gain[k] > 1e-7:
                column, c = columns[:, k], 1.0
            else:
                break
            step = inverse @ column
            positive = step > 1e-9
            if not positive.any():
                break
            ratio = np.where(positive, np.maximum(x, 0) / np.where(positive, step, 1), np.inf)
            out = int(ratio.argmin())
            theta = ratio[out]
            x = x - theta * step
            x[out] = theta
            basis[:, out], cost[out] = column, c
            pivot_row = inverse[out] / step[out]
            prices = prices + (c - prices @ column) * pivot_row
            rows, cols = np.flatnonzero(np.abs(step) > 1e-13), np.flatnonzero(np.abs(pivot_row) > 1e-13)
            inverse[np.ix_(rows, cols)] -= np.outer(step[rows], pivot_row[cols])
            inverse[out] = pivot_row
            pivots += 1
            moved = True
            if pivots % 500 == 0:
                inverse = np.linalg.inv(basis)
                x = inverse @ d
        if not moved:
            break
    real = cost > 0
    return np.rint(basis[:, real]).astype(np.int64).T, np.maximum(x[real], 0), bound


def round_patterns(patterns: np.ndarray, times: np.ndarray, demand: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of uses of the ``usable`` patterns that never need more pieces than there are, and the demand that is left."""
    left = demand.astype(np.int64).copy()
    uses = np.zeros(len(patterns), np.int64)
    for whole in (np.floor(times + 1e-7), (times - np.floor(times + 1e-7) >= 0.5).astype(np.float64)):
        for j in np.argsort(-times, kind="stable"):
            at = np.flatnonzero(patterns[j])
            if len(at) and usable[j]:
                n = min(int(whole[j]), int((left[at] // patterns[j][at]).min()))
                uses[j] += n
                left[at] -= n * patterns[j][at]
    return uses, left
