"""Edit distance over sequences of hashable symbols: bit-parallel for one pair (Python integers as bit vectors), by
furthest ends on diagonals for many pairs of numpy sequences at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Symbols compared in a step, and cells of diagonals that a batch of pairs holds.
STEP, CELLS = 8, 1 << 18


def _masks(pattern: Sequence) -> dict:
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    return peq


def _run(pattern: Sequence, text: Sequence, anywhere: bool) -> tuple[int, int]:
    """(distance, end): of the pattern to the whole text, or to its best substring and where that ends."""
    m = len(pattern)
    if not m:
        return (0, 0) if anywhere else (len(text), len(text))
    peq, full, top = _masks(pattern), (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        if not anywhere:
            ph |= 1
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if anywhere else (score, len(text))


def distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences."""
    return _run(a, b, False)[0]


def best_infix(pattern: Sequence, text: Sequence) -> tuple[int, int]:
    """Least distance of the pattern to any substring of the text, and the end of the first such substring."""
    return _run(pattern, text, True)


def _extended(words: np.ndarray, at: np.ndarray, to: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols from ``at`` and from ``to`` on are equal, ``most`` at most."""
    out = np.zeros(len(at), np.int64)
    live = np.flatnonzero(most > 0)
    live = live[words[at[live]] == words[to[live]]]
    out[live] = 1
    step = np.arange(STEP)
    while len(live := live[out[live] < most[live]]):
        i = (at[live] + out[live])[:, None] + step
        j = (to[live] + out[live])[:, None] + step
        same = np.minimum(np.logical_and.accumulate(words[i] == words[j], axis=1).sum(axis=1), most[live] - out[live])
        out[live] += same
        live = live[same == STEP]
    return out


def _within(words: np.ndarray, start: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Of pairs (x, y) of sequences whether k edits suffice, by the furthest end on each diagonal after 0, 1, ... edits."""
    ok, most = np.zeros(len(x), bool), int(k.max())
    left, sx, sy, nx, ny = np.arange(len(x)), start[x], start[y], n[x], n[y]
    apart = nx - ny
    reach = np.full((len(x), 2 * most + 3), -1, np.int64)  # diagonal d (place in x less place in y) at column d + most + 1
    for e in range(most + 1):
        low, high = most + 1 - e, most + 2 + e
        d = np.arange(-e, e + 1)
        at = np.maximum(np.maximum(reach[:, low:high], reach[:, low - 1 : high - 1]) + 1, reach[:, low + 1 : high + 1])
        at = np.minimum(at, np.minimum(nx[:, None], ny[:, None] + d))
        at[at < np.maximum(d, 0)] = -1
        row, col = np.nonzero((at >= 0) & (np.abs(apart[:, None] - d) <= (k - e)[:, None]))
        i = at[row, col]
        j = i - d[col]
        at[row, col] += _extended(words, sx[row] + i, sy[row] + j, np.minimum(nx[row] - i, ny[row] - j))
        reach[:, low:high] = at
        found = reach[np.arange(len(left)), apart + most + 1] >= nx
        ok[left[found]] = True
        stay = ~found & (k > e)
        if not stay.all():
            left, sx, sy, nx, ny, apart, k, reach = (v[stay] for v in (left, sx, sy, nx, ny, apart, k, reach))
        if not len(left):
            break
    return ok


def all_within(words: np.ndarray, bounds: np.ndarray, x: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the edit distance of sequences x[i] and y[i] of ``words`` is k[i] at most: many pairs at once, exact."""
    padded = np.concatenate([words, np.zeros(STEP, words.dtype)])
    start, n = bounds[:-1].astype(np.int64), np.diff(bounds).astype(np.int64)
    ok = np.zeros(len(x), bool)
    may = np.flatnonzero(np.abs(n[x] - n[y]) <= k)
    may = may[np.argsort(-k[may], kind="stable")]
    i = 0
    while i < len(may):
        part = may[i : i + max(1, CELLS // (2 * int(k[may[i]]) + 3))]
        ok[part] = _within(padded, start, n, x[part], y[part], k[part])
        i += len(part)
    return ok
