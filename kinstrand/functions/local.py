"""Local alignments of pairs of residue sequences within a band, with affine gaps, and what a score is worth.

All pairs of a batch go together, an antidiagonal at a time; the best cell of each is walked back until the score is used up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from kinstrand.functions.alignment import Scoring

# Lambda and K of scores with BLOSUM62 and gaps of 11 + 1 for each letter.
LAMBDA, K = 0.267, 0.041
_DIAGONAL, _LEFT, _TOP, _MORE_LEFT, _MORE_TOP = 1, 2, 4, 8, 16


def evalue(score: float, query: int, letters: int) -> float:
    """Alignments of this score or more that chance gives between a query and ``letters`` letters (Karlin and Altschul)."""
    return K * query * letters * math.exp(-LAMBDA * score)


@dataclass
class Local:
    """Places are from 1, both ends included; nothing is found if ``score`` is 0."""

    score: int = 0
    matches: int = 0
    length: int = 0
    gaps: int = 0
    q_from: int = 0
    q_end: int = 0
    s_from: int = 0
    s_end: int = 0


def align(pairs: list[tuple[np.ndarray, np.ndarray, int]], scoring: Scoring, reach: int = 24) -> list[Local]:
    """The best local alignment of each (query, subject, diagonal) whose path stays within ``reach`` of the diagonal (place in the subject less place in the query)."""
    out: list[Local] = [Local()] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]))
    for begin in range(0, len(order), 128):
        part = order[begin : begin + 128]
        for i, found in zip(part, _some([pairs[i] for i in part], scoring, reach), strict=True):
            out[i] = found
    return out


def _some(pairs: list[tuple[np.ndarray, np.ndarray, int]], scoring: Scoring, reach: int) -> list[Local]:
    p, cells = len(pairs), 2 * reach + 1
    m, n = (np.array([len(x[k]) for x in pairs])[:, None] for k in (0, 1))
    left = np.array([d for _, _, d in pairs])[:, None] - reach
    rows = int(m.max())
    qs, ss = np.zeros((p, rows + 1), np.int64), np.zeros((p, int(n.max()) + 1), np.int64)
    for i, (q, s, _) in enumerate(pairs):
        qs[i, 1 : len(q) + 1], ss[i, 1 : len(s) + 1] = q, s
    low = -(1 << 30)
    opened, extend = -scoring.gap - scoring.extend, -scoring.extend
    whole = np.zeros((p, cells + 2), np.int64)  # the latest best score of each place of the band
    across, down = np.full((p, cells + 2), low), np.full((p, cells + 2), low)  # of those that end in a gap
    moves = np.zeros((p, rows + 1, cells), np.int8)
    best, at = np.zeros(p, np.int64), np.zeros((p, 2), np.int64)
    ids = np.arange(p)
    for step in range(2, 2 * rows + cells):
        begin, end = max(step % 2, step - 2 * rows), min(cells, step - 1)
        c = np.arange(begin, end, 2)
        if not len(c):
            continue
        before, own, after = (slice(begin + x, end + x, 2) for x in range(3))
        i = (step - c) // 2
        j = i + left + c
        live = (j > 0) & (j <= n) & (i <= m)
        s = scoring.matrix[qs[:, i], np.take_along_axis(ss, np.clip(j, 0, ss.shape[1] - 1), axis=1)]
        open_across, more_across = whole[:, before] - opened, across[:, before] - extend
        open_down, more_down = whole[:, after] - opened, down[:, after] - extend
        a, d = np.maximum(open_across, more_across), np.maximum(open_down, more_down)
        diagonal = whole[:, own] + s
        now = np.maximum(np.maximum(diagonal, 0), np.maximum(a, d))
        now, a, d = np.where(live, now, 0), np.where(live, a, low), np.where(live, d, low)
        how = np.where(now <= 0, 0, np.where(now == diagonal, _DIAGONAL, np.where(now == a, _LEFT, _TOP)))
        moves[:, i, c] = how | np.where(more_across > open_across, _MORE_LEFT, 0) | np.where(more_down > open_down, _MORE_TOP, 0)
        whole[:, own], across[:, own], down[:, own] = now, a, d
        k = np.argmax(now, axis=1)
        better = now[ids, k] > best
        best = np.where(better, now[ids, k], best)
        at[better] = np.stack([i[k], k * 2 + begin], axis=1)[better]
    return [_walk(*pairs[x][:2], int(left[x, 0]), moves[x], int(best[x]), *map(int, at[x])) for x in range(p)]


def _walk(q: np.ndarray, s: np.ndarray, left: int, moves: np.ndarray, score: int, i: int, c: int) -> Local:
    if not score:
        return Local()
    found = Local(score, q_end=i, s_end=i + left + c)
    state = 0  # in a gap: its direction
    while True:
        j, way = i + left + c, int(moves[i, c])
        if not state:
            if not way & (_DIAGONAL | _LEFT | _TOP):
                break
            if way & _DIAGONAL:
                found.q_from, found.s_from = i, j
                found.matches += int(q[i - 1] == s[j - 1])
                found.length += 1
                i -= 1
                if i == 0 or j == 1:
                    break
                continue
            state = way & (_LEFT | _TOP)
        found.length, found.gaps = found.length + 1, found.gaps + 1
        more = way & (_MORE_LEFT if state == _LEFT else _MORE_TOP)
        i, c = (i, c - 1) if state == _LEFT else (i - 1, c + 1)
        state = state if more else 0
    return found
