"""Linear-chain conditional random fields on long chains, in NumPy.

Many chains lie one after another in one array; where a chain begins, the transition from the
entry before is replaced by the start weights, which makes the chains independent. Forward-backward
runs in lock step over blocks of entries: first each block's transfer matrix, then the messages at
block borders, then those inside the blocks. The result is exact for chains of any length."""

from __future__ import annotations

import numpy as np


def _blocks(x: np.ndarray, size: int, fill) -> np.ndarray:
    n = len(x)
    m = -(-n // size)
    out = np.full((m * size, *x.shape[1:]), fill, x.dtype)
    out[:n] = x
    return out.reshape(m, size, *x.shape[1:])


def forward_backward(score: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray, size: int = 64):
    """Marginals (n x labels), and the sums of pair marginals (labels x labels) and of start
    marginals. ``score``: log emission scores; ``first``: whether a chain begins at an entry;
    ``transition`` and ``start``: log weights."""
    n, k = score.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k)), np.zeros(k)
    e = np.exp(score - score.max(axis=1, keepdims=True))
    t, s = np.exp(transition - transition.max()), np.exp(start - start.max())
    first = first.copy()
    first[0] = True
    eb, fb = _blocks(e, size, 1.0), _blocks(first, size, True)
    m = len(eb)
    p = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for i in range(size):
        new = fb[:, i]
        q = (p.reshape(m * k, k) @ t).reshape(m, k, k)
        if new.any():
            q[new] = p[new].sum(axis=2, keepdims=True) * s
        q *= eb[:, i][:, None, :]
        p = q / q.sum(axis=(1, 2), keepdims=True)
    alpha, beta = np.empty((m, k)), np.empty((m, k))
    a = np.full(k, 1.0 / k)
    for b in range(m):
        alpha[b] = a
        a = a @ p[b]
        a /= a.sum()
    z = np.full(k, 1.0 / k)
    for b in range(m - 1, -1, -1):
        beta[b] = z
        z = p[b] @ z
        z /= z.sum()
    before, behind = np.empty((m, size, k)), np.empty((m, size, k))
    for i in range(size):  # before[i]: message into entry i without its emission
        c = alpha @ t
        new = fb[:, i]
        if new.any():
            c[new] = s
        before[:, i] = c
        alpha = c * eb[:, i]
        alpha /= alpha.sum(axis=1, keepdims=True)
    for i in range(size - 1, -1, -1):
        behind[:, i] = beta
        x = beta * eb[:, i]
        beta = x @ t.T
        new = fb[:, i]
        if new.any():
            beta[new] = 1.0
        beta /= beta.sum(axis=1, keepdims=True)
    before, behind = before.reshape(-1, k)[:n], behind.reshape(-1, k)[:n]
    g = before * e * behind
    g /= g.sum(axis=1, keepdims=True)
    follow = np.flatnonzero(~first[1:])
    here = before[follow] * e[follow]
    then = e[follow + 1] * behind[follow + 1]
    total = ((here @ t) * then).sum(axis=1)
    pair = t * ((here / total[:, None]).T @ then)
    return g, pair, g[first].sum(axis=0)


def viterbi(score: np.ndarray, transition: np.ndarray, start: np.ndarray) -> list[int]:
    """Best labels of one chain (ties: the smaller label)."""
    n, k = score.shape
    if not n:
        return []
    rows, trans = score.tolist(), transition.tolist()
    best = [start[j] + rows[0][j] for j in range(k)]
    back = []
    for row in rows[1:]:
        step, from_ = [], []
        for j in range(k):
            top, at = best[0] + trans[0][j], 0
            for i in range(1, k):
                x = best[i] + trans[i][j]
                if x > top:
                    top, at = x, i
            step.append(top + row[j])
            from_.append(at)
        back.append(from_)
        best = step
    label = max(range(k), key=lambda j: (best[j], -j))
    out = [label]
    for from_ in reversed(back):
        label = from_[label]
        out.append(label)
    return out[::-1]
