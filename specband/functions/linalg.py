"""Small dense numpy helpers; inputs are band x band or cluster x class sized."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest one-to-one pairing of rows and columns (the shorter side is fully paired).

    Rows enter one at a time; each grows a shortest alternating path over reduced costs.
    """
    c = np.asarray(cost, dtype=float)
    if c.size == 0:
        return []
    if c.shape[0] > c.shape[1]:
        return sorted((i, j) for j, i in assign(c.T))
    n, m = c.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist = np.full(m, np.inf)
        came = np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, base, via = start, 0.0, -1
        while True:
            reach = base + c[row] - row_price[row] - col_price
            better = ~done & (reach < dist)
            dist[better], came[better] = reach[better], via
            j = int(np.argmin(np.where(done, np.inf, dist)))
            base, done[j] = dist[j], True
            if owner[j] < 0:
                break
            row, via = owner[j], j
        row_price[start] += base
        for k in np.flatnonzero(done):
            if k != j:
                row_price[owner[k]] += base - dist[k]
            col_price[k] -= base - dist[k]
        while j >= 0:
            prev = came[j]
            owner[j] = start if prev < 0 else owner[prev]
            j = prev
    return sorted((int(owner[j]), int(j)) for j in range(m) if owner[j] >= 0)


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln(n!) by table for small and by Stirling's series for larger arguments."""
    n = np.asarray(n, dtype=float)
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 257)))])
    x = np.maximum(n + 1, 2.0)
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n <= 256, table[np.clip(n, 0, 256).astype(int)], series)


def expected_mi_term(a: int, b: int, n: int, step: int = 1 << 18) -> float:
    """Expected mutual information of one marginal pair under the hypergeometric model.

    Terms whose probability underflows to 0 in double precision are outside the summed window;
    log-concavity lets bisection find its ends.
    """
    lo, hi = max(1, a + b - n), min(a, b)
    if hi < lo:
        return 0.0
    const = sum(float(log_factorial(np.array([v]))[0]) for v in (a, b, n - a, n - b)) - float(log_factorial(np.array([n]))[0])

    def logp(k: np.ndarray) -> np.ndarray:
        return const - log_factorial(k) - log_factorial(a - k) - log_factorial(b - k) - log_factorial(n - a - b + k)

    mode = min(max(lo, int((a + 1) * (b + 1) / (n + 2))), hi)

    def edge(inside: int, outside: int) -> int:
        if logp(np.array([outside]))[0] > -746:
            return outside
        while abs(outside - inside) > 1:
            mid = (inside + outside) // 2
            if logp(np.array([mid]))[0] > -746:
                inside = mid
            else:
                outside = mid
        return inside

    first, last = edge(mode, lo), edge(mode, hi)
    total = 0.0
    for s in range(first, last + 1, step):
        k = np.arange(s, min(s + step, last + 1), dtype=float)
        total += float(np.sum(k / n * (np.log(n) + np.log(k) - np.log(a) - np.log(b)) * np.exp(logp(k))))
    return total


def nnls_gram(g: np.ndarray, h: np.ndarray, max_rounds: int = 200) -> np.ndarray:
    """Non-negative X minimizing ||A X - B|| from G = A'A (k x k) and H = A'B (k x n), all columns at once.

    Columns with the same set of free variables share one solve; a variable moves between free and zero
    while it is negative or its gradient is, all at once while that helps, one at a time otherwise.
    """
    k, n = h.shape
    free = np.zeros((k, n), dtype=bool)
    x, grad = np.zeros((k, n)), -h.astype(float)
    tol = 1e-10 * max(1.0, float(np.abs(h).max()) if h.size else 1.0)
    best, chances = np.full(n, k + 1), np.full(n, 3)
    for _ in range(max_rounds):
        wrong = (free & (x < -tol)) | (~free & (grad < -tol))
        todo = np.flatnonzero(wrong.any(axis=0))
        if not len(todo):
            break
        count = wrong[:, todo].sum(axis=0)
        fewer = count < best[todo]
        best[todo[fewer]], chances[todo[fewer]] = count[fewer], 3
        single = ~fewer & (chances[todo] <= 0)
        chances[todo[~fewer]] -= 1
        flip = wrong[:, todo].copy()
        last = k - 1 - np.argmax(flip[::-1], axis=0)
        flip[:, single] = False
        flip[last[single], np.flatnonzero(single)] = True
        free[:, todo] ^= flip
        patterns, member = np.unique(free[:, todo], axis=1, return_inverse=True)
        member = member.ravel()
        for p in range(patterns.shape[1]):
            f, cols = patterns[:, p], todo[member == p]
            x[:, cols] = 0.0
            if f.any():
                gf = g[np.ix_(f, f)]
                x[np.ix_(f, cols)] = np.linalg.lstsq(gf, h[np.ix_(f, cols)], rcond=None)[0]
            grad[:, cols] = g @ x[:, cols] - h[:, cols]
            grad[np.ix_(f, cols)] = 0.0
    return np.maximum(x, 0.0)


def ls_solve(g: np.ndarray, h: np.ndarray, method: str, alpha: float = 1e-6) -> np.ndarray:
    """Solution of G X = H: ``clip`` (least squares, negatives to 0), ``ridge`` (the same with alpha on the
    diagonal), ``nnls`` (true non-negative minimum) or ``free`` (unconstrained)."""
    if method == "nnls":
        return nnls_gram(g, h)
    a = g + alpha * np.eye(len(g)) if method == "ridge" else g
    x = np.linalg.lstsq(a, h, rcond=None)[0]
    return x if method == "free" else np.maximum(x, 0.0)
