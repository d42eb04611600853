"""Singular values and right singular vectors of a small square matrix, within one task.

Householder reflections make the matrix upper bidiagonal. Its singular values come from the differential qd algorithm with
shifts (Fernando and Parlett 1994), which finds small ones as accurately as large ones; vectors come from twisted
factorisations of the shifted tridiagonal (Dhillon and Parlett 2004), and those of close values are set right against each other.
"""

import numpy as np

EPS = np.finfo(float).eps
#: Values whose relative distance is below this have their vectors made orthogonal by inverse iteration.
CLOSE = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """diagonal, superdiagonal and v with r = u @ bidiagonal @ v.T for some orthogonal u."""
    a, n = np.array(r, float), len(r)
    v = np.eye(n)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        """The unit vector w for which x - 2 w (w.x) has its first part alone."""
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            return None
        w = x / norm
        w[0] += 1.0 if w[0] >= 0 else -1.0
        return w / np.linalg.norm(w)

    for k in range(n):
        w = mirror(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k < n - 2:
            w = mirror(a[k, k + 1 :])
            if w is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list, e: list, shift: float) -> tuple[list, list, float]:
    """One transform of a qd array: that of all values less the shift. The last number is the least pivot; below zero the shift was too large."""
    n, d = len(q), q[0] - shift
    out_q, out_e, least = [0.0] * n, [0.0] * (n - 1), d
    for i in range(n - 1):
        out_q[i] = d + e[i]
        if out_q[i] == 0:
            out_e[i], d = 0.0, q[i + 1] - shift
        else:
            t = q[i + 1] / out_q[i]
            out_e[i], d = e[i] * t, d * t - shift
        if not d >= least:  # a NaN counts as too low
            least = d
    out_q[-1] = d
    return out_q, out_e, least


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Falling singular values of an upper bidiagonal matrix, by dqds. Each block between negligible off-diagonals is gone through by itself."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if scale == 0:
        return np.zeros(len(diagonal))
    todo, found = [((diagonal / scale) ** 2, (above / scale) ** 2, 0.0)], []
    while todo:
        q, e, moved = todo.pop()
        q, e, tries = list(map(float, q)), list(map(float, e)), 0
        if len(q) > 1 and q[0] < q[-1]:
            q, e = _turned(q, e)
        least = 0.0
        while q:
            n = len(q)
            if n == 1 or e[-1] <= EPS * EPS * (moved + q[-1]):
                found.append(moved + q.pop())
                e, tries = e[:-1], 0
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * moved or e[i] == 0), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            tries += 1
            if tries > 500:  # never seen; the values are as good as the array is diagonal
                found += [moved + x for x in q]
                break
            for shift in (_guess(q, e), 0.5 * least, 0.0) if tries % 8 else (0.0,):
                if shift < 0 or not np.isfinite(shift):
                    continue
                nq, ne, low = _step(q, e, shift)
                if low >= 0 or shift == 0:
                    break
            q, e, moved, least = [max(0.0, x) for x in nq], [max(0.0, x) for x in ne], moved + shift, max(0.0, low)
            least = least / n if shift else least / (2 * n)
    return np.sqrt(np.sort(np.array(found))[::-1]) * scale


def _turned(q: list, e: list) -> tuple[list, list]:
    """The array of the matrix read from its other end, which has the same values."""
    d, u = np.sqrt(q), np.sqrt(e)
    # an upper bidiagonal read backwards is lower bidiagonal; rotations make it upper again
    d, u = d[::-1].copy(), u[::-1].copy()
    for i in range(len(d) - 1):
        r = np.hypot(d[i], u[i])
        c, s = (d[i] / r, u[i] / r) if r else (1.0, 0.0)
        d[i], u[i], d[i + 1] = r, s * d[i + 1], c * d[i + 1]
    return list(d**2), list(u**2)


def _guess(q: list, e: list) -> float:
    """A shift a little below the smaller value of the last two rows' block."""
    a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
    half, mid = (a - c) / 2, (a + c) / 2
    low = mid - np.hypot(half, np.sqrt(b))
    return 0.98 * low if low > 0 else 0.25 * min(q[-1], min(q))


class Twisted:
    """Factorisations of bidiagonal.T @ bidiagonal - value from the top and from the bottom, which meet at the row with the least pivot."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        n, tiny = len(diagonal), np.finfo(float).tiny / EPS
        d = np.where(diagonal**2 > tiny, diagonal**2, tiny)
        low = above / np.where(np.abs(diagonal) > np.sqrt(tiny), diagonal, np.sqrt(tiny))[:-1]
        self.down, self.up = np.zeros(n), np.zeros(n)
        self.low, self.high = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
        s, p = np.full(n, -value), np.zeros(n)
        floor = EPS * max(value, float(d.max(initial=0))) * EPS
        safe = lambda x: x if abs(x) > floor else floor
        for i in range(n - 1):
            self.down[i] = safe(s[i] + d[i])
            self.low[i] = d[i] * low[i] / self.down[i]
            s[i + 1] = self.low[i] * low[i] * s[i] - value
        self.down[-1] = safe(s[-1] + d[-1])
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            self.up[i + 1] = safe(d[i] * low[i] ** 2 + p[i + 1])
            t = d[i] / self.up[i + 1]
            self.high[i] = low[i] * t
            p[i] = p[i + 1] * t - value
        self.up[0] = safe(p[0])
        pivots = s + p + value
        self.at = int(np.argmin(np.where(np.isfinite(pivots), np.abs(pivots), np.inf)))
        self.pivot = safe(pivots[self.at])

    def vector(self) -> np.ndarray:
        return self._back(np.eye(1, len(self.down), self.at)[0])

    def solve(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for i in range(self.at):
            x[i + 1] -= self.low[i] * x[i]
        for i in range(len(x) - 1, self.at, -1):
            x[i - 1] -= self.high[i - 1] * x[i]
        x[: self.at] /= self.down[: self.at]
        x[self.at + 1 :] /= self.up[self.at + 1 :]
        x[self.at] /= self.pivot
        return self._back(x)

    def _back(self, x: np.ndarray) -> np.ndarray:
        for i in range(self.at - 1, -1, -1):
            x[i] -= self.low[i] * x[i + 1]
        for i in range(self.at, len(x) - 1):
            x[i + 1] -= self.high[i] * x[i]
        return x / np.linalg.norm(x)


def right_vectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All singular values of r, falling, and in columns the right singular vectors of the first k that differ from zero in double precision. Each vector's largest part is above zero."""
    diagonal, above, v = bidiagonalise(r)
    values = singular_values(diagonal, above)
    scale = values[0] if len(values) and values[0] > 0 else 1.0
    diagonal, above, rng, out = diagonal / scale, above / scale, np.random.default_rng(5), []
    k, first = min(k, int((values > EPS * len(values) * values[0]).sum()) if len(values) else 0), 0
    for j in range(k):
        s = values[j] / scale
        if j and values[j - 1] / scale - s > CLOSE * values[j - 1] / scale:
            first = j  # a new group of close values
        close = j > first or (j + 1 < len(values) and s - values[j + 1] / scale <= CLOSE * s)
        twisted = Twisted(diagonal, above, s * s)
        z = twisted.vector() if j == first else rng.standard_normal(len(values))
        for _ in range(4 if close else 0):
            z = twisted.solve(_apart(z, out[first:]))
        z = _apart(_apart(z, out), out)
        out.append(z / np.linalg.norm(z))
    vectors = v @ np.array(out).T if out else np.zeros((len(values), 0))
    turn = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if out else 1
    return values, vectors * turn


def _apart(z: np.ndarray, others: list) -> np.ndarray:
    for y in others:
        z = z - (z @ y) * y
    return z / max(np.linalg.norm(z), 1e-300)
