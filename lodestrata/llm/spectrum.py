"""A running eigendecomposition of a scatter matrix, kept up by rank-one updates."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Steps towards the roots at most; some six are usual.
STEPS = 60


class Spectrum:
    """n vectors (weights count), their mean, and the eigenvalues (ascending) and unit eigenvectors (columns) of sum((x - mean)(x - mean)')."""

    def __init__(self, dim: int) -> None:
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(dim), np.zeros(dim), np.eye(dim)

    @classmethod
    def of(cls, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> Spectrum:
        out = cls(len(mean))
        out.n, out.mean, out.values, out.vectors = int(n), np.array(mean, float), np.array(values, float), np.array(vectors, float).reshape(len(mean), -1)
        return out

    def add(self, x: np.ndarray, weight: int = 1) -> None:
        """One vector, weight times."""
        away = x - self.mean
        if self.n:
            self.raise_by(away, self.n * weight / (self.n + weight))
        self.mean += away * (weight / (self.n + weight))
        self.n += weight

    def merge(self, other: Spectrum) -> None:
        """All that other has seen: a rank-one update for each of its directions, and one for the distance of the means."""
        if self.n and other.n:
            self.raise_by(other.mean - self.mean, self.n * other.n / (self.n + other.n))
        for value, vector in zip(other.values[::-1], other.vectors.T[::-1], strict=True):
            if value > 0:
                self.raise_by(vector, value)
        if other.n:
            self.mean += (other.mean - self.mean) * (other.n / (self.n + other.n))
            self.n += other.n

    def raise_by(self, x: np.ndarray, by: float) -> None:
        """The decomposition of the matrix plus by * xx'. Directions that x has no part in stay as they are, and of those that share an eigenvalue all but one
        are turned away from x, so that the secular equation has distinct poles and no vanishing weight."""
        z, d = x @ self.vectors, self.values
        size = float(np.sqrt(z @ z))
        if size == 0 or not by > 0:
            return
        z, by = z / size, by * size * size
        small = 8 * EPS * max(float(d[-1]), by)
        close = np.diff(d) <= small
        if close.any():
            self._turn(z, close)
        live = by * np.abs(z) > small
        count = int(live.sum())
        if count == len(d):
            self.values, turn = secular(d, z, by)
            self.vectors = self.vectors @ turn
        elif count:
            found, turn = secular(d[live], z[live], by)
            values, vectors = d.copy(), self.vectors.copy()
            values[live], vectors[:, live] = found, vectors[:, live] @ turn
            order = np.argsort(values, kind="stable")
            self.values, self.vectors = values[order], vectors[:, order]

    def _turn(self, z: np.ndarray, close: np.ndarray) -> None:
        """Within every run of equal eigenvalues, reflect the directions so that only the last has a part in z."""
        self.vectors = self.vectors.copy()
        ends = np.flatnonzero(np.diff(np.concatenate([[False], close, [False]]).astype(int)))
        for first, last in zip(ends[::2], ends[1::2], strict=True):
            part = z[first : last + 1]
            length = float(np.sqrt(part @ part))
            if length == 0:
                continue
            toward = np.copysign(length, part[-1])
            mirror = part.copy()
            mirror[-1] += toward
            mirror /= np.sqrt(mirror @ mirror)
            block = self.vectors[:, first : last + 1]
            block -= 2 * np.outer(block @ mirror, mirror)
            part[:] = 0
            part[-1] = -toward


def secular(d: np.ndarray, z: np.ndarray, by: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of diag(d) + by * zz', where d ascends strictly, no z is 0 and z has length 1 or less.

    All roots of 1 / by + sum(z^2 / (d - t)) are sought at once, each between two poles and as its distance from the nearer one, by fitting two
    poles to the sums left and right of it; a step that leaves its bracket halves it. The weights that the roots found have exactly then give
    eigenvectors that are orthogonal to rounding.
    """
    k = len(d)
    squares = z * z
    if k == 1:
        return d + by * squares, np.ones((1, 1))
    top = d[-1] + by * float(squares.sum())
    after = np.append(d[1:], top)
    gaps = after - d
    left = np.tri(k)
    half = gaps / 2
    there = 1 / by + (squares / (d - (d + half)[:, None])).sum(1)
    upper = there < 0
    upper[-1] = False
    pole = np.where(upper, after, d)
    poles = d - pole[:, None]
    one, two = d - pole, after - pole
    low, high = np.where(upper, -half, 0.0), np.where(upper, 0.0, np.where(there < 0, gaps, half))
    high[-1] = gaps[-1]
    t = (low + high) / 2
    for _ in range(STEPS):
        near = 1 / (poles - t[:, None])
        f = 1 / by + near @ squares
        scale = 1 / by + np.abs(near) @ squares
        near *= near
        slope = near @ squares
        near *= left
        rising = near @ squares
        falling = slope - rising
        done = np.abs(f) <= 4 * EPS * scale
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        if done.all():
            break
        a, b = one - t, two - t
        c = f - a * rising - b * falling
        p, q = (a + b) * f - a * b * slope, a * b * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
        new = t + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        moved = np.where(done, t, new)
        if (np.abs(moved - t) <= 2 * EPS * np.abs(t)).all():
            t = moved
            break
        t = moved
    away = poles - t[:, None]  # d_i - value_j, in row j
    apart = d[:, None] - d
    apart[np.diag_indices(k)] = -1
    exact = np.sqrt(np.abs((away / apart).prod(0)) / by)
    turn = (np.copysign(exact, z) / away).T
    turn /= np.sqrt((turn * turn).sum(0))
    return pole + t, turn
