"""The largest eigenvalues of a symmetric matrix by contour integration."""

from __future__ import annotations

import math

import numpy as np

#: Eigenvalues looked for in one interval, where the spectrum can be cut so.
SLICE = 8
#: The largest quotient of the eigenvalues in an interval.
SPAN = 32
#: Points of the Gauss-Legendre rule on the half circle over an interval.
NODES = 12
ROUNDS = 40
_HALVINGS = 60
_EPS = np.finfo(np.float64).eps


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: the positive pivots of ``matrix - shift``.

    Symmetric elimination with the largest pivot of size one or two (Bunch and Parlett); by
    the law of inertia the signs are those of the eigenvalues. A pivot block of size two has
    one eigenvalue of each sign.
    """
    rest = matrix - shift * np.eye(len(matrix))
    bound = (1 + math.sqrt(17)) / 8
    positive = 0
    while len(rest):
        size = len(rest)
        main = np.abs(np.diagonal(rest))
        at = int(main.argmax())
        off = np.abs(rest)
        np.fill_diagonal(off, 0)
        i, j = divmod(int(off.argmax()), size)
        if not main[at] and not off[i, j]:
            break
        if main[at] >= bound * off[i, j]:
            keep = np.arange(size) != at
            pivot, column = rest[at, at], rest[keep, at]
            positive += bool(pivot > 0)
            rest = rest[np.ix_(keep, keep)] - np.outer(column, column) / pivot
        else:
            keep = np.ones(size, dtype=bool)
            keep[[i, j]] = False
            block, columns = rest[np.ix_([i, j], [i, j])], rest[np.ix_(keep, [i, j])]
            positive += 1
            rest = rest[np.ix_(keep, keep)] - columns @ np.linalg.solve(block, columns.T)
        rest = (rest + rest.T) / 2
    return positive


def _cut(matrix: np.ndarray, number: int, low: float, high: float) -> float | None:
    """A point in the middle of the gap with ``number`` eigenvalues above it, if there is one.

    A gap of the size of rounding errors is none. ``low`` has at least ``number`` eigenvalues above it and ``high`` fewer or none.
    """
    under, over = low, high
    for _ in range(_HALVINGS):
        middle = (under + over) / 2
        above = count_above(matrix, middle)
        if above == number:
            break
        under, over = (middle, over) if above > number else (under, middle)
    else:
        return None
    bottom, top = middle, middle
    for _ in range(8):
        tried = (under + bottom) / 2
        under, bottom = (under, tried) if count_above(matrix, tried) == number else (tried, bottom)
        tried = (over + top) / 2
        over, top = (over, tried) if count_above(matrix, tried) == number else (tried, top)
    wide = top - bottom > 64 * len(matrix) * _EPS * float(np.abs(matrix).sum(axis=1).max())
    return (bottom + top) / 2 if wide else None


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """``(low, high, count)`` of slices of the spectrum that hold the largest eigenvalues.

    Counts come from the inertia. The slices lie side by side, hold ``wanted`` eigenvalues
    (more if equal ones cannot be parted; all positive ones if there are fewer) and are cut
    in gaps. Eigenvalues of the size of rounding errors count as zero.
    """
    high = min(float(np.abs(matrix).sum(axis=1).max(initial=0)), float(np.trace(matrix)))
    if high <= 0:
        return []
    high *= 1 + 1e-6
    floor = len(matrix) * _EPS * high * 4
    positive = count_above(matrix, floor)
    cuts, done, upper = [], 0, high
    while done < min(wanted, positive):
        # A slice spans eigenvalues of like size only: those below it must be far on its scale.
        while (like := count_above(matrix, max(floor, upper / SPAN))) == done:
            upper /= SPAN
        number = min(done + SLICE, wanted, like)
        while number < positive and (cut := _cut(matrix, number, floor, upper)) is None:
            number += 1
        low = floor if number >= positive else cut
        cuts.append((low, upper, number - done))
        done, upper = number, low
    return cuts


def _filtered(matrix: np.ndarray, low: float, high: float, rows: np.ndarray) -> np.ndarray:
    """The contour integral of the resolvent around ``(low, high)``, times ``rows``.

    One complex solve per point of the half circle; the other half is its conjugate.
    """
    middle, radius = (low + high) / 2, (high - low) / 2
    places, weights = np.polynomial.legendre.leggauss(NODES)
    total = np.zeros_like(rows)
    for place, weight in zip(places, weights, strict=True):
        turn = np.exp(1j * math.pi / 2 * (1 - place))
        shifted = (middle + radius * turn) * np.eye(len(matrix)) - matrix
        total += weight / 2 * (radius * turn * np.linalg.solve(shifted, rows.astype(complex))).real
    return total


def _ritz(matrix: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: eigenpairs of ``matrix`` on the space that ``rows`` span."""
    base, _ = np.linalg.qr(rows)
    values, turn = np.linalg.eigh(base.T @ matrix @ base)
    return values, base @ turn


def _inside(matrix: np.ndarray, low: float, high: float, count: int, scale: float) -> np.ndarray:
    """The ``count`` eigenvectors with eigenvalues in ``(low, high)``."""
    size = len(matrix)
    draw = np.random.default_rng(5)
    width = min(size, count + max(4, count // 2))
    while True:
        rows = draw.standard_normal((size, width))
        for _ in range(ROUNDS):
            values, rows = _ritz(matrix, _filtered(matrix, low, high, rows))
            chosen = (values > low) & (values < high)
            found = rows[:, chosen]
            gap = np.linalg.norm(matrix @ found - found * values[chosen], axis=0).max(initial=0)
            if int(chosen.sum()) == count and gap <= 8 * _EPS * scale:
                return found
        if int(chosen.sum()) == count and gap <= 1e-11 * scale:
            return found
        if width == size:
            raise ArithmeticError(f"{count} eigenvalues lie in ({low}, {high}), others were found")
        width = min(size, 2 * width)


def largest(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``wanted`` largest positive eigenvalues, falling, and unit eigenvectors as columns.

    Of each slice the integral projects a random block onto its eigenspace, again and again
    until the residuals are rounding errors. The inertia has said how many there are; a slice that
    gives another number is worked with a larger block and fails at last. A joint
    Rayleigh-Ritz step makes the vectors of all slices orthogonal.
    """
    slices = intervals(matrix, wanted)
    if not slices:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scale = slices[0][1]
    rows = np.hstack([_inside(matrix, *part, scale) for part in slices])
    values, vectors = _ritz(matrix, rows)
    return values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
