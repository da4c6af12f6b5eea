"""Symmetric matrices and small linear systems in array columns, as expression text.

A symmetric matrix is the array of its upper triangle, row by row. A system is
an array of rows; each row holds the matrix entries followed by any number of
right-hand sides. Element-wise work is written out as plain arithmetic, which
Spark compiles; only the elimination itself is a higher-order function.
"""

from __future__ import annotations

from collections.abc import Sequence

# Stands for the unit vectors as right-hand sides.
IDENTITY = "identity"


def upper(dim: int) -> list[tuple[int, int]]:
    """Index pairs of an upper triangle, in storage order."""
    return [(i, j) for i in range(dim) for j in range(i, dim)]


def diagonal_positions(dim: int) -> list[int]:
    pairs = upper(dim)
    return [pairs.index((i, i)) for i in range(dim)]


def array(cells: Sequence[str]) -> str:
    return f"array({', '.join(cells)})"


def each(dim: int, body: str) -> str:
    """An array of `body` for every index {i}."""
    return array([body.format(i=i) for i in range(dim)])


def each_pair(dim: int, body: str) -> str:
    """A triangle of `body` for every index pair {i}, {j} at storage position {k}."""
    return array([body.format(i=i, j=j, k=k) for k, (i, j) in enumerate(upper(dim))])


def system(dim: int, triangle: str, sides: Sequence[str]) -> str:
    """Rows of the full matrix with right-hand sides, each an array column or IDENTITY."""
    pairs = upper(dim)
    rows = []
    for i in range(dim):
        cells = [f"{triangle}[{pairs.index((min(i, j), max(i, j)))}]" for j in range(dim)]
        for side in sides:
            if side == IDENTITY:
                cells += [f"{float(i == k)}D" for k in range(dim)]
            else:
                cells.append(f"{side}[{i}]")
        rows.append(array(cells))
    return array(rows)


def let(name: str, value: str, body: str) -> str:
    """`body` with `name` bound to a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def solve(dim: int, rows: str, least: str | None = None) -> str:
    """Gauss-Jordan elimination without pivoting, which positive definite matrices do not need.

    Entry dim + s of row i of the result is solution i of side s. A matrix that
    may be singular needs `least`, the smallest pivot that counts: a row with a
    smaller one becomes zeros, so entry i of row i tells whether it was solved.
    """
    pivot_row = "transform(r, v -> v / r[p])"
    factor = "r[p] / m[p][p]"
    if least is not None:
        pivot_row = f"if(abs(r[p]) > {least}, {pivot_row}, transform(r, v -> 0D))"
        factor = f"if(abs(m[p][p]) > {least}, {factor}, 0D)"
    other_row = let("f", factor, "zip_with(r, m[p], (v, w) -> v - f * w)")
    step = f"transform(m, (r, i) -> if(i = p, {pivot_row}, {other_row}))"
    return f"aggregate(sequence(0, {dim - 1}), {rows}, (m, p) -> {step})"


def cholesky(dim: int, rows: str) -> str:
    """Rows of the upper factor R (R'R is the positive definite matrix); side s becomes R'^-1 side at dim + s.

    Elimination below the pivots leaves D times a unit upper triangle; dividing row i by
    the root of its pivot gives R. Entries left of the pivots are not part of it.
    """
    below = let("f", "r[p] / m[p][p]", "zip_with(r, m[p], (v, w) -> v - f * w)")
    eliminated = f"aggregate(sequence(0, {dim - 1}), {rows}, (m, p) -> transform(m, (r, i) -> if(i > p, {below}, r)))"
    return f"transform({eliminated}, (r, i) -> transform(r, v -> v / sqrt(r[i])))"


def back_substitute(dim: int, factor: str, right: str) -> str:
    """The vector v with R v = right, from the rows of R (a column); `right` is an expression in the row number i."""
    known = f"aggregate(zip_with(slice({factor}[i], 1, {dim}), v, (a, b) -> a * b), 0D, (s, t) -> s + t)"
    entry = f"({right} - {known}) / {factor}[i][i]"
    step = f"transform(v, (x, k) -> if(k = i, {entry}, x))"
    return f"aggregate(sequence({dim - 1}, 0, -1), array_repeat(0D, {dim}), (v, i) -> {step})"


def side(dim: int, solved: str, s: int) -> str:
    """Solution vector of side s, `solved` being a column."""
    return array([f"{solved}[{i}][{dim + s}]" for i in range(dim)])


def trace(dim: int, solved: str, first: int) -> str:
    """Trace of the inverse when sides first … first + dim - 1 are the identity."""
    return " + ".join(f"{solved}[{i}][{dim + first + i}]" for i in range(dim))


def dot(dim: int, left: str, right: str) -> str:
    """Dot product of two array columns."""
    return " + ".join(f"{left}[{i}] * {right}[{i}]" for i in range(dim))
