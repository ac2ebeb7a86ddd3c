"""Eigenbases of symmetric matrices: matching through time, and joint diagonalisation from sufficient statistics."""

from __future__ import annotations

import numpy as np

SWEEPS = 100
IMPROVEMENT = 1e-12
RANDOM_STARTS = 8


def descending_eigh(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((stack + np.swapaxes(stack, -1, -2)) / 2)
    return values[..., ::-1], vectors[..., ::-1]


def assignment(gain: np.ndarray) -> np.ndarray:
    """The column of each row in the assignment of largest summed gain, the lexicographically first among equals: rows
    enter one by one along shortest augmenting paths in reduced costs, p^3 steps in all. Equals use the edges without
    reduced cost only, so the first of them is found by augmenting inside these."""
    p = len(gain)
    cost = gain.max() - gain
    u, v = np.zeros(p), np.zeros(p)
    row_of, column_of = np.full(p, -1), np.full(p, -1)
    for start in range(p):
        distance = cost[start] - u[start] - v
        before, done = np.full(p, start), np.zeros(p, bool)
        while True:
            column = int(np.argmin(np.where(done, np.inf, distance)))
            done[column] = True
            if row_of[column] < 0:
                break
            row = row_of[column]
            through = distance[column] + cost[row] - u[row] - v
            shorter = ~done & (through < distance)
            distance[shorter], before[shorter] = through[shorter], row
        reach = distance[column]
        done[column] = False
        u[row_of[done]] += reach - distance[done]
        v[done] -= reach - distance[done]
        u[start] += reach
        while column >= 0:
            row = before[column]
            row_of[column] = row
            column_of[row], column = column, column_of[row]
            if row == start:
                break
    tight = cost - u[:, None] - v[None, :] <= 1e-13 * max(float(np.abs(cost).max()), np.finfo(float).tiny)
    tight[np.arange(p), column_of] = True
    return _first_matching(tight, column_of, row_of)


def _first_matching(tight: np.ndarray, column_of: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """The lexicographically first perfect matching of a graph from one of its perfect matchings."""
    p = len(tight)
    column_of, row_of = column_of.copy(), row_of.copy()

    def moved(row: int, fixed: int, seen: set[int]) -> bool:
        """Finds the row another column among those that rows after `fixed` hold."""
        for column in np.flatnonzero(tight[row]).tolist():
            if column in seen:
                continue
            seen.add(column)
            holder = row_of[column]
            if holder < 0 or (holder > fixed and moved(int(holder), fixed, seen)):
                row_of[column], column_of[row] = row, column
                return True
        return False

    for row in range(p):
        for column in np.flatnonzero(tight[row, : column_of[row]]).tolist():
            holder = int(row_of[column])
            if holder < row:
                continue
            old, kept = int(column_of[row]), (column_of.copy(), row_of.copy())
            row_of[column], column_of[row], row_of[old] = row, column, -1
            if moved(holder, row, {column}):
                break
            column_of, row_of = kept
    return column_of


def matching(before: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, signs): the columns of basis, reordered to maximise the summed absolute inner products with the columns
    of before (the first best permutation), and flipped where an inner product is negative."""
    inner = before.T @ basis
    order = assignment(np.abs(inner))
    return order, np.where(inner[np.arange(len(inner)), order] < 0, -1, 1)


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The signed permutation of `then`, relative to raw neighbours, seen through what already applies to the first:
    column k follows column first.order[k] of the raw predecessor."""
    order, signs = first
    return then[0][order], then[1][order] * signs


def random_orthogonal(p: int, draw: np.random.Generator) -> np.ndarray:
    q, r = np.linalg.qr(draw.standard_normal((p, p)))
    q = q * np.where(np.diag(r) < 0, -1, 1)
    if np.linalg.det(q) < 0:
        q[:, 0] = -q[:, 0]
    return q


def rotated(tensor: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """K_abcd = sum_t E_ab E_cd for Q'E_tQ in place of E_t."""
    return np.einsum("abcd,ai,bj,ck,dl->ijkl", tensor, basis, basis, basis, basis, optimize=True)


def off_diagonal(tensor: np.ndarray) -> float:
    p = tensor.shape[0]
    return float(sum(tensor[i, j, i, j] for i in range(p) for j in range(p) if i != j))


def _angle(tensor: np.ndarray, i: int, j: int) -> float:
    """The rotation of columns i and j that leaves least off the diagonal: with h half the gap of the diagonal
    entries, the new entry is e cos 2a + h sin 2a, whose sum of squares is a quadratic form in (cos 2a, sin 2a)."""
    e2 = tensor[i, j, i, j]
    eh = (tensor[i, j, j, j] - tensor[i, j, i, i]) / 2
    h2 = (tensor[j, j, j, j] - 2 * tensor[i, i, j, j] + tensor[i, i, i, i]) / 4
    _, vectors = np.linalg.eigh(np.array([[e2, eh], [eh, h2]]))
    c, s = vectors[:, 0]
    angle = np.arctan2(s, c) / 2
    while angle >= np.pi / 4:
        angle -= np.pi / 2
    while angle < -np.pi / 4:
        angle += np.pi / 2
    return float(angle)


def jacobi(tensor: np.ndarray, start: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, float, int]:
    """(basis, objective, sweeps used) by cyclic plane rotations on the sufficient statistics alone."""
    basis, p = start.copy(), tensor.shape[0]
    current = rotated(tensor, basis)
    value = off_diagonal(current)
    for sweep in range(1, sweeps + 1):
        before = value
        for i in range(p - 1):
            for j in range(i + 1, p):
                a = _angle(current, i, j)
                turn = np.eye(p)
                turn[i, i] = turn[j, j] = np.cos(a)
                turn[i, j], turn[j, i] = -np.sin(a), np.sin(a)
                basis = basis @ turn
                current = rotated(current, turn)
        value = off_diagonal(current)
        if before - value <= IMPROVEMENT * max(before, np.finfo(float).tiny):
            return basis, value, sweep
    return basis, value, sweeps


def joint_basis(tensor: np.ndarray, reference: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float, str]:
    """The best basis of ten starts (identity, reference, random); the earliest wins ties."""
    draw, p = np.random.default_rng(seed), tensor.shape[0]
    starts = [("identity", np.eye(p)), ("reference", reference)] + [(f"random_{k + 1}", random_orthogonal(p, draw)) for k in range(RANDOM_STARTS)]
    best = None
    for name, start in starts:
        basis, value, _ = jacobi(tensor, start)
        if best is None or value < best[1]:
            best = (basis, value, name)
    return canonical(best[0]), best[1], best[2]


def canonical(basis: np.ndarray) -> np.ndarray:
    """Columns permuted to the largest diagonal loadings, signs so that the diagonal is not negative."""
    out = basis[:, assignment(np.abs(basis))]
    return out * np.where(np.diag(out) < 0, -1, 1)


def alignment(basis: np.ndarray) -> list[tuple[int, float, float]]:
    """(column, absolute diagonal loading, angle to the axis in degrees)."""
    loads = np.clip(np.abs(np.diag(basis)), 0, 1)
    return [(k + 1, float(v), float(np.degrees(np.arccos(v)))) for k, v in enumerate(loads)]
