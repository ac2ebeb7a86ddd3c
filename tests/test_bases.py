"""Assignments against all permutations, and bases wider than permutations allow."""

import time
from itertools import permutations

import numpy as np
import pytest

from panelforge.functions import bases


def first_best(gain):
    p = len(gain)
    return list(max(permutations(range(p)), key=lambda o: sum(gain[k, o[k]] for k in range(p))))


@pytest.mark.parametrize("p", [1, 2, 3, 5, 6])
def test_equals_all_permutations(p):
    rng = np.random.default_rng(p)
    for _ in range(60):
        gain = rng.random((p, p))
        assert bases.assignment(gain).tolist() == first_best(gain)


@pytest.mark.parametrize("p", [2, 3, 4, 5, 6])
def test_first_of_equals(p):
    rng = np.random.default_rng(p)
    for _ in range(80):
        gain = rng.integers(0, 3, (p, p)).astype(float)
        assert bases.assignment(gain).tolist() == first_best(gain)
    assert bases.assignment(np.zeros((p, p))).tolist() == list(range(p)) and bases.assignment(np.eye(p)).tolist() == list(range(p))


def test_wide_bases():
    rng = np.random.default_rng(0)
    for p in (12, 40):
        before, _ = np.linalg.qr(rng.standard_normal((p, p)))
        order, signs = rng.permutation(p), rng.choice([-1, 1], p)
        shuffled = np.empty_like(before)
        shuffled[:, order] = before * signs
        began = time.perf_counter()
        got, flips = bases.matching(before, shuffled)
        assert time.perf_counter() - began < 0.5
        assert got.tolist() == order.tolist() and np.allclose(shuffled[:, got] * flips, before)
    assert np.all(np.diag(bases.canonical(shuffled)) >= 0)
