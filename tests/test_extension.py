"""Seed extension against a scoring table filled cell by cell, and by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest
from warpline.functions import rowwise

OPEN, EACH = 6, 1


def plain_best(query, target, h0):
    """The best score over all cells of the affine-gap recurrence, its cells at zero or above."""
    scores = rowwise.match_scores()
    n, m = len(query), len(target)
    cell = {(0, 0): h0}
    for j in range(1, n + 1):
        cell[0, j] = max(0, h0 - OPEN - EACH * j)
    for i in range(1, m + 1):
        cell[i, 0] = max(0, h0 - OPEN - EACH * i)
    best = h0
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            deletion = [cell[i - k, j] - OPEN - EACH * k for k in range(1, i)]
            insertion = [cell[i, j - k] - OPEN - EACH * k for k in range(1, j)]
            cell[i, j] = max(0, cell[i - 1, j - 1] + int(scores[target[i - 1]][query[j - 1]]), *deletion, *insertion)
            best = max(best, cell[i, j])
    return best


@pytest.mark.parametrize("seed", range(20))
def test_best_scores_equal_the_whole_table(seed):
    """A seed score so high that every cell stays above zero, and a band wider than the table."""
    rng = random.Random(seed)
    queries = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(20)]
    targets = [[c if rng.random() < 0.8 else rng.randrange(5) for c in q][: rng.randrange(1, 13)] for q in queries]
    got = rowwise.extend_all(queries, targets, rowwise.match_scores(), rowwise.Penalties(bonus=200, drop=0), np.full(20, 100), np.full(20, 300))
    assert got.score.tolist() == [plain_best(q, t, 300) for q, t in zip(queries, targets)]


def test_worked_values():
    side = ([[0, 1, 2, 3]], [[0, 1, 2, 3]])
    out = rowwise.seed_extensions(side, side, np.array([4]), 10, 10, rowwise.match_scores())
    # four matches on each side: 10 + 4 + 4, both ends reached
    assert {k: int(v[0]) for k, v in out.items()} == {"q_beg": 0, "r_beg": -4, "q_end": 4, "r_end": 4, "score": 18, "true_score": 18, "width": 8}
    # a mismatch costs 4 and what follows gains 3: the best stays the seed, and the query's end is within the bonus of 5
    out = rowwise.seed_extensions(([[]], [[]]), ([[0, 1, 1, 1]], [[2, 1, 1, 1]]), np.array([0]), 10, 10, rowwise.match_scores())
    assert (int(out["score"][0]), int(out["q_end"][0]), int(out["r_end"][0]), int(out["true_score"][0])) == (10, 4, 4, 9)
    # nothing to extend
    out = rowwise.seed_extensions(([[]], [[]]), ([[]], [[0]]), np.array([0]), 10, 10, rowwise.match_scores())
    assert {k: int(v[0]) for k, v in out.items()} == {"q_beg": 0, "r_beg": 0, "q_end": 0, "r_end": 0, "score": -1, "true_score": 10, "width": 8}


def test_substitution_has_its_published_values():
    s = rowwise.sbox()
    assert [int(s[i]) for i in (0x00, 0x01, 0x53, 0xFF)] == [0x63, 0x7C, 0xED, 0x16] and sorted(s) == list(range(256))
