"""Dishes of any number of customers have the tables that the model gives them after one sweep."""

import numpy as np
import pytest

from corpusmill.llm import hpylm


def plain(c, opening, by_table, d):
    """Mean and variance of the number of tables, from the weights of all seatings; opening is the weight of the second table."""
    s = np.full(c + 1, -np.inf)
    s[1] = 0.0
    for n in range(1, c):
        t = np.arange(1, n + 2)
        s[1 : n + 2] = np.logaddexp(s[t - 1], np.log(np.maximum(n - d * t, 1e-300)) + s[t])
    w = s[1:] + np.concatenate([[0], np.cumsum(np.log(opening + by_table * np.arange(c - 1)))])
    p = np.exp(w - w.max())
    p /= p.sum()
    t = np.arange(1, c + 1)
    mean = (p * t).sum()
    return mean, (p * t * t).sum() - mean**2


@pytest.mark.parametrize("c, opening, by_table, d", [(2, 0.7, 0.0, 0.8), (9, 3.0, 0.2, 0.8), (64, 20.0, 0.1, 0.75), (65, 0.01, 0.001, 0.8), (200, 5.0, 0.3, 0.8), (513, 0.01, 0.001, 0.8), (700, 5.0, 0.1, 0.8), (1000, 100.0, 0.0, 0.8), (3000, 800.0, 0.1, 0.8), (3000, 2.0, 0.0, 0.75)])
def test_tables_of_a_dish(c, opening, by_table, d):
    n = 4000
    level = hpylm.Level(np.zeros(n, np.int64), np.zeros(n, np.int64), d, 1.0, np.random.default_rng(1))
    level.t = np.ones(n, np.int64)  # one table before, where the first seating left every dish
    level.gibbs(np.full(n, c), np.full(n, opening), np.full(n, by_table), 4)
    mean, var = plain(c, opening, by_table, d)
    assert abs(level.t.mean() - mean) < 0.03 * mean + 0.05
    assert abs(level.t.var() - var) < 0.25 * var + 0.05


def test_hot_dishes_have_tables():
    rng = np.random.default_rng(2)
    entries, c = np.unique(np.minimum(rng.zipf(1.2, 60_000), 3000) << 16 | rng.integers(0, 4, 60_000), return_counts=True)
    word, context = np.unique(entries >> 16, return_inverse=True)[1], entries & 0xFFFF
    _, _, kept = hpylm.seat_shard(word, context, c, np.bincount(context, c, 65536).astype(np.int64), 1, 3)
    hot = c > 1000
    for sample in kept:
        assert hot.any() and (sample[2][1][hot] > 20).all()
        assert all(((t >= (n > 0)) & (t <= n)).all() for n, t in sample)
