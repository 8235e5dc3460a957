"""Training steps against their plain form, and places of whole and partial windows."""

import copy
import math

import numpy as np

from kmerloom.llm import lm


def _model(seed=3):
    r = np.random.default_rng(seed)
    return lm.Attention(60, 8, r.integers(0, 8, 60), width=4, window=6), r


def test_all_but_vectors_of_ids_move_as_one():
    """Adam over one vector is Adam array by array, and the arrays stay views of that vector."""
    m, r = _model()
    x, y = r.integers(0, 61, (20, 6)), r.integers(-1, 60, (20, 6))
    plain = copy.deepcopy(m)
    m.train(x, y, 9, 1e-2, batch=8)
    assert len({id(v.base) for k, v in m.p.items() if k != "embed"}) == 1 and m.p["top"].base is not None
    rng, order, steps = np.random.default_rng(6), None, 9
    mean, square = ({k: np.zeros_like(v) for k, v in plain.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        if (step - 1) % 3 == 0:
            order = rng.permutation(20)
        at = order[(step - 1) % 3 * 8 :][:8]
        grad = plain.gradients(x[at], np.where(y[at] < 0, -1, plain.class_of[y[at]]))
        now = 1e-2 * min(1.0, step / 30) * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            rows, g = g if k == "embed" else (slice(None), g)
            mean[k][rows] = 0.9 * mean[k][rows] + 0.1 * g
            square[k][rows] = 0.98 * square[k][rows] + 0.02 * g * g
            plain.p[k][rows] -= now * mean[k][rows] / (np.sqrt(square[k][rows]) + 1e-7)
    for k in m.p:
        assert np.allclose(m.p[k], plain.p[k], atol=1e-5), k


def test_partial_windows():
    """Rows of every length up to several windows: each place has the log probability of its own window."""
    m, r = _model()
    n = np.arange(1, 26)
    bounds = np.concatenate([[0], np.cumsum(n)])
    ids = r.integers(0, 60, bounds[-1])
    got = m.class_log10(ids, bounds, stride=4, batch=3)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        inputs = np.append(60, ids[a : b - 1])
        for t in range(b - a):
            start = 0 if t < 6 else (t - 2) // 4 * 4
            x = inputs[start : t + 1][None]
            want = m.log_of(x, m.class_of[ids[a + start : a + t + 1]][None])[-1] / math.log(10)
            assert abs(got[a + t] - want) < 1e-5


def test_odd_width_and_many_rows():
    """An odd width has no pairs to add up; rows of any number are cut evenly."""
    r = np.random.default_rng(4)
    for width, rows in ((3, 7), (4, 64)):
        m = lm.Attention(30, 5, r.integers(0, 5, 30), width=width, window=6)
        x, y = r.integers(0, 31, (rows, 6)), r.integers(-1, 5, (rows, 6))
        at, g = m.gradients(x, y)["embed"]
        a, b = r.normal(size=(2, rows, 6, width))
        assert np.array_equal(at, np.unique(x)) and g.shape == (len(at), width)
        assert np.allclose(lm.over_windows(a, b), np.einsum("ijk,ijl->kl", a, b))
