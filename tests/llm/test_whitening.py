"""Bit-sliced moments against plain integers, whitening against numpy."""

import math

import numpy as np
import pytest

from barloom.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int, component string, x string"


def frame(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(i, v, 0, "c", "y") for i, v in rows], schema)


def plain(rows, k=4):
    """What the contract says, by integers and numpy."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(t) for t in {tuple(x) for _, x in good}]
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    v = np.array([[(n * sum(x[i] * x[j] for x in fit) - s[i] * s[j]) / n**2 for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        out[i] = n, sum((n * a - b) ** 2 for a, b in zip(x, s)), (np.array([a - b / n for a, b in zip(x, s)]) @ u) / np.sqrt(e), e / np.trace(v)
    return out


def test_against_plain_integers(spark):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(600, 12)) @ rng.normal(size=(12, 12)) * 0.3
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(mixed)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, [float("nan")] * 12), (1004, [None] + [0.0] * 11), (1005, [float("inf")] * 12), (1006, [0.0] * 12), (1007, [-0.0] * 12), (1008, [1.0] * 5)]
    want = plain([r for r in rows if r[0] != 1008])
    got = {}
    for r in whitening.whitened(frame(spark, rows)).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert got.keys() == want.keys() and all(set(g) == {1, 2, 3, 4} for g in got.values())
    signs = np.sign([got[5][c].whitened * want[5][2][c - 1] for c in range(1, 5)])
    for i, (n, deviation, white, explained) in want.items():
        for c in range(1, 5):
            row = got[i][c]
            assert (row.n, row.deviation) == (n, deviation)
            assert row.whitened * signs[c - 1] == pytest.approx(white[c - 1], rel=1e-8, abs=1e-9)
            assert row.explained == pytest.approx(explained[c - 1], rel=1e-9)
            assert 0 <= row.identity_error < 1e-9


@pytest.mark.parametrize("low, high, rows", [(-80, 80, 700), (5, 6, 3), (0, 1, 64), (-2**62, 2**62, 130), (-2**63, 2**63 - 1, 65), (-2**30, 2**30, 100)])
def test_scatter_is_exact(low, high, rows):
    x = np.random.default_rng(rows).integers(low, high, (rows, 5), endpoint=True)
    sums, cross = whitening.scatter(x)
    plain = x.astype(object)
    assert sums.tolist() == plain.sum(axis=0).tolist() and (cross == plain.T @ plain).all()


def test_digits_restore_any_number():
    for value in (0, 1, -1, 2**32, -(2**70) - 5, 3**90):
        assert sum(v << (whitening.DIGIT * k) for k, v in whitening.digits(value)) == value


def test_huge_entries(spark):
    rows = [(k, [float(3e38 if k % 2 else -3e38), float(k)]) for k in range(20)]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert {r.component for r in got} <= {1, 2} and all(r.deviation is None for r in got) and len(got) >= 20


def test_fewer_components(spark):
    assert whitening.whitened(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])])).count() == 0  # no variance
    line = whitening.whitened(frame(spark, [(k, [k / 4, k / 2, 0.0, 0.0, 1.0]) for k in range(9)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 9 and all(abs(r.explained - 1) < 1e-9 for r in line)
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, []), (2, None)])).count() == 0
