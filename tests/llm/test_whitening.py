import math
import random

import numpy as np
import pytest

from sparkevidence.llm import whitening

KIND = "vec_id long, embedding array<float>, x string, h1 string, weight string"


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], KIND).repartition(3)


def plain(rows, weights="one", components=16):
    """The contract in numpy, all at once."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good], object)
    fit = np.array(sorted(set(map(tuple, x))) if weights == "one" else x.tolist(), object)
    n, s = len(fit), fit.sum(axis=0)
    far = ((n * fit - s) / n).astype(float)
    cov = far.T @ far / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    out = []
    for (i, _), row in zip(good, x):
        deviation = sum(int(z) ** 2 for z in n * row - s)
        white = ((n * row - s) / n).astype(float) @ v / np.sqrt(e)
        out += [(i, k + 1, n, deviation, white[k], e[k] / np.trace(cov)) for k in range(len(e))]
    return out


@pytest.mark.parametrize("weights", ["one", "count"])
def test_against_numpy(table, weights):
    r = random.Random(3)
    hot = [r.gauss(0, 1) for _ in range(20)]
    rows = [(i, hot if i % 3 == 0 else [r.gauss(0, 1 + j / 5) for j in range(20)]) for i in range(300)]
    rows += [(900, None), (901, [float("nan")] * 20), (902, [1.0, None] + [0.0] * 18), (903, [float("inf")] + [0.0] * 19), (None, rows[1][1]), (1, rows[2][1])]
    got = whitening.whiten(table(rows), weights=weights).collect()
    want = plain(rows, weights)
    assert len(got) == len(want)
    key = lambda x: (str(x[0]), x[3], x[1])
    sign = {}
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4]
        k = a[1]
        if k not in sign and abs(b[4]) > 1e-3:
            sign[k] = 1 if a[4] * b[4] > 0 else -1
        assert math.isclose(a[4], sign.get(k, 1) * b[4], abs_tol=1e-8)
        assert math.isclose(a[5], b[5], rel_tol=1e-9)
        assert a[6] < 1e-9


def test_far_from_zero(table):
    """Entries far from zero lose no digits: centring is done in integers."""
    r = random.Random(4)
    rows = [(i, [1000.0 + r.randint(-3, 3) / 64 for _ in range(4)]) for i in range(200)]
    got = whitening.whiten(table(rows)).collect()
    assert {x["vec_id"] for x in got} == set(range(200)) and all(x["identity_error"] < 1e-9 for x in got)


def test_no_spread_and_odd_tables(table):
    one = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [1.0, 0.25]), (4, [0.5]), (5, [])]
    got = {(x["vec_id"], x["component"]): x for x in whitening.whiten(table(one)).collect()}
    assert set(got) == {(i, k) for i in (1, 2, 3) for k in (1, 2)}
    assert got[1, 2]["whitened"] is None and abs(got[1, 1]["whitened"]) == pytest.approx(1) and got[1, 1]["explained"] == pytest.approx(1)
    same = whitening.whiten(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(x["whitened"] is None and x["deviation"] == 0 and x["identity_error"] is None for x in same)
    assert whitening.whiten(table([(1, None)])).count() == 0
    assert whitening.whiten(table([])).count() == 0
