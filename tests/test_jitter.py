"""The jitter spline against one least-squares solution and known waves."""

import numpy as np
import pytest

from tielace.operators import jitter


def spline_value(t, i, k, x, last):
    """The recursion for one B-spline, as it is defined."""
    if k == 0:
        return float(t[i] <= x < t[i + 1] or (x == last and t[i] < x == t[i + 1]))
    a = (x - t[i]) / (t[i + k] - t[i]) * spline_value(t, i, k - 1, x, last) if t[i + k] > t[i] else 0.0
    b = (t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) * spline_value(t, i + 1, k - 1, x, last) if t[i + k + 1] > t[i + 1] else 0.0
    return a + b


def test_basis_by_its_definition():
    interior = np.array([2.0, 3.5, 7.0])
    t = [0.0] * 4 + interior.tolist() + [10.0] * 4
    x = np.array([0.0, 0.5, 2.0, 3.4, 6.99, 9.0, 10.0])
    got = jitter.basis(x, interior, 0.0, 10.0)
    assert np.allclose(got.sum(axis=1), 1) and np.allclose(got, [[spline_value(t, i, 3, v, 10.0) for i in range(7)] for v in x])


def rows_of(spark, rows):
    return spark.createDataFrame([(g, float(r), float(x), float(y)) for g, r, x, y in rows], "group string, row double, dx double, dy double")


def test_a_wave_is_found_again(spark):
    rng = np.random.default_rng(4)
    rows, seen = [], {}
    for g, (length, high) in {"slow": (100.0, 0.8), "quick": (50.0, 0.3)}.items():
        at = np.sort(rng.integers(0, 200, 900)).astype(float)
        dx, dy = high * np.sin(2 * np.pi * at / length), np.zeros(900)
        noise = rng.normal(0, 0.02, (900, 2))
        seen[g] = (at, np.c_[dx, dy] + noise)
        rows += [(g, *r) for r in zip(at, dx + noise[:, 0], dy + noise[:, 1], strict=True)]
    rows += [("few", float(k), 0.1, 0.2) for k in range(39)] + [("one", 5.0, 0.1, 0.2)] * 100 + [(None, float(k % 60), 0.5, 0.5) for k in range(600)]
    frame = rows_of(spark, rows)
    found = jitter.fit(frame)
    got = {r["group"]: r for r in found.collect()}
    assert sorted(got, key=str) in (["quick", "slow"], [None, "quick", "slow"])
    for g, (length, high) in {"slow": (100.0, 0.8), "quick": (50.0, 0.3)}.items():
        at, d = seen[g]
        distinct = np.unique(at)
        means = np.stack([d[at == r].mean(axis=0) for r in distinct])
        k = min(12, max(2, len(distinct) // 8))
        interior = np.unique(np.quantile(distinct, np.linspace(0, 1, k + 2)[1:-1]))
        b = jitter.basis(distinct, interior, distinct[0], distinct[-1])
        c = np.linalg.lstsq(b, means, rcond=None)[0]
        places = np.linspace(distinct[0], distinct[-1], 200)
        want = jitter.basis(places, interior, distinct[0], distinct[-1]) @ c
        r = got[g]
        assert np.allclose(r["rows"], places) and np.allclose(np.c_[r["dx"], r["dy"]], want, atol=1e-7)
        assert (r["n_knots"], r["n_rows"]) == (len(interior), len(distinct))
        assert r["rms_after"] == pytest.approx(np.sqrt(((means - b @ c) ** 2).sum() / len(distinct)), abs=1e-6)
        assert r["amplitude"] == pytest.approx(high, rel=0.1)
        # The jitter's length bends twice a wave.
        assert r["period"] == pytest.approx(length / 2, rel=0.12)
    left = {(r["group"], r["row"]): r for r in jitter.at_rows(frame, found).collect()}
    close = [r["dx"] - r["jitter_x"] for k, r in left.items() if k[0] in ("slow", "quick")]
    assert np.sqrt(np.mean(np.square(close))) < 0.05
    assert all(r["jitter_x"] is None for k, r in left.items() if k[0] in ("few", "one"))
    far = jitter.at_rows(rows_of(spark, [("slow", -50.0, 0, 0), ("slow", 1e6, 0, 0)]), found).orderBy("row").collect()
    assert [r["jitter_x"] for r in far] == [got["slow"]["dx"][0], pytest.approx(got["slow"]["dx"][-1])]
    assert jitter.fit(frame.limit(0)).count() == 0
