"""Nearest neighbours of rows that the codes fit badly, against brute force."""

import numpy as np
import pytest

from tideline.llm import nearest


def drawn(kind):
    rng = np.random.default_rng(7)
    n, dim = 6000, 16
    if kind == "tight clusters":  # far more members than a shortlist holds, nearer to each other than to their codes
        return 50 * rng.normal(size=(12, dim))[rng.integers(12, size=n)] * rng.lognormal(size=(n, 1)).round(0) + 1e-3 * rng.normal(size=(n, dim))
    if kind == "few far rows":
        return rng.normal(size=(n, dim)) * np.where(np.arange(n) % 10 == 1, 1e6, 1.0)[:, None]
    if kind == "offset":
        return 1e6 + rng.normal(size=(n, dim))
    if kind == "asked rows of their own":  # clusters, and queries between them
        v = 20 * rng.normal(size=(40, dim))[rng.integers(40, size=n)] + rng.normal(size=(n, dim))
        return np.where(np.arange(n)[:, None] % 100 == 0, 12 * rng.normal(size=(n, dim)), v)
    if kind == "past single precision":
        return 1e25 * rng.normal(size=(n, dim))
    return rng.integers(0, 2, size=(n, dim)).astype(float) + np.eye(dim)[0] * 2  # ties everywhere


@pytest.mark.parametrize("kind", ["tight clusters", "few far rows", "offset", "asked rows of their own", "past single precision", "ties"])
def test_nearest_rows_are_found_however_they_lie(spark, kind):
    v = drawn(kind)
    ids = np.arange(len(v))
    got = {}
    for r in nearest.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), block_rows=1000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    missed = 0
    for q in ids[::100]:
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((ids, d)) if i != q][:10]
        assert [x[0] for x in sorted(got[q])] == list(range(1, 11))
        missed += len(set(want) - {x[1] for x in got[q]})
    assert missed == 0, f"{missed} of {10 * len(got)}"
