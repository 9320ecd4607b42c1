"""The most similar reference by cells around pivots against the walk over all pairs."""

import numpy as np
import pytest

from tideline.operators import vectors

COLUMNS = "name string, embedding array<double>"


def best(probes, references, cut):
    """Plain walk: probe to (name, similarity)."""
    out = {}
    for i, p in probes:
        pairs = [(-float(np.dot(p, r)), n) for n, r in references if p and r and len(p) == len(r)]
        if pairs and 1 + min(pairs)[0] < cut:
            out[i] = min(pairs)[1], -min(pairs)[0]
    return out


def unit(x):
    return [float(v) for v in x / np.linalg.norm(x)]


def clustered(rng, n, centres, spread):
    return [unit(centres[i % len(centres)] + spread * rng.normal(size=centres.shape[1])) for i in range(n)]


@pytest.mark.parametrize("cut", [0.1, 0.6, 3.0])
def test_nearest_name_by_cells(spark, cut):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 12))
    references = [(f"n{i % 150}", v) for i, v in enumerate(clustered(rng, 600, centres, 0.2))]
    references += [("copy", references[0][1])] * 200 + [("also", references[0][1]), ("none", None), ("empty", []), ("short", [1.0, 0.0]), ("long", [2.0] * 12), ("zero", [0.0] * 12), (None, unit(rng.normal(size=12)))]
    references = [(n, v) for n, v in references if n is not None]
    probes = list(enumerate(clustered(rng, 150, centres, 0.2))) + [(500, references[0][1]), (501, None), (502, []), (503, [0.0, 3.0]), (504, [0.0] * 12), (505, [-1.0] * 12), (506, [1.0] * 5), (507, unit(rng.normal(size=12)))]
    p = spark.createDataFrame(probes, "vec_id long, embedding array<double>")
    r = spark.createDataFrame(references, COLUMNS)
    got = {x["vec_id"]: (x["name"], x["similarity"]) for x in vectors.nearest_name(p, r, cut, most=0).collect()}
    want = best(probes, references, cut)
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)
    assert {x["vec_id"]: (x["name"], x["similarity"]) for x in vectors.nearest_name(p, r, cut).collect()} == got


def test_cells_prune_and_hot_cells_are_dealt(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 12))
    references = [(f"n{i}", v) for i, v in enumerate(clustered(rng, 2000, centres, 0.1))]
    probes = list(enumerate(clustered(rng, 200, centres, 0.1)))
    p, r = spark.createDataFrame(probes, "vec_id long, embedding array<double>"), spark.createDataFrame(references, COLUMNS)
    met = vectors.reachable(p, r, 0.5, cell_rows=16)
    assert met.count() < 0.2 * len(probes) * len(references)
    got = {x["vec_id"]: x["s"] for x in met.groupBy("vec_id").agg({"similarity": "max"}).toDF("vec_id", "s").collect()}
    assert all(abs(got[i] - s) < 1e-9 for i, (_, s) in best(probes, references, 0.5).items())


def test_cells_of_empty_tables(spark):
    p = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    r = spark.createDataFrame([("a", [1.0])], COLUMNS)
    assert vectors.reachable(p, r.filter("false"), 0.0).count() == 0 and vectors.reachable(p.filter("false"), r, 0.0).count() == 0


def test_assembled_clusters_have_embeddings(spark):
    from tideline.operators import voices

    turns = [(1, 0, 0.0, 1.0, [3.0, 0.0]), (1, 0, 5.0, 9.0, [0.0, 3.0]), (1, 0, 9.0, 9.4, [9.0, 9.0]), (1, 1, 1.0, 9.0, [0.0, 2.0]), (1, 1, 1.0, 3.0, None), (1, 2, 0.0, 2.0, [1.0, 0.0]), (1, 2, 3.0, 4.0, [-1.0, 0.0]), (1, 3, 0.0, 50.0, []), (None, None, 0.0, 1.0, [0.0, 5.0])]
    schema = "k long, slot int, start_s double, end_s double, v array<double>"
    got = {(r["k"], r["slot"]): (r["id"], r["speech_s"], r["first_s"], [round(x, 6) for x in r["embedding"]]) for r in voices.assemble(spark.createDataFrame(turns, schema), ["k"], "slot", vector="v").collect()}
    half = round(0.5**0.5, 6)
    assert got == {(1, 1): (0, 8.0, 1.0, [0.0, 1.0]), (1, 0): (1, 5.0, 0.0, [half, half]), (1, 2): (2, 3.0, 0.0, [0.0, 0.0]), (None, None): (0, 1.0, 0.0, [0.0, 1.0])}
    assert voices.assemble(spark.createDataFrame([], schema), ["k"], "slot", vector="v").count() == 0
