import math

import numpy as np
import pytest

from factloom.llm import whitening


def plain(vectors):
    """Grid rows, and what a direct computation over the distinct ones gives."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    listed = np.array(sorted({tuple(r) for r in x}), dtype=object)
    sums, n = listed.sum(axis=0), len(listed)
    centred = np.array(listed - 1_000_000, dtype=float) - np.array([(s - 1_000_000 * n) / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviations = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    return x, n, sums, values[::-1], vectors[:, ::-1], deviations


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, deviation string")


def test_same_as_a_direct_computation(spark):
    draw = np.random.default_rng(3)
    vectors = (draw.normal(size=(700, 20)) * np.linspace(0.2, 3, 20) + 5).astype(np.float32).tolist()
    vectors += [vectors[0]] * 400
    rows = [(k, v, "old") for k, v in enumerate(vectors)]
    bad = [(9000, None, ""), (9001, [], ""), (9002, [1.0] * 19 + [None], ""), (9003, [float("nan")] * 20, ""), (9004, [float("inf")] * 20, ""), (9005, [3e38] * 20, ""), (9006, [1.0], ""), (None, vectors[3], "")]
    got, model = whitening.whiten(table(spark, rows + bad).repartition(7), components=16)
    x, n, sums, values, basis, deviations = plain([*vectors, vectors[3]])
    found = {r.vec_id: r for r in got.collect()}
    assert set(found) == {*range(1100), None} and got.columns == ["vec_id", "embedding", "deviation", "whitened"]
    assert model.n == n == 700 and model.sums == list(sums) and model.identity_error < 1e-9
    assert np.allclose(model.explained, values[:16] / values.sum(), rtol=1e-9)
    centred = np.array(x, dtype=float) - np.array(sums, dtype=float) / n
    want = centred @ (basis[:, :16] / np.sqrt(values[:16]))
    have = np.array([found[k].whitened for k in [*range(1100), None]])
    assert np.allclose(have * np.sign((have * want).sum(axis=0)), want, atol=1e-6)
    assert [int(found[k].deviation) for k in [*range(1100), None]] == deviations


@pytest.mark.parametrize("cuts", [[1, 2, 3, 300], [150], [0, 299]])
def test_merged_moments_are_those_of_all(cuts):
    x = np.random.default_rng(1).integers(-50, 50, (300, 5)) + 10**9
    merged = whitening.NOTHING
    for part in np.split(x, cuts):
        merged = merged.merged(whitening._block(part) if len(part) else whitening.NOTHING)
    near = (x - 10**9).astype(float)
    assert merged.n == 300 and merged.sums == x.sum(axis=0).tolist()
    assert np.allclose(merged.scatter, (near - near.mean(axis=0)).T @ (near - near.mean(axis=0)), rtol=1e-12)


def test_flat_components_and_odd_tables(spark):
    flat = [(k, [float(k % 5), 2.0, float(k % 5)], "") for k in range(10)]
    got, model = whitening.whiten(table(spark, flat))
    assert model.n == 5 and model.spread.tolist() == [True, False, False] and model.identity_error < 1e-9
    assert all(r.whitened[1:] == [0, 0] for r in got.collect())
    got, model = whitening.whiten(table(spark, [(1, [1.0, 2.0], "")] * 3))
    assert model.n == 1 and [(r.whitened, int(r.deviation)) for r in got.collect()] == [([0, 0], 0)] * 3
    got, model = whitening.whiten(table(spark, []))
    assert model is None and got.collect() == [] and got.columns == ["vec_id", "embedding", "deviation", "whitened"]
    # Beyond a long, deviations stay exact.
    got, _ = whitening.whiten(table(spark, [(1, [2.0**40, 0.0], ""), (2, [-(2.0**40), 1.0], "")]))
    want = 2 * ((2**46) ** 2) * 0 + (2**47) ** 2 + 64**2
    assert [int(r.deviation) for r in got.collect()] == [want, want]
