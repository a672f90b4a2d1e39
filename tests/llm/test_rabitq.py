import math
import random

import numpy as np
import pytest

from attest.llm import rabitq

from .helpers import collected
from .test_simhash import brute_components


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=64), rng.normal(size=64)
    y = 0.8 * x / np.linalg.norm(x) + 0.6 * y / np.linalg.norm(y)
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    errors, deviations = [], []
    for seed in range(300):
        turn = rabitq.rotation(64, 128, seed)
        assert np.allclose(turn.T @ turn, np.eye(64), atol=1e-6)
        signs, factor = rabitq.codes(x[None], turn)
        value, deviation = rabitq.estimates(signs, factor, (y @ turn.T)[None])
        errors.append(value[0] - x @ y)
        deviations.append(deviation[0])
    assert abs(np.mean(errors)) < 4 * np.std(errors) / math.sqrt(300)
    assert np.mean(np.abs(errors) <= 2 * np.array(deviations)) > 0.9 and np.abs(errors).max() <= rabitq.SIGMAS * max(deviations)


def test_bands_reach_the_recall():
    for n in (10, 10_000, 10 ** 8):
        width, bands = rabitq.plan(n, 0.95, 0.99)
        assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** width) ** bands >= 0.99


def vectors(seed, n=300, dimensions=16):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        centre = rng.normal(size=dimensions)
        out += [centre + rng.normal(size=dimensions) * rng.choice([0.02, 0.15, 0.4]) for _ in range(int(rng.integers(1, 30)))]
    return [v.astype(np.float32).tolist() for v in out[:n]]


def brute(rows, threshold):
    links, near = {i: 0 for i, _ in rows}, []
    unit = []
    for _, v in rows:
        a = None if v is None or any(x is None for x in v) else np.array(v, float)
        ok = a is not None and len(a) and np.isfinite(a).all() and a.any()
        unit.append(a / np.linalg.norm(a) if ok else None)
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                near.append((rows[i][0], rows[j][0]))
                links[rows[i][0]] += 1
                links[rows[j][0]] += 1
    return links, brute_components(near, [i for i, _ in rows])


@pytest.mark.parametrize("block", [256, 7])
def test_links_and_components(spark, block):
    own = vectors(block)
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] + [1.0] * 15]
    rows = list(enumerate([*own, own[0], own[0], [2 * x for x in own[0]], [1.0, 2.0], [1.0, 2.01], *bad]))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    got = {r["vec_id"]: r for r in collected(rabitq.near_vectors(df, recall=0.99999, block=block))}
    links, component = brute(rows, 0.95)
    assert len(got) == len(rows)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (links[i], component[i], component[i] == i) for i, _ in rows}


def test_recall_of_the_default(spark):
    rows = list(enumerate(vectors(5, 1500, 64)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links, _ = brute(rows, 0.95)
    got = {r["vec_id"]: r["n_links"] for r in collected(rabitq.near_vectors(df))}
    assert all(got[i] <= n for i, n in links.items()) and sum(got.values()) >= 0.98 * sum(links.values()) > 0


def test_empty_table_and_nulls(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, None), (4, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in collected(rabitq.near_vectors(df))) == [("4", 1, "4"), ("None", 0, "None"), ("None", 1, "4")]
    assert collected(rabitq.near_vectors(df.limit(0))) == []
