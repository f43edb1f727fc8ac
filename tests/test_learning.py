"""Cross-validation by blocks and the network, against single-process versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.operators import crossval, grid, network

ROWS = "id long, block string, a double, b double, y double"


def table(seed=1, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(50, 2), rng.gauss(0, 1)
        rows.append((i, rng.choice(["x", "y", "z"]), a, b, 2 * a - 3 * b + rng.gauss(0, 0.5) + 7))
    return rows + [(n, None, 1.0, 1.0, 1.0), (n + 1, "x", None, 1.0, 1.0), (n + 2, "x", 1.0, float("nan"), 1.0), (n + 3, "y", 1.0, 1.0, float("inf"))]


def whole(rows):
    return [r for r in rows if all(v is not None and math.isfinite(v) for v in r[2:])]


def test_cross_validation_equals_fits_without_each_fold(spark):
    rows = table()
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    got = crossval.cross_validated(df, "y", {"a": F.col("a"), "b": F.col("b"), "ab": F.col("a") * F.col("b")}, F.col("block")).collect()
    use = [r for r in whole(rows) if r[1]]
    assert {r.fold for r in got} == {"x", "y", "z"} and len(got) == 12
    for fold in "xyz":
        design = lambda part: np.array([[1, r[2], r[3], r[2] * r[3]] for r in part])
        train, test = [r for r in use if r[1] != fold], [r for r in use if r[1] == fold]
        beta = np.linalg.lstsq(design(train), np.array([r[4] for r in train]), rcond=None)[0]
        rmse = math.sqrt(np.mean((design(test) @ beta - np.array([r[4] for r in test])) ** 2))
        mine = [r for r in got if r.fold == fold]
        assert [r.term for r in mine] == ["intercept", "a", "b", "ab"]
        assert [r.coefficient for r in mine] == pytest.approx(list(beta), rel=1e-6) and mine[0].rmse == pytest.approx(rmse, rel=1e-8)
        assert {(r.n_train, r.n_test) for r in mine} == {(len(train), len(test))}


def test_cross_validation_of_odd_tables(spark):
    df = spark.createDataFrame(table(), ROWS)
    one = crossval.cross_validated(df.filter("block = 'x'"), "y", {"a": F.col("a")}, F.col("block")).collect()
    assert [(r.coefficient, r.rmse, r.n_train) for r in one] == [(None, None, 0)] * 2
    assert crossval.cross_validated(df.limit(0), "y", {"a": F.col("a")}, F.col("block")).collect() == []
    same = crossval.cross_validated(df, "y", {"a": F.col("a"), "again": F.col("a"), "c": F.lit(3.0)}, F.col("block")).collect()
    alone = crossval.cross_validated(df, "y", {"a": F.col("a")}, F.col("block")).collect()
    assert {r.fold: r.rmse for r in same} == pytest.approx({r.fold: r.rmse for r in alone})


def plain_training(rows, units, steps, batches, rate, seed):
    x, y = np.array([[r[2], r[3]] for r in rows]), np.array([r[4] for r in rows])
    batch = np.array([int(hashlib.md5(f"{r[0]}|{seed}".encode()).hexdigest()[:8], 16) % batches for r in rows])
    scaling = [(x[:, 0].mean(), x[:, 0].std()), (x[:, 1].mean(), x[:, 1].std()), (y.mean(), y.std())]
    x, y = (x - [s[0] for s in scaling[:2]]) / [s[1] for s in scaling[:2]], (y - scaling[2][0]) / scaling[2][1]
    hidden, out = network.start(2, units, seed)
    w, v, losses = np.array(hidden), np.array(out), []
    mean = lambda g: np.floor(g * network.SCALE + 0.5).sum(0) / len(g) / network.SCALE
    for step in range(steps):
        xs, ys = x[batch == step % batches], y[batch == step % batches]
        h = np.tanh(xs @ w[:, :2].T + w[:, 2])
        e = h @ v[:-1] + v[-1] - ys
        losses.append((step, len(ys), float(mean(e * e / 2))))
        back = e[:, None] * v[:-1] * (1 - h * h)
        dv = np.append(mean(e[:, None] * h), mean(e))
        dw = np.stack([np.append(mean(back[:, [j]] * xs), mean(back[:, j])) for j in range(units)])
        v, w = v - rate * dv, w - rate * dw
    return losses, w, v, scaling


def test_network_equals_a_single_process(spark):
    rows = table(2)
    df = spark.createDataFrame(rows, ROWS)
    how = {"units": 4, "steps": 12, "batches": 3, "rate": 0.3, "seed": 5}
    net, losses = network.train(df.repartition(5), "y", ("a", "b"), ["id"], **how)
    want, w, v, scaling = plain_training(whole(rows), **how)
    assert [x[:2] for x in losses] == [x[:2] for x in want] and [x[2] for x in losses] == pytest.approx([x[2] for x in want], abs=1e-7)
    assert np.array(net.hidden) == pytest.approx(w, abs=1e-6) and net.out == pytest.approx(list(v), abs=1e-6)
    assert losses[-1][2] < 0.5 * losses[0][2]
    assert network.train(df.repartition(2, "b"), "y", ("a", "b"), ["id"], **how)[1] == losses  # whatever the partitioning
    told = {r.id: r.p for r in df.select("id", net.predict().alias("p")).collect()}
    for r in whole(rows)[:20]:
        x = [(r[2 + i] - scaling[i][0]) / scaling[i][1] for i in range(2)]
        h = np.tanh(w[:, :2] @ x + w[:, 2])
        assert told[r[0]] == pytest.approx(float(h @ v[:-1] + v[-1]) * scaling[2][1] + scaling[2][0], abs=1e-4)


def test_network_of_odd_tables(spark):
    df = spark.createDataFrame(table(), ROWS)
    net, losses = network.train(df.limit(0), "y", ("a",), ["id"], units=2, steps=2)
    assert losses == [(0, 0, None), (1, 0, None)]
    flat = df.withColumn("a", F.lit(3.0))
    assert all(x[2] is not None for x in network.train(flat, "y", ("a",), ["id"], units=2, steps=2, batches=1)[1])
    with pytest.raises(ValueError, match="weights"):
        network.train(df, "y", ("a", "b"), ["id"], units=5000)


def test_axis_order(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (None,), (2.0,)], "x double")
    assert [tuple(r) for r in grid.axis_order(df, "x").orderBy("pos").collect()] == [(0, 1.0), (1, 2.0), (2, 3.0)]
