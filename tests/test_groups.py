"""Quantiles and box plots of groups: both ways of meeting the groups, and what the plans move."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.operators import stats


def table(spark, n=4000, seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 20 + [None] + [f"g{k}" for k in range(40)]), rng.choice([1.0, 2.0, rng.gauss(0, 9), None])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(4)


@pytest.mark.parametrize(("few", "bound"), [(100_000, None), (100_000, 42), (10, None), (1, None)])
def test_rows_meet_their_groups(spark, few, bound):
    rows, df = table(spark)
    groups = df.groupBy("k").agg(F.count("*").alias("n"))
    got = stats.with_groups(df, groups, ["k"], "n", bound, few).select("r.k", "v", "n").collect()
    size = {r.k: r.n for r in groups.collect()}
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((k, v, size[k])) for k, v in rows)


@pytest.mark.parametrize("few", [100_000, 10, 1])
@pytest.mark.parametrize("levels", [1, 2])
def test_quantiles_are_the_same_both_ways(spark, monkeypatch, few, levels):
    rows, df = table(spark)
    monkeypatch.setattr(stats, "with_groups", functools.partial(stats.with_groups, few=few))
    got = {r.k: r for r in stats.exact_quantiles(df, ["k"], "v", [0.1, 0.5, 0.99], levels=levels, accuracy=100).collect()}
    for k in {r[0] for r in rows}:
        v = [x for key, x in rows if key == k and x is not None]
        assert got[k].n == len(v) and got[k].q == pytest.approx(list(np.quantile(v, [0.1, 0.5, 0.99])))


@pytest.mark.parametrize("few", [100_000, 3])
def test_boxes_are_the_same_both_ways(spark, monkeypatch, few):
    rows, df = table(spark)
    monkeypatch.setattr(stats, "with_groups", functools.partial(stats.with_groups, few=few))
    out = {r.k: r for r in stats.box_statistics(df, ["k"], "v", [F.sum("v").alias("total")]).collect()}
    assert None not in out
    for k in {r[0] for r in rows} - {None}:
        v = np.array([x for key, x in rows if key == k and x is not None])
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert tuple(out[k])[1:7] == pytest.approx((len(v), q1, q2, q3, inside.min(), inside.max())) and out[k].total == pytest.approx(v.sum())
    assert stats.box_statistics(df.limit(0), ["k"], "v").collect() == []


def test_raw_rows_are_not_moved_to_their_groups(spark):
    """Without adaptive execution and without automatic broadcasts: every exchange is of partial sums."""
    _, df = table(spark)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = stats.exact_quantiles(df, ["k"], "v", [0.25, 0.5], bound=50)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lines = plan.split("\n")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert any(x in lines[i + 1] for x in ("HashAggregate", "ObjectHashAggregate", "SortAggregate")), lines[i + 1]
