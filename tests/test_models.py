"""Trees, random intercepts and normality against plain versions of them on small tables."""

import math
import random
import re
from statistics import NormalDist

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.operators import extensions, mixed, ranks, trees

# --- trees


def tree_rows(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.choice([None, float("nan"), *[rng.gauss(0, 2) for _ in range(8)]]), float(rng.randint(0, 5))
        y = (3.0 if (a or 0) > 0.5 else -1.0) + (b > 3) * 2 + rng.gauss(0, 0.2)
        out.append((i, a, b, 1.0, rng.choice([y] * 30 + [None, float("nan")])))
    return out


ROWS = "id long, a double, b double, c double, y double"
NAMES = ("a", "b", "c")


def missing(x):
    return x is None or math.isnan(x)


def brute_tree(rows, edges, grads, weights, depth, least, l2, allowed=lambda node: range(3)):
    """{node: (feature, bin)} and {node: (g, n)} by trying every split of every node."""
    bins = [[-1 if missing(r[1 + f]) else sum(e < r[1 + f] for e in edges[f]) for f in range(3)] for r in rows]
    splits, sums = {}, {}

    def visit(node, who, level):
        g, n = sum(weights[i] * grads[i] for i in who), sum(weights[i] for i in who)
        if not n:
            return
        sums[node] = (g, n)
        best = None
        for f in allowed(node) if level < depth else ():
            for b in sorted({bins[i][f] for i in who if weights[i]}):
                left = [i for i in who if bins[i][f] <= b]
                gl, nl = sum(weights[i] * grads[i] for i in left), sum(weights[i] for i in left)
                if nl >= least and n - nl >= least:
                    gain = float(gl) * gl / (nl + l2) + float(g - gl) * (g - gl) / (n - nl + l2) - float(g) * g / (n + l2)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, b, left)
        if best:
            splits[node] = best[1:3]
            visit(2 * node, best[3], level + 1)
            visit(2 * node + 1, [i for i in who if i not in set(best[3])], level + 1)

    visit(1, range(len(rows)), 0)
    return splits, sums


def value_of(tree, edges, row, l2):
    node = 1
    while node in tree.splits:
        f, b = tree.splits[node]
        node = 2 * node + (not missing(row[1 + f]) and sum(e < row[1 + f] for e in edges[f]) > b)
    return tree.value(node, l2)


def test_boosted_trees(spark, monkeypatch):
    monkeypatch.setattr(trees, "REFRESH", 2)
    data = tree_rows()
    df = spark.createDataFrame(data, ROWS)
    how = {"rounds": 5, "depth": 3, "bins": 6, "rate": 0.4, "least": 8, "l2": 1.0}
    model = trees.boosted(df, "y", NAMES, **how)
    rows = [r for r in data if not missing(r[4])]
    for f in range(3):
        x = [r[1 + f] for r in rows if not missing(r[1 + f])]
        assert model.edges[f] == pytest.approx(np.quantile(x, [k / 6 for k in range(1, 6)]))
    units = lambda v: math.floor(v * trees.SCALE + 0.5)
    told = [model.base] * len(rows)
    assert model.base == sum(units(r[4]) for r in rows) / len(rows) / trees.SCALE
    for t in model.trees:
        splits, sums = brute_tree(rows, model.edges, [units(r[4] - p) for r, p in zip(rows, told)], [1] * len(rows), 3, 8, 1.0)
        assert (t.splits, t.sums) == (splits, sums)
        told = [p + 0.4 * value_of(t, model.edges, r, 1.0) for r, p in zip(rows, told)]
    assert np.mean([(r[4] - p) ** 2 for r, p in zip(rows, told)]) < 0.3 * np.var([r[4] for r in rows])
    got = {r.id: r.p for r in df.select("id", model.predict().alias("p")).collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(told) and all(p is not None for p in got.values())
    assert trees.boosted(df.repartition(7, "b"), "y", NAMES, **how) == model  # the same, however the rows are dealt
    db = duckdb.connect()
    db.execute("create table t (id bigint, a double, b double, c double, y double)")
    db.executemany("insert into t values (?, ?, ?, ?, ?)", data)
    assert dict(db.execute(f"select id, {model.to_sql()} from t").fetchall()) == pytest.approx(got)


def test_random_forest(spark):
    data = [r for r in tree_rows(2) if not missing(r[4])]
    df = spark.createDataFrame(data, ROWS)
    model = trees.forest(df, "y", NAMES, ["id"], trees=6, depth=4, bins=6, each=2, least=3, seed=9)
    drawn = df.select("id", *(c.alias(f"d{k}") for k, c in enumerate(trees.draws(["id"], 6, 9)))).collect()
    times = {r.id: r[1:] for r in drawn}
    assert 0.9 < np.mean([sum(v) / 6 for v in times.values()]) < 1.1 and max(max(v) for v in times.values()) > 2
    choice = trees.feature_choice(9, 3, 2)
    for k, t in enumerate(model.trees):
        g = [math.floor(r[4] * trees.SCALE + 0.5) for r in data]
        splits, sums = brute_tree(data, model.edges, g, [times[r[0]][k] for r in data], 4, 3, 0.0, lambda node, k=k: choice(k, node))
        assert (t.splits, t.sums) == (splits, sums)
    got = {r.id: r.p for r in df.select("id", trees.out_of_bag(model, ["id"], 9).alias("p")).collect()}
    for r in data:
        free = [value_of(t, model.edges, r, 0.0) for k, t in enumerate(model.trees) if not times[r[0]][k]]
        assert (got[r[0]] is None) if not free else got[r[0]] == pytest.approx(np.mean(free))


def test_trees_of_odd_tables(spark):
    empty = spark.createDataFrame([], ROWS)
    model = trees.boosted(empty, "y", NAMES, rounds=2)
    assert model.base == 0 and all(not t.splits for t in model.trees)
    assert trees.forest(empty, "y", NAMES, ["id"], trees=2).nodes() == []
    same = spark.createDataFrame([(i, 1.0, None, float("nan"), 2.5) for i in range(30)], ROWS)
    flat = trees.boosted(same, "y", NAMES, rounds=2, least=1)
    assert not any(t.splits for t in flat.trees) and flat.base == 2.5
    assert {r.p for r in same.select(flat.predict().alias("p")).collect()} == {2.5}


# --- random intercepts


def dense(cells, x, y):
    """REML by the textbook: dense covariances, a fine search over the ratio."""
    n, p = len(y), x.shape[1]
    same = (cells[:, None] == cells[None, :]).astype(float)

    def fit(ratio):
        inv = np.linalg.inv(np.eye(n) + ratio * same)
        a = x.T @ inv @ x
        beta = np.linalg.solve(a, x.T @ inv @ y)
        e = y - x @ beta
        rss = float(e @ inv @ e)
        l2 = np.linalg.slogdet(np.eye(n) + ratio * same)[1] + np.linalg.slogdet(a)[1] + (n - p) * math.log(rss / (n - p)) + (n - p) * (1 + math.log(2 * math.pi))
        return l2, beta, rss / (n - p), np.sqrt(np.diag(np.linalg.inv(a)) * rss / (n - p))

    low, high = -9.0, 6.0
    for _ in range(60):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if fit(10**a)[0] < fit(10**b)[0] else (a, high)
    ratio = 10 ** ((low + high) / 2)
    if fit(0.0)[0] <= fit(ratio)[0]:
        ratio = 0.0
    l2, beta, error, se = fit(ratio)
    return ratio, beta, error, se, -l2 / 2


@pytest.mark.parametrize(("seed", "between"), [(1, 1.5), (2, 0.3), (3, 0.0)])
def test_random_intercept_equals_a_dense_solution(spark, seed, between):
    rng = np.random.default_rng(seed)
    sizes = [1, 1, 1, 2, 3, 5, 8, 13, 13, 13, 20]
    cells = np.repeat(np.arange(len(sizes)), sizes)
    a, b = rng.normal(size=len(cells)) + 100, rng.normal(size=len(cells)) * 3
    y = 5 + 0.7 * a - 0.2 * b + between * rng.normal(size=len(sizes))[cells] + rng.normal(size=len(cells))
    rows = [(int(c), float(u), float(v), float(w)) for c, u, v, w in zip(cells, a, b, y)]
    rows += [(1, None, 1.0, 2.0), (1, 1.0, 1.0, float("nan")), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "cell int, a double, b double, y double").repartition(3)
    out = {r.term: r for r in mixed.random_intercept(df, "y", {"a": F.col("a"), "twice": 2 * F.col("a") + 1, "b": F.col("b")}, ["cell"]).collect()}
    ratio, beta, error, se, log = dense(cells, np.column_stack([np.ones(len(cells)), a, b]), y)
    assert out["twice"].estimate is None  # a linear function of a
    for k, t in enumerate(("intercept", "a", "b")):
        assert out[t].estimate == pytest.approx(beta[k], rel=1e-5, abs=1e-5) and out[t].se == pytest.approx(se[k], rel=1e-4)
    assert out["var_error"].estimate == pytest.approx(error, rel=1e-5) and out["var_cell"].estimate == pytest.approx(ratio * error, rel=1e-4, abs=1e-6)
    assert out["log_likelihood"].estimate == pytest.approx(log, rel=1e-8)
    assert (out["n"].estimate, out["n_cells"].estimate) == (len(cells), len(sizes))


def test_random_intercept_of_odd_tables(spark):
    kind = "cell int, x double, y double"
    fit = lambda rows: {r.term: (r.estimate, r.se) for r in mixed.random_intercept(spark.createDataFrame(rows, kind), "y", {"x": F.col("x")}, ["cell"]).collect()}
    assert fit([])["n"] == (0.0, None) and fit([])["var_cell"] == (None, None)
    exact = fit([(i % 3, float(i), 2.0 * i + 1) for i in range(9)])  # no residual variance
    assert exact["x"][0] == pytest.approx(2.0) and exact["intercept"][0] == pytest.approx(1.0) and exact["var_error"] == (None, None)
    constant = fit([(i % 3, 4.0, float(i * i % 7)) for i in range(12)])  # a predictor without variance
    assert constant["x"] == (None, None) and constant["var_error"][0] > 0
    assert fit([(1, 2.0, 3.0)])["intercept"][0] == pytest.approx(3.0)


def test_random_intercept_of_folded_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(int(c), float(x), float(300 + 0.5 * x + 2 * c + e)) for c, x, e in zip(rng.integers(0, 9, 400), rng.integers(0, 6, 400), rng.normal(size=400))]
    df = spark.createDataFrame(rows, "cell int, x double, y double")
    folded = df.groupBy("cell", "x").agg(F.count("*").alias("n"), F.avg("y").alias("y"), (F.var_pop("y") * F.count("*")).alias("spread"))
    want = mixed.random_intercept(df, "y", {"x": F.col("x")}, ["cell"]).collect()
    got = mixed.random_intercept(folded, "y", {"x": F.col("x")}, ["cell"], folded=("n", "spread")).collect()
    assert folded.count() < len(rows) and [r.term for r in got] == [r.term for r in want]
    for a, b in zip(got, want):
        assert a.estimate == pytest.approx(b.estimate, rel=1e-8) and (a.se is None) == (b.se is None) and (a.se is None or a.se == pytest.approx(b.se, rel=1e-8))


def test_pairing_is_compiled(spark, sf_dir, capsys):
    """The JVM never compiles a method of 8,000 bytes or more."""
    from isotherm.plans import registry
    from isotherm.plans.fixtures import grids

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        registry._pairs(grids(spark, sf_dir)).groupBy("clat_ix", "clon_ix").agg(F.sum("t2m")).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_predictions_of_trees_read_the_written_rows(spark, sf_dir):
    from isotherm.plans import registry

    files = registry.QUERIES["random_forest_out_of_bag"](spark, sf_dir).inputFiles()
    assert files and all("/tree-rows-" in f for f in files)  # the pairs aren't made again


# --- ranks and normality


def test_ranks_are_global(spark):
    rng = random.Random(3)
    x = [rng.choice([1.0, 1.0, 1.0, 2.5, rng.random(), None]) for _ in range(3000)]
    got = ranks.ranked(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").repartition(6), "x").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(x) + 1)) and sorted(r.i for r in got) == list(range(len(x)))
    assert [r.x for r in sorted(got, key=lambda r: r["rank"])] == sorted(x, key=lambda v: (v is not None, v or 0))


def test_equal_values_are_spread(spark, tmp_path):
    df = spark.range(40_000).select(F.lit(1.0).alias("x"))
    path = str(tmp_path / "ranks")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        assert ranks.ranked(df, "x", path).agg(F.count_distinct("rank")).first()[0] == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["count"] for r in spark.read.parquet(path).groupBy("part_").count().collect()]
    assert len(parts) > 1 and max(parts) < 20_000


def test_normal_quantile(spark):
    p = [1e-300, 1e-12, 1e-5, 0.0749, 0.075, 0.2, 0.5, 0.9249, 0.926, 0.999, 1 - 1e-12]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(p)], "k int, p double").select(ranks.normal_quantile(F.col("p")).alias("z"), "k").orderBy("k").collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-12, abs=1e-15)


def plain_shapiro(x):
    x, n, inv = np.sort(x), len(x), NormalDist().inv_cdf
    m = np.array([inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = 1 / math.sqrt(n), float(m @ m)
    poly = lambda c, v: sum(k * v**i for i, k in enumerate(c))
    a = m.copy()
    last = poly(ranks.LAST_WEIGHT, u) + m[-1] / math.sqrt(mm)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    elif n <= 5:
        a /= math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[0], a[-1] = -last, last
    else:
        second = poly(ranks.NEXT_WEIGHT, u) + m[-2] / math.sqrt(mm)
        a /= math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a[[0, 1, -2, -1]] = -last, -second, second, last
    return float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum())


@pytest.mark.parametrize("n", [3, 4, 5, 6, 11, 12, 50, 6000])
def test_shapiro_wilk(spark, n):
    rng = np.random.default_rng(n)
    for x in (rng.normal(size=n) * 3 + 1000, np.round(rng.exponential(size=n), 1) + np.arange(n) * 1e-3):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(3)
        got = ranks.shapiro_wilk(df, "v", extensions._normal_cdf).first()
        assert got.n == n and got.w == pytest.approx(plain_shapiro(x), rel=1e-9)
        assert (got.p is None) == (n > ranks.MOST_FOR_P) and (got.p is None or 0 <= got.p <= 1)


def test_shapiro_wilk_of_a_published_sample_and_odd_tables(spark):
    test = lambda x: ranks.shapiro_wilk(spark.createDataFrame([(v,) for v in x], "v double"), "v", extensions._normal_cdf).collect()
    weights = [148.0, 154.0, 158.0, 160.0, 161.0, 162.0, 166.0, 170.0, 182.0, 195.0, 236.0]
    (r,) = test(weights)
    assert r.w == pytest.approx(0.79, abs=0.005) and r.p == pytest.approx(0.0067, abs=2e-4)
    assert test([]) == [] and tuple(test([1.0, 2.0])[0]) == (2, None, None) and tuple(test([4.0] * 20)[0]) == (20, None, None)
