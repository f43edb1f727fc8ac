"""Regression trees on many rows: boosted trees and random forests by histograms of gradients.

Features are quantised once, by quantiles of the training rows, and the quantised rows are written. A level of
one tree, or of all trees of a forest, is one aggregate over them: sums of gradients by (tree, node, feature, bin),
added up map-side, so what is exchanged is bounded by the model and not by the rows. The node of a row is a
function of its bins, so rows are neither moved nor rewritten between levels. Splits are chosen in Spark from
the histograms; only the chosen ones, at most one a node, come to the driver: they are the model.

Gradients are whole numbers (units of 1 / SCALE), so their sums don't depend on the order of rows: the same rows give
the same splits whatever the partitioning, and after executors are lost. Sums stay exact up to about 10**12 rows.
Of equal gains the lower feature wins, then the lower bin.

Defined cases: rows whose target isn't finite are left out of training; a missing feature (NULL or NaN) is in bin -1,
left of every split; a node that no split improves, or of too few rows, is a leaf; without rows the model is one
leaf of value 0. A feature with one value has no split.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..sources.tables import Steps
from .stats import exact_quantiles

#: Gradients are counted in units of 1 / SCALE.
SCALE = 1 << 16
#: Quantised rows are rewritten with their prediction after so many boosting rounds, which keeps expressions short.
REFRESH = 8


@dataclass
class Tree:
    """Nodes are numbered as in a heap: 1 is the root, 2k and 2k + 1 are the children of k."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)  # node -> (feature, bin): left up to that bin
    sums: dict[int, tuple[int, int]] = field(default_factory=dict)  # node -> (sum of gradients, rows by weight)

    def value(self, node: int, l2: float) -> float:
        g, n = self.sums.get(node, (0, 0))
        return g / (n + l2) / SCALE if n + l2 else 0.0

    def walk(self, left: Callable[[int, int], object], leaf: Callable[[int], object], join: Callable, node: int = 1):
        """Fold the tree: leaf(node) at its ends, join(test, left side, right side) at its splits."""
        if node not in self.splits:
            return leaf(node)
        down = lambda k: self.walk(left, leaf, join, k)
        return join(left(*self.splits[node]), down(2 * node), down(2 * node + 1))


def _when(test: Column, a: Column, b: Column) -> Column:
    return F.when(test, a).otherwise(b)


@dataclass
class Model:
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    trees: tuple[Tree, ...]
    base: float
    weight: float  # of each tree's value
    l2: float

    def _test(self, feature: int, bin_: int) -> Column:
        c = F.col(self.features[feature]).cast("double")
        return c.isNull() | F.isnan(c) | (c <= self.edges[feature][bin_]) if bin_ >= 0 else c.isNull() | F.isnan(c)

    def tree_value(self, k: int) -> Column:
        """The value of tree k for a row of raw features."""
        t = self.trees[k]
        return t.walk(self._test, lambda node: F.lit(t.value(node, self.l2)), _when)

    def predict(self) -> Column:
        """The prediction for a row of raw features, an expression of built-in functions."""
        out = F.lit(self.base)
        for k in range(len(self.trees)):
            out = out + F.lit(self.weight) * self.tree_value(k)
        return out

    def to_sql(self) -> str:
        """The prediction as an SQL expression of columns named as the features."""

        def test(feature: int, bin_: int) -> str:
            c = f"{self.features[feature]}::double"
            return f"({c} is null or isnan({c})" + (f" or {c} <= {self.edges[feature][bin_]!r}::double)" if bin_ >= 0 else ")")

        one = lambda t: t.walk(test, lambda node: f"{t.value(node, self.l2)!r}::double", lambda c, a, b: f"case when {c} then {a} else {b} end")
        return " + ".join([f"{self.base!r}::double", *(f"{self.weight!r}::double * {one(t)}" for t in self.trees)])

    def nodes(self) -> list[tuple[int, int, str | None, float | None, int, float]]:
        """(tree, node, feature, threshold, n, value) of every node; leaves have no feature."""
        out = []
        for k, t in enumerate(self.trees):
            for node, (_, n) in sorted(t.sums.items()):
                f, b = t.splits.get(node, (None, None))
                edge = None if f is None else self.edges[f][b] if b >= 0 else -math.inf
                out.append((k, node, None if f is None else self.features[f], edge, n, t.value(node, self.l2)))
        return out


NODES = "tree long, node long, feature string, threshold double, n long, value double"


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int) -> tuple[tuple[float, ...], ...]:
    """Edges between bins of about equally many rows: exact quantiles, a few numbers for each feature."""
    marks = [k / bins for k in range(1, bins)]
    c = lambda f: F.col(f).cast("double")
    long = df.select(F.inline(F.array(*(F.struct(F.lit(k).alias("feature"), F.when(~F.isnan(c(f)), c(f)).alias("x")) for k, f in enumerate(features)))))
    found = {r["feature"]: tuple(r["q"]) for r in exact_quantiles(long, ["feature"], "x", marks).collect()}  # a row for each feature
    return tuple(found.get(k, (math.inf,) * len(marks)) for k in range(len(features)))


def bin_of(feature: str, edges: Sequence[float]) -> Column:
    """How many edges are below the value; -1 for a missing one."""
    c = F.col(feature).cast("double")
    return F.when(c.isNull() | F.isnan(c), -1).otherwise(F.size(F.filter(E._literals(list(edges)), lambda e: e < c))).cast("short")


def _units(value: Column) -> Column:
    return F.floor(value * F.lit(float(SCALE)) + 0.5).cast("long")


def _histogram(rows: DataFrame, trees: list[Tree], n_features: int, gradient: Column, weights: list[Column], level: int) -> DataFrame:
    """(tree, node, feature, bin, g, n) of the nodes of a level."""
    left = lambda f, b: F.col(f"b_{f}") <= b
    at = {f"at_{t}": tree.walk(left, F.lit, _when).cast("int") for t, tree in enumerate(trees)}
    held = rows.select(*(f"b_{k}" for k in range(n_features)), gradient.alias("g"), *(w.cast("long").alias(f"w_{t}") for t, w in enumerate(weights)), *(c.alias(k) for k, c in at.items()))
    w = lambda t: F.col(f"w_{t}")
    items = [F.struct(F.lit(t).alias("tree"), F.col(f"at_{t}").alias("node"), F.lit(k).alias("feature"), F.col(f"b_{k}").alias("bin"), (w(t) * F.col("g")).alias("g"), w(t).alias("n")) for t in range(len(trees)) for k in range(n_features)]
    return held.select(F.inline(F.array(*items))).filter((F.col("n") > 0) & (F.col("node") >= 1 << level)).groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def _best(histogram: DataFrame, least: int, l2: float, allowed: Column) -> DataFrame:
    """(tree, node, g, n, feature, bin, gl, nl): the best split of each node, NULL where there is none."""
    whole = Window.partitionBy("tree", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each bin
    h = histogram.select("tree", "node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("n").over(upto).alias("nl"), F.sum("g").over(whole).alias("g"), F.sum("n").over(whole).alias("n"))
    d = lambda c: F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    gr, nr = d(F.col("g") - F.col("gl")), d(F.col("n") - F.col("nl"))
    term = lambda g, n: F.try_divide(g * g, n + F.lit(l2))
    gain = term(d("gl"), d("nl")) + term(gr, nr) - term(d("g"), d("n"))
    fits = allowed & (F.col("nl") >= least) & (nr >= least) & (gain > 0)
    best = F.max_by(F.struct("feature", "bin", "gl", "nl"), F.when(fits, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))))
    return h.groupBy("tree", "node").agg(F.first("g").alias("g"), F.first("n").alias("n"), best.alias("s")).select("tree", "node", "g", "n", "s.*")


def grow(rows: DataFrame, n_features: int, gradient: Column, weights: list[Column], depth: int, least: int, l2: float, allowed: Callable[[int, int], Sequence[int]] | None = None) -> list[Tree]:
    """Trees on quantised rows (b_0, b_1, ...), one for each weight, all a level at a time.

    allowed(tree, node): features that a node may be split by; else all. least: rows of a child, by weight.
    """
    trees = [Tree() for _ in weights]
    for level in range(max(depth, 1)):
        may = F.lit(True)
        if allowed:
            keys = [f"{t}.{node}.{f}" for t, tree in enumerate(trees) for node in range(1 << level, 2 << level) if level == 0 or node in tree.sums for f in allowed(t, node)]
            may = F.concat_ws(".", "tree", "node", "feature").isin(keys)
        got = _best(_histogram(rows, trees, n_features, gradient, weights, level), least, l2, may).collect()  # a row for each node
        for r in got:
            tree = trees[r.tree]
            tree.sums[r.node] = (r.g, r.n)
            if r.feature is not None and depth:
                tree.splits[r.node] = (r.feature, r.bin)
                tree.sums[2 * r.node], tree.sums[2 * r.node + 1] = (r.gl, r.nl), (r.g - r.gl, r.n - r.nl)
        if not any(node >= 1 << level for tree in trees for node in tree.splits):
            break
    return trees


def _quantised(df: DataFrame, features: Sequence[str], target: str, bins: int, keep: Sequence[str]) -> tuple[tuple[tuple[float, ...], ...], DataFrame]:
    known = df.filter(E.is_finite(F.col(target).cast("double")))
    edges = quantile_edges(known, features, bins)
    return edges, known.select(*(bin_of(f, e).alias(f"b_{k}") for k, (f, e) in enumerate(zip(features, edges))), F.col(target).cast("double").alias("y"), *(F.col(c).alias(f"k_{k}") for k, c in enumerate(keep)))


def boosted(df: DataFrame, target: str, features: Sequence[str], rounds: int = 100, depth: int = 4, bins: int = 64, rate: float = 0.1, least: int = 20, l2: float = 1.0) -> Model:
    """Gradient boosting for squared error: each tree is grown on what the ones before leave."""
    steps = Steps(df.sparkSession, "trees")
    edges, rows = _quantised(df, features, target, bins, ())
    rows = steps.next(rows)
    one = rows.agg(F.sum(_units(F.col("y"))).alias("g"), F.count("*").alias("n")).first()
    base = (one.g or 0) / max(1, one.n) / SCALE
    rows, trees, told = rows.withColumn("p", F.lit(base)), [], F.col("p")
    for k in range(rounds):
        tree = grow(rows, len(features), _units(F.col("y") - told), [F.lit(1)], depth, least, l2)[0]
        trees.append(tree)
        told = told + F.lit(rate) * tree.walk(lambda f, b: F.col(f"b_{f}") <= b, lambda node, t=tree: F.lit(t.value(node, l2)), _when)
        if (k + 1) % REFRESH == 0 and k + 1 < rounds:
            rows, told = steps.next(rows.withColumn("p", told)), F.col("p")
    steps.free()
    return Model(tuple(features), edges, tuple(trees), base, rate, l2)


def draws(keys: Sequence[str], trees: int, seed: int) -> list[Column]:
    """How often each tree draws a row: Poisson numbers of mean 1 from a digest of the row's keys, four from each."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]
    digest = [F.md5(F.concat_ws("|", *text, F.lit(f"{seed}.{g}"))) for g in range((trees + 3) // 4)]
    u = [F.conv(F.substring(digest[t // 4], 8 * (t % 4) + 1, 8), 16, 10).cast("double") / float(1 << 32) for t in range(trees)]
    return [sum(((x >= c).cast("long") for c in poisson_marks()), F.lit(0).cast("long")) for x in u]


def poisson_marks(most: int = 8) -> list[float]:
    """Cumulative probabilities of a Poisson number of mean 1."""
    out, term = [], math.exp(-1)
    for k in range(most):
        out.append(term + (out[-1] if out else 0.0))
        term /= k + 1
    return out


def feature_choice(seed: int, n_features: int, each: int) -> Callable[[int, int], list[int]]:
    """Which features a node of a tree of a forest may be split by."""
    rank = lambda t, node, f: hashlib.md5(f"{seed}.{t}.{node}.{f}".encode()).hexdigest()
    return lambda t, node: sorted(sorted(range(n_features), key=lambda f: rank(t, node, f))[:each])


def forest(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str], trees: int = 16, depth: int = 6, bins: int = 64, each: int | None = None, least: int = 5, seed: int = 42) -> Model:
    """A random forest: each tree draws rows with replacement, each node is split by one of `each` features.

    keys name a row; the draw depends on them alone. All trees grow together, a level at a time.
    """
    steps = Steps(df.sparkSession, "trees")
    edges, rows = _quantised(df, features, target, bins, keys)
    weights = draws([f"k_{k}" for k in range(len(keys))], trees, seed)
    rows = steps.next(rows.select(*(f"b_{k}" for k in range(len(features))), "y", *(w.cast("byte").alias(f"d_{t}") for t, w in enumerate(weights))))
    choice = feature_choice(seed, len(features), each or max(1, round(len(features) / 3)))
    grown = grow(rows, len(features), _units(F.col("y")), [F.col(f"d_{t}") for t in range(trees)], depth, least, 0.0, choice)
    steps.free()
    return Model(tuple(features), edges, tuple(grown), 0.0, 1.0 / trees, 0.0)


def out_of_bag(model: Model, keys: Sequence[str], seed: int = 42) -> Column:
    """The mean of the trees that didn't draw a row; NULL if all did."""
    w = draws(keys, len(model.trees), seed)
    free = [(d == 0, model.tree_value(t)) for t, d in enumerate(w)]
    total = sum((F.when(out, v).otherwise(0.0) for out, v in free), F.lit(0.0))
    return F.try_divide(total, sum((out.cast("double") for out, _ in free), F.lit(0.0)))
