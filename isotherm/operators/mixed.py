"""A random intercept for each cell beside fixed effects, fitted by restricted maximum likelihood (REML).

y = X b + u[cell] + e, with variances var_cell and var_error. With r = var_cell / var_error the likelihood is a
function of r alone, and of sums within cells: rows are folded to their cells once, and cells to their sizes, as
all cells of a size are weighted alike. So a step of the iteration reads as many rows as there are different
sizes, whatever the size of the record, and evaluates several r at once. The best of a coarse grid is refined by
sign changes of the derivative, which is known in closed form and loses no precision near the maximum.

Defined cases: rows without a finite y or predictor are left out; cells of one row count; a predictor that is a linear
function of those before it has no estimate (NULL); where variance between cells is no better than none, r is 0; a
table without residual variance or without spare rows has NULL variances.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..sources.tables import emptied, new_path, written

#: The coarse grid of r, and how it is refined: POINTS inside the interval for each of PASSES.
GRID = (0.0, *(10.0**k for k in range(-8, 9)))
POINTS, PASSES = 16, 10
_ALIASED = 1e-9


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _sums_by_size(z: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """For each size of a cell: cells, sums of squares (q_i_j) and of squared sums of cells (p_i_j) over columns z_0 ...

    A row of z counts m times; the last column has, beside its mean, a sum of squared deviations within the row.
    """
    m = F.col("m").cast("double")
    q = lambda i, j: m * F.col(f"z_{i}") * F.col(f"z_{j}") + (F.col("within") if i == j == k - 1 else F.lit(0.0))
    sums = [F.sum(m * F.col(f"z_{i}")).alias(f"s_{i}") for i in range(k)] + [F.sum(q(i, j)).alias(f"q_{i}_{j}") for i, j in _pairs(k)]
    cells = z.groupBy(*keys).agg(F.sum("m").alias("n"), *sums)
    both = [F.sum(f"q_{i}_{j}").alias(f"q_{i}_{j}") for i, j in _pairs(k)] + [F.sum(F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"p_{i}_{j}") for i, j in _pairs(k)]
    return cells.groupBy("n").agg(F.count("*").alias("cells"), *both)


class _Likelihood:
    """The profile of the restricted likelihood; the last column of the sums is y, the first is the intercept."""

    def __init__(self, sizes: DataFrame, k: int):
        self.sizes, self.k = sizes, k
        whole = sizes.agg(F.sum(F.col("n") * F.col("cells")).alias("n"), F.sum("cells").alias("cells"), *(F.sum(f"q_{i}_{j}").alias(f"q_{i}_{j}") for i, j in _pairs(k))).first()
        self.n, self.cells = whole["n"] or 0, whole["cells"] or 0
        q = self._matrix(whole, "q")
        self.used = self._independent(q)
        #: What is left of y where each cell has an intercept of its own can't be seen from q; y's own size scales what counts as none.
        self.scale = q[-1, -1]

    def _matrix(self, row, name: str) -> np.ndarray:
        m = np.zeros((self.k, self.k))
        for i, j in _pairs(self.k):
            m[i, j] = m[j, i] = row[f"{name}_{i}_{j}"] or 0.0
        return m

    def _independent(self, q: np.ndarray) -> list[int]:
        """Predictors that aren't linear functions of those before, by elimination in their order."""
        m, used = q[:-1, :-1].copy(), []
        for i in range(self.k - 1):
            if m[i, i] > _ALIASED * q[i, i] and q[i, i] > 0:
                used.append(i)
                m = m - np.outer(m[:, i], m[i]) / m[i, i]
        return used

    def at(self, ratios: Sequence[float]) -> list[dict]:
        """minus2, score, beta, a (X'WX), rss for each ratio: one aggregate over the sizes."""
        r, n, cells = F.col("r"), F.col("n").cast("double"), F.col("cells")
        c, d = r / (1.0 + n * r), 1.0 / ((1.0 + n * r) * (1.0 + n * r))
        sums = [F.sum(cells * F.log1p(n * r)).alias("logs"), F.sum(cells * n / (1.0 + n * r)).alias("trace")]
        sums += [F.sum(F.col(f"q_{i}_{j}") - c * F.col(f"p_{i}_{j}")).alias(f"a_{i}_{j}") for i, j in _pairs(self.k)] + [F.sum(d * F.col(f"p_{i}_{j}")).alias(f"d_{i}_{j}") for i, j in _pairs(self.k)]
        got = self.sizes.withColumn("r", F.explode(F.array(*(F.lit(float(x)) for x in ratios)))).groupBy("r").agg(*sums).collect()
        return [self._one(row) for row in sorted(got, key=lambda x: x["r"])]

    def _one(self, row) -> dict:
        a, d, u = self._matrix(row, "a"), self._matrix(row, "d"), self.used
        ax, ay = a[np.ix_(u, u)], a[u, -1]
        beta = np.linalg.solve(ax, ay) if u else np.empty(0)
        rss, free = max(0.0, a[-1, -1] - float(ay @ beta)), self.n - len(u)
        v = np.concatenate((-beta, [1.0]))
        dv = d[np.ix_([*u, self.k - 1], [*u, self.k - 1])]
        logdet = float(np.linalg.slogdet(ax)[1]) if u else 0.0
        out = {"r": row["r"], "beta": beta, "a": ax, "rss": rss}
        if free > 0 and rss > 1e-14 * self.scale:
            out["minus2"] = row["logs"] + logdet + free * math.log(rss)
            out["score"] = row["trace"] - float(np.trace(np.linalg.solve(ax, d[np.ix_(u, u)]))) - free / rss * float(v @ dv @ v)
        return out

    def best(self) -> dict | None:
        seen = self.at(GRID)
        if any("minus2" not in s for s in seen):
            return None
        k = min(range(len(seen)), key=lambda i: seen[i]["minus2"])
        if k == 0 and seen[0]["score"] >= 0:
            return seen[0]
        low, high = GRID[max(0, k - 1)], GRID[min(len(GRID) - 1, k + 1)]
        for _ in range(PASSES):
            inside = self.at([low + (high - low) * j / (POINTS + 1) for j in range(1, POINTS + 1)])
            above = [s["r"] for s in inside if s["score"] >= 0]
            high = above[0] if above else high
            low = max([low, *(s["r"] for s in inside if s["r"] < high)])
        return self.at([(low + high) / 2])[0]


RESULT = "term string, estimate double, se double"


def random_intercept(df: DataFrame, y: str, predictors: dict[str, Column], keys: Sequence[str], folded: tuple[str, str] | None = None) -> DataFrame:
    """(term, estimate, se): intercept and predictors, then var_cell, var_error, icc, log_likelihood, n and n_cells.

    folded: columns with a count and a sum of squared deviations. A row then stands for so many rows of a cell that have
    its predictors, and y is their mean; the result is that of all those rows.
    """
    spark, names = df.sparkSession, list(predictors)
    columns = [F.col(y).cast("double"), *(c.cast("double") for c in predictors.values())]
    m, within = (F.col(c) for c in folded) if folded else (F.lit(1), F.lit(0.0))
    raw = df.select(*keys, *(c.alias(f"v_{i}") for i, c in enumerate(columns)), m.cast("long").alias("m"), within.cast("double").alias("within"))
    raw = raw.filter(" and ".join(f"v_{i} is not null and not isnan(v_{i}) and abs(v_{i}) < double('infinity')" for i in range(len(columns)))).dropna(subset=list(keys))
    mean = raw.agg(*(F.try_divide(F.sum(F.col("m").cast("double") * F.col(f"v_{i}")), F.sum("m")).alias(f"v_{i}") for i in range(len(columns)))).first()
    means = [x or 0.0 for x in mean]
    k = len(names) + 2
    z = [F.lit(1.0), *(F.col(f"v_{i + 1}") - means[i + 1] for i in range(len(names))), F.col("v_0") - means[0]]
    path = new_path(spark, "mixed")
    sizes = written(_sums_by_size(raw.select(*keys, "m", "within", *(c.alias(f"z_{i}") for i, c in enumerate(z))), keys, k), "mixed", path)
    model = _Likelihood(sizes, k)
    best = model.best() if model.n else None
    rows: list[tuple[str, float | None, float | None]] = []
    terms = ["intercept", *names]
    at = best or (model.at([0.0])[0] if model.n else None)
    emptied(spark, path)
    estimate: dict[str, tuple[float, float | None]] = {}
    if at is not None and model.used:
        beta, error = at["beta"], at["rss"] / (model.n - len(model.used)) if best else None
        used = model.used
        shift = np.array([[1.0, *(-means[i] for i in used[1:])], *([float(j == k_) for j in range(len(used))] for k_ in range(1, len(used)))])
        values = shift @ beta
        values[0] += means[0]
        var = np.diag(shift @ np.linalg.inv(at["a"]) @ shift.T) * error if best else None
        estimate = {terms[i]: (float(values[j]), float(math.sqrt(var[j])) if best else None) for j, i in enumerate(used)}
    rows += [(t, *estimate.get(t, (None, None))) for t in terms]
    if best:
        cell, free = best["r"] * error, model.n - len(model.used)
        log = -0.5 * (best["minus2"] + free * (math.log(2 * math.pi) + 1 - math.log(free)))
        rows += [("var_cell", cell, None), ("var_error", error, None), ("icc", cell / (cell + error), None), ("log_likelihood", log, None)]
    else:
        rows += [(t, None, None) for t in ("var_cell", "var_error", "icc", "log_likelihood")]
    rows += [("n", float(model.n), None), ("n_cells", float(model.cells), None)]
    return spark.createDataFrame([(t, *(None if x is None else float(x) for x in v)) for t, *v in rows], RESULT)
