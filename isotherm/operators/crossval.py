"""Cross-validation by blocks of linear models with several predictors.

A fold is a block of rows (a year, a region). One aggregate gives each fold's matrix of sums of products; the matrix of all
other folds is the total less that fold's, so leaving a fold out costs a subtraction and a small solution, and the
error on the fold left out follows from its own matrix. Rows are read once for the means and once for the sums,
however many folds there are.

Defined cases: rows without a finite target or predictor, or without a fold, are left out; a predictor that is a linear
function of others in what is left gets the least of the possible coefficients; one fold alone has nothing to
learn from and has NULL coefficients and error.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FOLDS = 100_000
RESULT = "fold string, term string, coefficient double, n_train long, n_test long, rmse double"


def cross_validated(df: DataFrame, y: str, predictors: dict[str, Column], fold: Column) -> DataFrame:
    """(fold, term, coefficient, n_train, n_test, rmse): a row for each fold and term, intercept first."""
    names = ["intercept", *predictors]
    columns = [F.col(y).cast("double"), *(c.cast("double") for c in predictors.values())]
    raw = df.select(fold.cast("string").alias("fold"), *(c.alias(f"v_{i}") for i, c in enumerate(columns)))
    raw = raw.filter("fold is not null and " + " and ".join(f"v_{i} is not null and not isnan(v_{i}) and abs(v_{i}) < double('infinity')" for i in range(len(columns))))
    mean = [x or 0.0 for x in raw.agg(*(F.avg(f"v_{i}") for i in range(len(columns)))).first()]
    z = [F.lit(1.0), *(F.col(f"v_{i}") - mean[i] for i in range(1, len(columns))), F.col("v_0") - mean[0]]
    k = len(z)
    places = [(i, j) for i in range(k) for j in range(i, k)]
    sums = raw.select("fold", *(c.alias(f"z_{i}") for i, c in enumerate(z))).groupBy("fold").agg(*(F.sum(F.col(f"z_{i}") * F.col(f"z_{j}")).alias(f"q_{i}_{j}") for i, j in places))
    rows = sums.orderBy("fold").limit(MAX_FOLDS + 1).collect()  # a small matrix for each fold
    if len(rows) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds")
    grams = np.zeros((len(rows), k, k))
    for f, r in enumerate(rows):
        for i, j in places:
            grams[f, i, j] = grams[f, j, i] = r[f"q_{i}_{j}"]
    whole, out = grams.sum(0), []
    for r, own in zip(rows, grams):
        rest, n = whole - own, own[0, 0]
        if rest[0, 0] < 0.5:
            out += [(r["fold"], t, None, 0, int(n), None) for t in names]
            continue
        beta = np.linalg.lstsq(rest[:-1, :-1], rest[:-1, -1], rcond=None)[0]
        v = np.append(-beta, 1.0)
        rmse = math.sqrt(max(0.0, float(v @ own @ v)) / n)
        values = [mean[0] + beta[0] - float(np.dot(beta[1:], mean[1:])), *beta[1:]]
        out += [(r["fold"], t, float(b), round(float(rest[0, 0])), round(float(n)), rmse) for t, b in zip(names, values)]
    return df.sparkSession.createDataFrame(out, RESULT)
