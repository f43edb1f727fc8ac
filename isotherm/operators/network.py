"""A feed-forward network with one hidden layer, trained by synchronous mini-batch steps.

Rows are standardised, given a batch by a digest of their keys, and written once. A step is one aggregate over a batch: each task adds
up the gradients of its rows and Spark adds up the tasks; the weights, a bounded model, are on the driver between
steps and are constants of the next one's expression. Gradients are whole numbers (units of 1 / SCALE), so their sum doesn't
depend on the order of rows: a run gives the same losses whatever the partitioning, and after executors are lost.

Defined cases: rows without a finite target or feature are left out; a constant feature counts as 0; a batch without rows
leaves the weights as they are, with a NULL loss; without rows the network predicts 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..sources.tables import emptied, new_path, written

#: Gradients and losses are counted in units of 1 / SCALE.
SCALE = 1 << 24
MAX_WEIGHTS = 4096


@dataclass
class Network:
    """Weights of hidden units (one list a unit, the last is its bias) and of the output (the last is its bias)."""

    hidden: list[list[float]]
    out: list[float]
    features: tuple[str, ...]
    scaling: list[tuple[float, float]]  # mean and standard deviation of each feature, then of the target

    def predict(self) -> Column:
        """The prediction for a row of raw features."""
        x = [_scaled(F.col(f).cast("double"), *self.scaling[i]) for i, f in enumerate(self.features)]
        mean, sd = self.scaling[-1]
        return _output(self.hidden, self.out, x)[1] * sd + mean


def _scaled(c: Column, mean: float, sd: float) -> Column:
    return (c - mean) / sd if sd > 0 else F.lit(0.0)


def _output(hidden: list[list[float]], out: list[float], x: list[Column]) -> tuple[list[Column], Column]:
    units = [F.tanh(sum((F.lit(w) * c for w, c in zip(unit, x)), F.lit(unit[-1]))) for unit in hidden]
    return units, sum((F.lit(v) * h for v, h in zip(out, units)), F.lit(out[-1]))


def start(n_features: int, units: int, seed: int) -> tuple[list[list[float]], list[float]]:
    """Weights between -0.5 and 0.5 from digests of the seed and their place; biases are 0."""

    def draw(name: str) -> float:
        return int(hashlib.md5(f"{seed}.{name}".encode()).hexdigest()[:8], 16) / 2**32 - 0.5

    return [[*(draw(f"{j}.{i}") for i in range(n_features)), 0.0] for j in range(units)], [*(draw(f"out.{j}") for j in range(units)), 0.0]


def batch_of(keys: Sequence[str], batches: int, seed: int) -> Column:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *text, F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % batches).cast("int")


def _units(c: Column) -> Column:
    return F.floor(c * F.lit(float(SCALE)) + 0.5).cast("long")


def train(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str], units: int = 8, steps: int = 50, batches: int = 4, rate: float = 0.1, seed: int = 42) -> tuple[Network, list[tuple[int, int, float | None]]]:
    """The network and (step, n, loss) of each step: half the mean squared error of its batch before the step."""
    if units * (len(features) + 2) + 1 > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights")
    spark, columns = df.sparkSession, [*features, target]
    known = df.select(batch_of(keys, batches, seed).alias("batch"), *(F.col(c).cast("double").alias(f"c_{i}") for i, c in enumerate(columns)))
    for i in range(len(columns)):
        known = known.filter(E.is_finite(F.col(f"c_{i}")))
    moments = known.agg(*(f(f"c_{i}") for i in range(len(columns)) for f in (F.avg, F.stddev_pop))).first()
    scaling = [(moments[2 * i] or 0.0, moments[2 * i + 1] or 0.0) for i in range(len(columns))]
    path = new_path(spark, "network")
    rows = written(known.select("batch", *(_scaled(F.col(f"c_{i}"), *scaling[i]).alias(f"x_{i}") for i in range(len(columns)))), "network", path)
    hidden, out = start(len(features), units, seed)
    x, y, losses = [F.col(f"x_{i}") for i in range(len(features))], F.col(f"x_{len(features)}"), []
    for step in range(steps):
        h, told = _output(hidden, out, x)
        e = told - y
        back = [e * F.lit(v) * (F.lit(1.0) - u * u) for v, u in zip(out, h)]
        sums = [F.count("*"), F.sum(_units(e * e * 0.5)), *(F.sum(_units(e * u)) for u in h), F.sum(_units(e)), *(F.sum(_units(b * c)) for b in back for c in [*x, F.lit(1.0)])]
        got = list(rows.filter(F.col("batch") == step % batches).agg(*(s.alias(f"s_{k}") for k, s in enumerate(sums))).first())
        n = got[0]
        losses.append((step, n, got[1] / n / SCALE if n else None))
        if not n:
            continue
        g = [v / n / SCALE for v in got[2:]]
        out = [w - rate * d for w, d in zip(out, g)]
        wide = len(features) + 1
        hidden = [[w - rate * d for w, d in zip(unit, g[units + 1 + j * wide : units + 1 + (j + 1) * wide])] for j, unit in enumerate(hidden)]
    emptied(spark, path)
    return Network(hidden, out, tuple(features), scaling), [(k, n, None if v is None else float(v)) for k, n, v in losses]

