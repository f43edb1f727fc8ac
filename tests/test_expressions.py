"""Column expressions against hand-made values and public NumPy and pandas behaviour."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isotherm.functions import expressions as E


def one(spark, values, kind, f):
    return [r[1] for r in spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", f(F.col("v"))).orderBy("i").collect()]


def test_missing_values(spark):
    v = [1.0, None, float("nan"), float("inf"), -float("inf")]
    assert one(spark, v, "double", E.missing_to_null) == [1.0, None, None, float("inf"), -float("inf")]
    assert one(spark, v, "double", E.is_finite) == [True, False, False, False, False]


def test_dates(spark):
    days = ["1992-02-29", "1993-02-29", "nonsense", None, "1999-12-31T12:00:00"]
    assert [str(d) if d else None for d in one(spark, days, "string", E.parse_day)] == ["1992-02-29", None, None, None, "1999-12-31"]
    df = spark.sql("select explode(sequence(date'1999-01-15', date'1999-12-15', interval 1 month)) as d")
    assert [r[0] for r in df.select(E.season(F.col("d"))).collect()] == ["DJF"] * 2 + ["MAM"] * 3 + ["JJA"] * 3 + ["SON"] * 3 + ["DJF"]
    assert [r[0] for r in df.select(E.month_day(F.col("d"))).collect()][7] == "08-15"


def test_no_leap_days(spark):
    got = [str(r[0]) for r in spark.range(3650).select(E.no_leap_day(1990, F.col("id"))).collect()]
    want = [str(d.date()) for d in pd.date_range("1990-01-01", "1999-12-31") if (d.month, d.day) != (2, 29)]
    assert got == want


def test_longitudes_wrap(spark):
    assert one(spark, [0.0, 90.0, 180.0, 270.0, 359.5, -200.0, -180.0], "double", E.wrap_longitude) == [0.0, 90.0, -180.0, -90.0, -0.5, 160.0, -180.0]


def test_nearest_takes_the_lower_index_of_equals(spark):
    assert one(spark, [24.0, 24.25, 24.26, 99.0, None], "double", lambda v: E.nearest_index(v, [24.0, 24.5, 25.0])) == [0, 0, 1, 2, None]
    assert one(spark, [24.25], "double", lambda v: E.nearest_index(v, [24.5, 24.0])) == [0]
    rng = np.random.default_rng(1)
    axis, v = np.sort(rng.uniform(0, 9, 40)), rng.uniform(-1, 10, 200)
    assert one(spark, v.tolist(), "double", lambda c: E.nearest_index(c, axis.tolist())) == np.argmin(abs(v[:, None] - axis), axis=1).tolist()


def test_distance(spark):
    df = spark.createDataFrame([(32.0, 35.0, 32.0, 35.0), (33.0, 36.0, 32.0, 35.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(E.distance_degrees(*(F.col(c) for c in "abcd"))).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(math.hypot(1, math.cos(math.radians(32.5))))


EDGES = [0.0, 1.0, 1.0, 2.5, 6.0]
POINTS = [-1.0, 0.0, 0.5, 1.0, 1.1, 2.5, 5.9, 6.0, 7.0]


def test_bins_match_numpy_and_pandas(spark):
    left = one(spark, [*POINTS, None], "double", lambda v: E.bin_left(v, EDGES))
    assert left == [min(int(np.searchsorted(EDGES[1:], p, side="left")), 3) for p in POINTS] + [None]
    hist = one(spark, POINTS, "double", lambda v: E.bin_histogram(v, EDGES))
    assert np.bincount([h for h in hist if h is not None], minlength=4).tolist() == np.histogram(POINTS, EDGES)[0].tolist()
    assert hist[0] is None and hist[-1] is None and hist[-2] == 3
    marks = [0.0, 1.0, 2.5, 6.0]
    cut = pd.cut(pd.Series(POINTS), bins=marks, labels=False)
    assert one(spark, POINTS, "double", lambda v: E.bin_cut(v, marks)) == [None if np.isnan(c) else int(c) for c in cut]


def test_equal_bins_match_numpy(spark):
    rng = np.random.default_rng(5)
    low, high, n = -3.7, 12.9, 299
    edges = np.linspace(low, high, n + 1)
    v = np.concatenate([rng.uniform(low, high, 500), edges, [low, high]])
    got = one(spark, v.tolist(), "double", lambda c: E.bin_equal(c, F.lit(low), F.lit(high), n))
    assert np.bincount(got, minlength=n).tolist() == np.histogram(v, bins=edges)[0].tolist()
    assert one(spark, [2.0, 3.0], "double", lambda c: E.bin_equal(c, F.lit(2.0), F.lit(2.0), 4)) == [0, None]
    assert E.linspace(0.0, 1.0, 6) == np.linspace(0, 1, 6).tolist()


def test_labels(spark):
    assert one(spark, [30.0, -10.0, 0.5, 1.5, 0.0], "double", E.longitude_label) == ["30°E", "10°W", "0°E", "2°E", "0°E"]
    assert one(spark, [24.0, -5.2], "double", E.latitude_label) == ["24°N", "5°S"]
    assert one(spark, [20.9, -3.9], "double", E.temperature_label) == ["20°", "-3°"]
    df = spark.createDataFrame([(0.0, 0.2), (0.6000000000000001, 0.8)], "a double, b double")
    assert [r[0] for r in df.select(E.percent_bin_label(F.col("a"), F.col("b"))).collect()] == ["0–20%", "60–80%"]
    assert spark.range(1).select(E.ticks(F.lit(24.5), F.lit(38.0), 2)).first()[0] == [26, 28, 30, 32, 34, 36, 38]
    assert spark.range(1).select(E.ticks(F.lit(24.5), F.lit(25.5), 2)).first()[0] == []


def test_reports(spark):
    assert one(spark, [0, 1023, 1024, 1280, 1792, 1536 * 1024, 5 * 1024**4], "long", E.format_bytes) == ["0.0 B", "1023.0 B", "1.0 KB", "1.2 KB", "1.8 KB", "1.5 MB", "5.0 TB"]
    df = spark.createDataFrame([(20 * 1024**2 * 30, 20.0), (20 * 1024**2 * 90, 20.0), (5, 0.0), (5, -1.0)], "s long, r double")
    assert [r[0] for r in df.select(E.transfer_estimate(F.col("s"), F.col("r"))).collect()] == ["30.0 sec", "1.5 min", "0.0 sec", "0.0 sec"]


def test_one_decimal_is_of_the_exact_double(spark):
    rng = np.random.default_rng(11)
    near = [(k + d) / 20 for k in rng.integers(0, 10**9, 300).tolist() for d in (0, 1e-9)]
    v = [21410447.85, 64231343.55, 0.05, 0.15, 0.25, 0.75, 0.95, 1 - 2**-53, 9.95, 2.0**62, 1e15 + 0.3, -0.25, -7.95, 0.0, *near, *np.nextafter(near, 0).tolist(), *rng.uniform(-(10**6), 10**12, 300).tolist()]
    assert one(spark, v, "double", lambda c: E._one_decimal(c, "x")) == [f"{x:.1f} x" for x in v]
    assert one(spark, [float("nan"), float("inf")], "double", lambda c: E._one_decimal(c, "x")) == ["NaN x", "Infinity x"]
    df = spark.createDataFrame([(101376 * 101376 * 131071, 1.0)], "s long, r double")
    assert df.select(E.transfer_estimate(F.col("s"), F.col("r"))).first()[0] == "21410447.9 min"


@pytest.mark.parametrize("p, df, want", [(0.95, 1, 6.313752), (0.95, 8, 1.859548), (0.975, 30, 2.042272), (0.995, 5, 4.032143), (0.5, 4, 0.0)])
def test_t_quantiles_match_tables(p, df, want):
    assert E.t_quantile(p, df) == pytest.approx(want, abs=1e-6)
