"""Operators on tiny grids with values made by hand, and the traps of the semantics."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isotherm.operators import calendar, extensions, grid, pairing, regression, stats
from isotherm.schema import Region
from isotherm.sources import grids as sources

D = dt.date


def series(spark, pairs, label="a"):
    return spark.createDataFrame([(label, d, v) for d, v in pairs], "label string, day date, value double")


# --- grids


def test_land_is_what_ever_has_a_value(spark):
    nan = float("nan")
    raw = [(0, 0, 1.0), (0, 0, 2.0), (0, 1, None), (0, 1, None), (1, 0, None), (1, 0, 3.0), (1, 1, nan), (1, 1, nan)]
    df = spark.createDataFrame(raw, "lat_ix int, lon_ix int, t2m double").withColumn("t2m", F.when(~F.isnan("t2m"), F.col("t2m")))
    assert {(r[0], r[1]): r[2] for r in grid.land_mask(df).collect()} == {(0, 0): True, (0, 1): False, (1, 0): True, (1, 1): False}


def test_longitudes_change_only_if_some_are_above_180(spark):
    wide = spark.createDataFrame([(x,) for x in (0.0, 90.0, 180.0, 270.0)], "lon double")
    once = grid.standardize_longitude(wide, "lon")
    assert sorted(r[0] for r in once.collect()) == [-180.0, -90.0, 0.0, 90.0]
    assert sorted(r[0] for r in grid.standardize_longitude(once, "lon").collect()) == [-180.0, -90.0, 0.0, 90.0]
    assert sorted(r[0] for r in grid.standardize_longitude(wide.filter("lon <= 180"), "lon").collect()) == [0.0, 90.0, 180.0]
    assert grid.standardize_longitude(wide.limit(0), "lon").collect() == []


def test_box_includes_its_bounds(spark):
    df = spark.createDataFrame([(y, x) for y in (23.9, 24.0, 38.0, 38.2) for x in (30.0, 38.0, 38.05, 39.0)], "la double, lo double").orderBy(F.desc("la"))
    got = {(r[0], r[1]) for r in grid.subset_box(df, "la", "lo", Region(24, 38, 30, 38), 0.0, 0.05).collect()}
    assert got == {(y, x) for y in (24.0, 38.0) for x in (30.0, 38.0, 38.05)}


def test_box_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0, 3)], "la double, lo double, v int").write.parquet(str(tmp_path / "t"))
    plan = grid.subset_box(spark.read.parquet(str(tmp_path / "t")), "la", "lo", Region(0, 9, 0, 9)).select("la")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(la), IsNotNull(lo), GreaterThanOrEqual(la" in plan and "v#" not in plan.split("ReadSchema")[1]


def test_assignment_counts_and_shares(spark):
    pixels = spark.createDataFrame([(i, j, 24 + i * 0.5, 30 + j * 0.5, (i + j) % 3 > 0) for i in range(5) for j in range(5)], "lat_ix int, lon_ix int, era5_lat double, era5_lon double, is_land boolean")
    a = grid.assign_cells(pixels, [24.0, 25.0, 26.0], [30.0, 31.0, 32.0])
    rows = {(r.lat_ix, r.lon_ix): (r.clat_ix, r.clon_ix) for r in a.collect()}
    assert rows[1, 1] == (0, 0) and rows[2, 3] == (1, 1) and rows[4, 4] == (2, 2)  # half way: the lower index
    counts, sea = grid.pixel_counts(a.filter("is_land")), grid.sea_fraction(a)
    s = {(r.cmip_lat, r.cmip_lon): r for r in grid.cell_stats(sea, counts).collect()}
    assert sum(r.n_land_pixels for r in s.values()) == pixels.filter("is_land").count()
    assert all(r.n_land + r.n_sea == r.n_total and 0 <= r.sea_fraction <= 1 and r.n_land == r.n_land_pixels for r in s.values())
    one = grid.pixel_count_stats(counts).first()
    n = pd.Series([r.n_pixels for r in counts.collect()])
    assert (one.n_cells, one.n_land_pixels, one.p75, one.p90) == (len(n), n.sum(), n.quantile(0.75), n.quantile(0.9)) and one["std"] == pytest.approx(n.std())
    assert sorted({r.cell_id for r in grid.cell_ids(a).collect()}) == list(range(9))
    wide = grid.pivot_counts(counts, [30.0, 31.0, 32.0]).collect()
    assert [r.cmip_lat for r in wide] == [26.0, 25.0, 24.0] and sum(sum(r[1:]) for r in wide) == n.sum()


def test_cells_without_land_count_zero(spark):
    sea = spark.createDataFrame([(1.0, 1.0, 4, 0, 4, 1.0)], "cmip_lat double, cmip_lon double, n_total long, n_land long, n_sea long, sea_fraction double")
    none = spark.createDataFrame([], "cmip_lat double, cmip_lon double, n_pixels long")
    assert grid.cell_stats(sea, none).first().n_land_pixels == 0
    assert tuple(grid.coastal_counts(sea).first()) == (1, 0)


def test_cell_edges(spark):
    axis = spark.createDataFrame([(c,) for c in (3.0, 1.0, 2.0, 2.0, 5.0)], "c double")
    assert [r.edge for r in grid.cell_edges(axis, "c").orderBy("pos").collect()] == [0.5, 1.5, 2.5, 4.0, 6.0]
    assert grid.cell_edges(axis.limit(1), "c").collect() == []


def test_nearest_point_and_axis(spark):
    axis = grid.axis_table(spark, [30.0, 31.0, 32.0], "ix", "c")
    assert tuple(grid.nearest_point(axis, "ix", "c", 30.5).first()) == (0, 30.0)
    assert grid.axis(axis, "ix", "c") == [30.0, 31.0, 32.0]


# --- calendar


def test_alignment_drops_leap_days(spark):
    a = series(spark, [(D(1992, 2, 27) + dt.timedelta(k), float(k)) for k in range(5)] + [(None, 0.0)])
    b = a.filter("day != date'1992-02-29'").unionByName(a.filter("day = date'1992-02-28'"))
    x, y, days = calendar.align(a, b)
    assert x.count() == 4 and y.count() == 5 and days.count() == 4
    assert [tuple(r) for r in calendar.repeated_keys(b, "day").collect()] == [(D(1992, 2, 28), 2)]


def test_seasons_do_not_cross_years(spark):
    s = series(spark, [(D(1990, 12, 1), 1.0), (D(1991, 1, 1), 2.0), (D(1991, 6, 1), 3.0)])
    assert {k: v.count() for k, v in calendar.seasonal_split(s).items()} == {"DJF": 2, "MAM": 0, "JJA": 1, "SON": 0}


def test_empty_months_are_there(spark):
    s = series(spark, [(D(1991, 1, 5), 1.0), (D(1991, 1, 6), 3.0), (D(1991, 3, 1), 4.0)])
    assert [tuple(r)[1:] for r in calendar.resample_mean(s, "ME").orderBy("period").collect()] == [(D(1991, 1, 31), 2.0), (D(1991, 2, 28), None), (D(1991, 3, 31), 4.0)]
    band = calendar.resample_band(s, "ME", "sd").orderBy("period").collect()
    assert band[0].lo == pytest.approx(2 - 2**0.5) and band[1].mean is None and band[2].lo is None and band[2].mean == 4.0  # one value has no sample SD
    assert calendar.resample_band(s, "ME", "other").collect() == []
    assert [r.freq for r in calendar.series_frequency(s).collect()] == ["ME"]


def test_resampling_matches_pandas(spark):
    rng = random.Random(3)
    days = sorted(rng.sample([D(1990, 1, 1) + dt.timedelta(k) for k in range(1400)], 300))
    values = [rng.uniform(-5, 40) for _ in days]
    p = pd.Series(values, index=pd.to_datetime(days))
    for freq in ("ME", "YE"):
        got = {r.period: r for r in calendar.resample_band(series(spark, list(zip(days, values))), freq, "percentile").collect()}
        lo, hi, mean = p.resample(freq).quantile(0.05), p.resample(freq).quantile(0.95), p.resample(freq).mean()
        assert set(got) == {d.date() for d in mean.index}
        for d in mean.index:
            r = got[d.date()]
            assert (r.mean is None) == bool(np.isnan(mean[d])) and (r.mean is None or np.allclose((r.mean, r.lo, r.hi), (mean[d], lo[d], hi[d])))
    got = {r.month: r for r in calendar.monthly_climatology(series(spark, list(zip(days, values)))).collect()}
    matrix = p.groupby([p.index.year, p.index.month]).mean().unstack(level=0)
    for m in matrix.index:
        assert got[m].mean == pytest.approx(matrix.loc[m].mean()) and (got[m].hi is None or got[m].hi == pytest.approx(matrix.loc[m].mean() + matrix.loc[m].std(ddof=1)))


# --- pairing and models


def _tiny(spark):
    fine = [(i, j, 24.0 + i, 30.0 + j, D(1990, 1, d), None if (i, j) == (1, 1) or d == 2 and j == 0 else 2.0 * d + i + 1) for i in range(2) for j in range(2) for d in (1, 2, 3)]
    coarse = [(0, 0, 24.4, 30.4, D(1990, 1, d), float(d) if d < 3 else None) for d in (1, 2, 3, 4)]
    return spark.createDataFrame(fine, "lat_ix int, lon_ix int, era5_lat double, era5_lon double, day date, t2m double"), spark.createDataFrame(coarse, "clat_ix int, clon_ix int, cmip_lat double, cmip_lon double, day date, tas double")


def test_pairs_keep_missing_tas_and_drop_missing_t2m(spark):
    fine, coarse = _tiny(spark)
    p = pairing.paired(fine, coarse)
    assert p.count() == 7 and p.filter("tas is null").count() == 3 and p.filter("t2m is null").count() == 0
    mask = grid.land_mask(fine)
    assert sorted(map(tuple, pairing.aligned_paired(fine, coarse, mask).collect()), key=repr) == sorted(map(tuple, p.collect()), key=repr)
    assert pairing.assignment(fine, coarse, mask).count() == 3
    assert pairing.cell_day_means(p).count() == 2
    assert pairing.paired(fine.limit(0), coarse).collect() == []


def test_fit_and_residuals(spark):
    rows = [(0.0, 0.0, 0.0, 0.0, D(1990, 1, 1), 2.0 * x + 1, float(x)) for x in range(5)] + [(0.0, 0.0, 0.0, 0.0, D(1990, 1, 1), None, 1.0), (0.0, 0.0, 0.0, 0.0, D(1990, 1, 1), 1.0, None), (0.0, 0.0, 0.0, 0.0, D(1990, 1, 1), float("inf"), 3.0)]
    p = spark.createDataFrame(rows, "era5_lat double, era5_lon double, cmip_lat double, cmip_lon double, day date, t2m double, tas double")
    f = regression.fit(p).first()
    assert (round(f.slope, 12), round(f.intercept, 12), f.n) == (2.0, 1.0, 5)
    assert [round(r.residual, 9) for r in regression.residuals(p).collect()] == [0.0] * 5
    line = regression.line_samples(p, "tas", "t2m", 3).orderBy("i").collect()
    assert [(r.x, round(r.y, 9)) for r in line] == [(0.0, 1.0), (2.0, 5.0), (4.0, 9.0)]


def test_residuals_sum_to_zero_and_standardise(spark):
    rng = random.Random(1)
    rows = [(float(k % 3), 0.0, float(k % 2), 0.0, D(1990, 1 + k % 12, 1), rng.gauss(3, 2), rng.gauss(0, 1)) for k in range(200)]
    p = spark.createDataFrame(rows, "era5_lat double, era5_lon double, cmip_lat double, cmip_lon double, day date, t2m double, tas double")
    r = regression.residuals(p)
    assert abs(r.agg(F.sum("residual")).first()[0]) < 1e-9
    assert regression.standardized(r).agg(F.stddev_samp("std_residual")).first()[0] == pytest.approx(1)
    short = {(x.era5_lat, x.day, x.residual): x.std_residual for x in regression.standardized_residuals(p).collect()}
    assert all(short[x.era5_lat, x.day, x.residual] == pytest.approx(x.std_residual) for x in regression.standardized(r).collect())
    values = np.array([x.residual for x in r.collect()])
    box = stats.box_statistics(r.withColumn("k", F.lit(1)), ["k"], "residual").first()
    q1, q3 = np.percentile(values, [25, 75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    assert np.allclose((box.q1, box.q3, box.whisker_lo, box.whisker_hi), (q1, q3, inside.min(), inside.max())) and box.n == 200


def test_bins_of_cells_keep_empty_ones(spark):
    resid = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, 3.0), (1.0, 0.0, 9.0), (2.0, 0.0, 5.0)], "cmip_lat double, cmip_lon double, residual double")
    cells = spark.createDataFrame([(0.0, 0.0, 0.2), (1.0, 0.0, None), (2.0, 0.0, 1.0), (7.0, 7.0, 0.5)], "cmip_lat double, cmip_lon double, sea_fraction double")
    got = regression.residuals_by_cell_bin(resid, cells, "sea_fraction", regression.sea_fraction_edges()).orderBy("bin").collect()
    assert [(r.n_cells, r.n, r["median"]) for r in got] == [(1, 2, 2.0), (0, 0, None), (0, 0, None), (0, 0, None), (1, 1, 5.0)]
    stats_ = spark.createDataFrame([(0,), (0,), (0,), (5,)], "n_land_pixels int")
    assert regression.pixel_count_edges(stats_) == [-1.0, 0.0, 0.0, 0.0, pytest.approx(2.0), 5.0]


def test_trends(spark):
    s = series(spark, [(D(1990 + k, 8, 1), 10 + 0.5 * k) for k in range(10)] + [(D(1990 + k, 1, 1), 1.0) for k in range(1)] + [(D(1993, 8, 2), 99.0)])
    t = regression.trends(s, ["08-01", "01-01"]).collect()
    assert [(r.date, r.n, round(r.slope, 12)) for r in t] == [("08-01", 10, 0.5)]
    rng = np.random.default_rng(0)
    y = rng.normal(size=10)
    band = regression.trend_band(spark, series(spark, [(D(1990 + k, 8, 1), float(y[k])) for k in range(10)]), ["08-01"]).orderBy("day").collect()
    x = np.arange(10.0)
    slope, icept = np.polyfit(x, y, 1)
    fit = slope * x + icept
    se = np.sqrt(((y - fit) ** 2).sum() / 8) * np.sqrt(1 / 10 + (x - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    assert np.allclose([r.fit for r in band], fit) and np.allclose([r.hi for r in band], fit + 1.8595480375308964 * se)
    assert regression.trend_band(spark, s.limit(0), ["08-01"]).collect() == []


def test_distance_bins_exclude_the_lowest(spark):
    rows = [(0.0, 0.0, 0.0, 0.0, D(1990, 1, 1), float(k), float(k % 4), float(k)) for k in range(20)]
    p = spark.createDataFrame(rows, "era5_lat double, era5_lon double, cmip_lat double, cmip_lon double, day date, t2m double, tas double, dist_deg double")
    got = regression.residuals_by_distance(p).collect()
    assert len(got) == 19 and sum(r.n for r in got) == 19
    assert regression.residuals_by_distance(p.limit(0)).collect() == []


# --- statistics


def test_kelvin(spark):
    cold = spark.createDataFrame([(20.0,), (None,)], "t double")
    warm = spark.createDataFrame([(300.15,), (100.15,)], "t double")
    assert stats.to_celsius(cold, "t").first()[0] == 20.0
    for units in ("K", "kelvin", " K "):
        assert stats.to_celsius(cold, "t", units).first()[0] == pytest.approx(-253.15)
    # One decision for the whole table, though one value is below the threshold.
    assert sorted(round(r[0], 9) for r in stats.to_celsius(warm, "t").collect()) == [-173.0, 27.0]
    tagged = cold.withColumn("t", sources.with_units(F.col("t"), "t", "K"))
    out = stats.to_celsius(tagged, "t")
    assert out.first()[0] == pytest.approx(-253.15) and sources.units_of(out, "t") == "°C" and stats.to_celsius(out, "t", sources.units_of(out, "t")).first()[0] == pytest.approx(-253.15)
    assert stats.to_celsius(cold.limit(0), "t").collect() == []


def test_spreads(spark):
    df = spark.createDataFrame([(D(1990, 1, 1), 0.0, 1.0), (D(1990, 1, 1), 60.0, 4.0), (D(1990, 1, 1), 0.0, None)], "day date, lat double, v double")
    r = stats.daily_spread(df, "v").first()
    assert (r.mean, r.sd, r.lo, r.hi, r.min, r.max) == (2.5, 1.5, 1.0, 4.0, 1.0, 4.0)  # population SD
    assert stats.weighted_daily_mean(df, "v", "lat").first().value == pytest.approx((1 + 0.5 * 4) / 1.5)
    assert stats.missing_by_day(df, "v", 4).first().missing == 0.5
    assert stats.describe(df, "v").first()["std"] == pytest.approx(np.std([1, 4], ddof=1))


def test_histogram_integrates_to_one(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(size=400)] + [("b", float(v)) for v in rng.uniform(-5, 5, 300)] + [("b", None), ("b", float("inf"))]
    got = stats.histogram(spark.createDataFrame(rows, "label string, v double"), "v", 31).collect()
    clean = [v for _, v in rows if v is not None and np.isfinite(v)]
    for label in "ab":
        mine = {r.bin: r for r in got if r.label == label}
        counts, edges = np.histogram([v for k, v in rows if k == label and v is not None and np.isfinite(v)], bins=np.linspace(min(clean), max(clean), 31))
        assert {k: r.n for k, r in mine.items()} == {k: c for k, c in enumerate(counts) if c}
        assert sum(r.density * (r.hi - r.lo) for r in mine.values()) == pytest.approx(1)


def test_hexagons_hold_all_points(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b)) for a, b in rng.normal(size=(500, 2))] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = stats.hexagons(df, "x", "y", 10).collect()
    assert sum(r.n for r in got) == 500 and len({(r.x, r.y) for r in got}) == len(got)
    assert stats.hexagons(df.limit(0), "x", "y").collect() == []
    same = spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double")
    assert [tuple(r) for r in stats.hexagons(same, "x", "y").collect()] == [(1.0, 2.0, 3)]


def test_limits_and_quantiles(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(101)], "k string, v double")
    assert tuple(stats.colour_limits(df, "v").first()) == (2.0, 98.0)
    assert tuple(stats.symmetric_limits(df, "v").first()) == (-98.0, 98.0)
    assert {r.percent: r.value for r in stats.quantiles(df, ["k"], "v").collect()} == {25: 25.0, 50: 50.0, 75: 75.0, 90: 90.0}
    m = {r.metric: r.value for r in stats.main_statistics(df.withColumn("day", F.lit("x")), "v", "d").collect()}
    assert m["iqr"] == 50 and m["sd"] == pytest.approx(np.std(range(101))) and m["days"] == 1
    assert stats.export_sample(df, 1000).count() == 101


# --- beyond


def test_lags_need_the_very_day(spark):
    df = spark.createDataFrame([(0, 0, D(1990, 1, d), float(d)) for d in (1, 2, 4)], "clat_ix int, clon_ix int, day date, tas double")
    assert [(r.tas_before, r.tas_after) for r in extensions.lagged(df).orderBy("day").collect()] == [(None, 2.0), (1.0, None), (None, None)]


def test_bilinear_hits_corners_and_middles(spark):
    pixels = spark.createDataFrame([(0, 0, 24.0, 30.0), (1, 0, 24.5, 30.5), (2, 0, 25.0, 31.0), (3, 0, 27.0, 30.0)], "lat_ix int, lon_ix int, era5_lat double, era5_lon double")
    coarse = spark.createDataFrame([(i, j, D(1990, 1, 1), float(10 * i + j)) for i in range(2) for j in range(2)], "clat_ix int, clon_ix int, day date, tas double")
    got = {r.lat_ix: r.tas for r in extensions.bilinear(pixels, coarse, [24.0, 25.0], [30.0, 31.0]).collect()}
    assert got == {0: 0.0, 1: 5.5, 2: 11.0}


def test_area_weights(spark):
    pixels = spark.createDataFrame([(0, 0, 24.5, 30.0), (1, 0, 24.0, 30.0)], "lat_ix int, lon_ix int, era5_lat double, era5_lon double")
    coarse = spark.createDataFrame([(i, j, D(1990, 1, 1), float(10 * i + j)) for i in range(2) for j in range(2)], "clat_ix int, clon_ix int, day date, tas double")
    got = {r.lat_ix: r.tas for r in extensions.area_weighted(pixels, coarse, [24.0, 25.0], [30.0, 31.0], 0.2).collect()}
    assert got == {0: pytest.approx(5.0), 1: pytest.approx(0.0)}


def test_morans_i(spark):
    board = spark.createDataFrame([(i, j, float((i + j) % 2)) for i in range(6) for j in range(6)], "lat_ix int, lon_ix int, v double")
    assert extensions.morans_i(board, "v").first().morans_i == pytest.approx(-1)
    halves = spark.createDataFrame([(i, j, float(i > 2)) for i in range(6) for j in range(6)], "lat_ix int, lon_ix int, v double")
    assert extensions.morans_i(halves, "v").first().morans_i == pytest.approx(0.8)


def test_multiple_regression(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=80), rng.normal(size=80)
    y = 1 + 2 * a - 3 * b + 0.5 * a * b + rng.normal(size=80)
    df = spark.createDataFrame([(float(p), float(q), float(r)) for p, q, r in zip(a, b, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    got = {r.term: r.coefficient for r in extensions.multiple_regression(df, "y", {"a": F.col("a"), "b": F.col("b"), "a:b": F.col("a") * F.col("b")}).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(80), a, b, a * b]), y, rcond=None)[0]
    assert np.allclose([got[k] for k in ("intercept", "a", "b", "a:b")], want)


def test_serial_correlation(spark):
    y = np.random.default_rng(2).normal(size=50)
    s = series(spark, [(D(1990, 1, 1) + dt.timedelta(k), float(v)) for k, v in enumerate(y)])
    r, e = extensions.serial_correlation(s, (1,)).first(), y - y.mean()
    assert r.durbin_watson == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum()) and r.acf_1 == pytest.approx((e[1:] * e[:-1]).sum() / (e**2).sum())


# --- sources


def test_files(spark, tmp_path):
    for n in ("t2m_1990.nc", "t2m_1991.nc", "t2m_1990 (1).nc", "other.txt"):
        (tmp_path / n).write_bytes(b"x" * 10)
    got = [r.path.rsplit("/", 1)[1].replace("%20", " ") for r in sources.list_files(spark, str(tmp_path), "t2m_*.nc").collect()]
    assert got == ["t2m_1990.nc", "t2m_1991.nc"]
    assert sources.first_match(spark, str(tmp_path), "*", "OTHER").first().length == 10
    assert sources.first_match(spark, str(tmp_path), "*.none").collect() == []
    assert "t2m_199" in sources.first_existing(spark, [str(tmp_path / "missing"), str(tmp_path)], "t2m_*")
    assert sources.first_existing(spark, [str(tmp_path / "missing")], "*") is None
    df = spark.range(3)
    sources.copy_if_missing(df, str(tmp_path / "out"))
    sources.copy_if_missing(df.limit(1), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_fetching_what_is_missing(spark, tmp_path):
    from isotherm.sources import transfer

    a, b, to = tmp_path / "a", tmp_path / "b" / "deep", tmp_path / "to"
    for d in (a, b, to):
        d.mkdir(parents=True)
    (a / "x_1990.nc").write_bytes(b"1" * 3_000_000)
    (b / "T2M_1990.nc").write_bytes(b"2" * 10)
    (b / "x_1990.nc").write_bytes(b"3")
    (to / "there.nc").write_bytes(b"old")
    (a / "no.nc").write_bytes(b"9")
    roots = (str(tmp_path / "gone"), str(a), str(tmp_path / "b"))
    asked = [
        transfer.Request("first root", str(to / "one.nc"), roots, "*1990*.nc"),
        transfer.Request("by part", f"file://{to}/two/two.nc", roots, "*1990*.nc", "t2m"),
        transfer.Request("there", str(to / "there.nc"), roots, "no.nc"),
        transfer.Request("nowhere", str(to / "no.nc"), roots, "*1991*"),
        transfer.Request("no folder", str(to / "there.nc" / "under.nc"), roots, "no.nc"),
    ]
    got = {r.label: r for r in transfer.fetch_missing(spark, asked).collect()}
    assert {k: r.status for k, r in got.items()} == {"first root": "copied", "by part": "copied", "there": "skipped", "nowhere": "missing", "no folder": "failed"}
    assert (got["first root"].length, got["first root"].size_text, got["first root"].eta) == (3_000_000, "2.9 MB", "0.1 sec")
    assert (to / "one.nc").read_bytes() == b"1" * 3_000_000 and (to / "two" / "two.nc").read_bytes() == b"2" * 10 and (to / "there.nc").read_bytes() == b"old"
    again = {r.label: r.status for r in transfer.fetch_missing(spark, asked[:2]).collect()}
    assert again == {"first root": "skipped", "by part": "skipped"}


class _Variable:
    def __init__(self, values):
        self.values = np.asarray(values)

    def __len__(self):
        return len(self.values)

    def __getitem__(self, at):
        return self.values[at]


def _library(fails=False):
    class Dataset:
        def __init__(self, path):
            if fails:
                raise OSError("not this one")
            t = np.ma.masked_invalid(np.arange(30, dtype=float).reshape(5, 2, 3))
            t[1, 0, 0] = np.ma.masked
            self.variables = {"lat": _Variable([24.0, 25.0]), "lon": _Variable([30.0, 31.0, 32.0]), "time": _Variable([0.0, 1.0, 2.0, 3.0, 4.0]), "tas": t}

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    import types

    return types.SimpleNamespace(Dataset=Dataset)


@pytest.mark.parametrize("first", [None, _library(fails=True), _library()])
def test_netcdf_is_read_by_either_library(monkeypatch, first):
    """The reader over stand-ins of both libraries: the second one reads where the first is missing or fails."""
    import importlib

    real = importlib.import_module

    def find(name, *a):
        if name == "netCDF4":
            if first is None:
                raise ModuleNotFoundError(name)
            return first
        return _library() if name == "h5netcdf.legacyapi" else real(name, *a)

    monkeypatch.setattr(sources.importlib, "import_module", find)
    reader = sources.NetCdfSource({"path": "x.nc", "variable": "tas", "lat": "lat", "lon": "lon", "steps": "2"}).reader(None)
    parts = reader.partitions()
    assert [(p.start, p.stop) for p in parts] == [(0, 2), (2, 4), (4, 5)]
    rows = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 30 and rows[5] == (25.0, 32.0, 0.0, 5.0) and rows[6] == (24.0, 30.0, 1.0, None) and rows[-1] == (25.0, 32.0, 4.0, 29.0)


def test_netcdf_that_no_library_opens(monkeypatch):
    monkeypatch.setattr(sources.importlib, "import_module", lambda name: _library(fails=True))
    with pytest.raises(OSError, match="can't be opened"):
        sources._open("x.nc")


def test_netcdf_needs_a_library(spark):
    sources.register_netcdf(spark)
    try:
        import netCDF4  # noqa: F401
    except ImportError:
        with pytest.raises(Exception, match="netCDF4 or h5netcdf"):
            spark.read.format("netcdf").option("path", "x.nc").option("variable", "t2m").load().collect()


def test_exact_quantiles_narrow_down(spark):
    """All values distinct in one group, ties, small groups: with one level and two, and intervals far smaller than the group."""
    rng = np.random.default_rng(1)
    groups = {"all": rng.normal(size=20000).tolist(), "heavy": rng.pareto(0.5, 4000).tolist(), "ties": rng.integers(0, 4, 5000).astype(float).tolist(), "few": [1.0, 2.0, 5.0], "one": [3.0]}
    df = spark.createDataFrame([(k, v) for k, x in groups.items() for v in x] + [("few", None), ("none", None)], "k string, v double").repartition(7)
    p = [0, 0.02, 0.25, 0.5, 0.75, 0.98, 1]
    for levels, accuracy in ((1, 10_000), (1, 300), (2, 300)):
        got = {r.k: (r.n, r.q) for r in stats.exact_quantiles(df, ["k"], "v", p, levels, accuracy).collect()}
        assert set(got) == set(groups)
        for k, x in groups.items():
            assert got[k][0] == len(x) and np.allclose(got[k][1], np.quantile(x, p), rtol=1e-12, atol=1e-12)
    assert np.allclose(stats.exact_quantiles(df.filter("k = 'all'"), [], "v", p).first().q, np.quantile(groups["all"], p))
    assert stats.exact_quantiles(df.limit(0), ["k"], "v", p).collect() == []
    assert tuple(stats.colour_limits(df.limit(0), "v").first()) == (None, None)


def test_fit_of_folded_pairs_is_that_of_the_pairs(spark):
    rng = random.Random(5)
    fine = [(i, j, 24.0 + i, 30.0 + j, D(1990, 1, d), rng.choice([rng.gauss(20, 5), None])) for i in range(4) for j in range(4) for d in range(1, 20)]
    coarse = [(i, j, 24.5 + 2 * i, 30.5 + 2 * j, D(1990, 1, d), rng.choice([rng.gauss(18, 4), rng.gauss(18, 4), None])) for i in range(2) for j in range(2) for d in range(1, 25)]
    f = spark.createDataFrame(fine, "lat_ix int, lon_ix int, era5_lat double, era5_lon double, day date, t2m double")
    c = spark.createDataFrame(coarse, "clat_ix int, clon_ix int, cmip_lat double, cmip_lon double, day date, tas double")
    p = pairing.paired(f, c)
    a, b, sd = regression.fit_folded(pairing.folded_pairs(f, c)).first(), regression.fit(p).first(), regression.fit_with_sd(p).first().sd
    assert (a.slope, a.intercept, a.r, a.sd) == pytest.approx((b.slope, b.intercept, b.r, sd)) and a.n == b.n > 50
    assert regression.fit_folded(pairing.folded_pairs(f.limit(0), c)).first().n == 0
    both = c.withColumn("model", F.lit("a")).unionByName(c.withColumn("model", F.lit("b")).withColumn("tas", 2 * F.col("tas")))
    m = {r.model: r.slope for r in regression.fit_folded(pairing.folded_pairs(f, both), ["model"]).collect()}
    assert m["a"] == pytest.approx(b.slope) and m["b"] == pytest.approx(b.slope / 2)
    assert pairing.paired(f, both).count() == 2 * p.count()


def test_pairs_join_by_index_and_find_lines_once(spark, sf_dir):
    """T19: no double is a join key; and no scan filter looks a line up."""
    from isotherm.plans import registry

    for name in ("mean_residual_map", "resid_by_sea_fraction", "cell_stats", "resid_by_distance"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in plan.split("\n") if "Join [" in x]
        assert joins and not any(c in x.split("Join")[1].split("Inner")[0].split("Left")[0] for x in joins for c in ("_lat#", "_lon#"))
        assert not any("array(" in x or "[23.0" in x or "abs((" in x and "era5" in x for x in plan.split("\n") if "Filter" in x)


def test_normality_and_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(2, 3, 700)
    got = extensions.normality(spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double"), "v").first()
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    from math import erf

    cdf = np.array([0.5 * (1 + erf(v / 2**0.5)) for v in z])
    d = max((np.arange(1, 701) / 700 - cdf).max(), (cdf - np.arange(700) / 700).max())
    assert got.n == 700 and got.d == pytest.approx(d, abs=1e-6) and 0.05 < got.p <= 1
    skewed = extensions.normality(spark.createDataFrame([(float(v),) for v in rng.exponential(size=2000)], "v double"), "v").first()
    assert skewed.p < 1e-6
    assert extensions.normality(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").collect() == []
    cells = [(float(c), 0.0, float(c + rng.normal())) for c in range(30) for _ in range(20)]
    r = extensions.random_intercept(spark.createDataFrame(cells, "cmip_lat double, cmip_lon double, residual double")).first()
    assert r.n == 600 and r.n_cells == 30 and r.var_error == pytest.approx(1, abs=0.2) and r.var_cell == pytest.approx(np.var(range(30), ddof=1), rel=0.1)


def test_partial_autocorrelation(spark):
    rng = np.random.default_rng(6)
    y = [0.0, 0.0]
    for _ in range(800):
        y.append(0.5 * y[-1] + 0.3 * y[-2] + rng.normal())
    s = series(spark, [(D(1990, 1, 1) + dt.timedelta(k), float(v)) for k, v in enumerate(y)])
    r = extensions.partial_autocorrelation(s, 4).first()
    e = np.array(y) - np.mean(y)
    acf = [1.0] + [float((e[k:] * e[:-k]).sum() / (e**2).sum()) for k in range(1, 5)]
    for k in range(1, 5):
        m = np.array([[acf[abs(i - j)] for j in range(k)] for i in range(k)])
        assert r[f"pacf_{k}"] == pytest.approx(np.linalg.solve(m, acf[1 : k + 1])[-1])
