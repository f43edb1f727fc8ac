"""Several models, the stored layout, remapping on the sphere, and the permutation test, against plain versions."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.functions import expressions as E
from isotherm.operators import multimodel, pairing, ranks, remap
from isotherm.sources import layout

# --- calendars and several models


def test_days_of_three_calendars(spark):
    def no_leap(start, n):
        day = dt.date(start + n // 365, 1, 1) + dt.timedelta(n % 365)
        later = dt.date(day.year, 2, 28) < dt.date(day.year, 1, 1) + dt.timedelta(n % 365)
        return day + dt.timedelta(1) if later and (day.year % 4 == 0 and (day.year % 100 or day.year % 400 == 0)) else day

    def of_30(start, n):
        try:
            return dt.date(start + n // 360, n % 360 // 30 + 1, n % 30 + 1)
        except ValueError:
            return None

    days = list(range(0, 3000, 7)) + [57, 58, 59, 60, 423, 424, 425]
    df = spark.createDataFrame([(n,) for n in days], "n int")
    day = lambda c: E.decode_day(F.lit(1991), F.col("n"), F.lit(c)).alias(c)
    for r in df.select("n", day("standard"), day("noleap"), day("360_day"), day("other")).collect():
        assert (r[1], r[2], r[3], r[4]) == (dt.date(1991, 1, 1) + dt.timedelta(r.n), no_leap(1991, r.n), of_30(1991, r.n), None)
    assert any(of_30(1991, n) is None for n in days)


FINE = "lat_ix int, lon_ix int, era5_lat double, era5_lon double, day date, t2m double"
COARSE = "model string, clat_ix int, clon_ix int, cmip_lat double, cmip_lon double, day date, tas double"


def records(seed=1):
    rng = random.Random(seed)
    days = [dt.date(1991, 3, k) for k in range(1, 6)]
    fine = [(i, j, 24 + i * 0.25, 30 + j * 0.25, d, rng.choice([None, rng.random(), rng.random()])) for i in range(9) for j in range(9) for d in days]
    fine += [(50, 0, None, 30.0, days[0], 1.0), (51, 0, 24.0, 30.0, None, 1.0)]
    axes = {"a": ([24.0, 25.0, 26.0], [30.0, 31.0, 32.0]), "b": ([26.0, 24.1], [29.0, 30.6, 30.7, 33.0]), "c": ([24.0, 25.0, 26.0], [30.0, 31.0, 32.0]), "one": ([25.0], [31.0])}
    coarse = [(m, i, j, y, x, d, rng.random()) for m, (lat, lon) in axes.items() for i, y in enumerate(lat) for j, x in enumerate(lon) for d in days if rng.random() < 0.8]
    return fine, coarse, axes


def test_models_on_grids_of_their_own(spark):
    fine, coarse, axes = records()
    f, c = spark.createDataFrame(fine, FINE).repartition(3), spark.createDataFrame(coarse, COARSE).repartition(3)
    index, of = multimodel.axis_index(c)
    assert of["a"] == of["c"] and len(set(of.values())) == 3 and index.count() == 1
    at = {(m, i, j, d): t for m, i, j, _, _, d, t in coarse}
    near = lambda x, lines: min(range(len(lines)), key=lambda k: (abs(x - lines[k]), k))
    want = []
    for i, j, y, x, d, t in fine:
        if t is not None and d and y is not None:
            for m, (lat, lon) in axes.items():
                cell = (near(y, lat), near(x, lon))
                if (m, *cell, d) in at:
                    want.append((m, i, j, *cell, d, t, at[m, *cell, d]))
    out = multimodel.paired(f, c)
    assert sorted(map(tuple, out.select("model", "lat_ix", "lon_ix", "clat_ix", "clon_ix", "day", "t2m", "tas").collect())) == sorted(want)
    for r in multimodel.folded(f, c).collect():
        mine = [w for w in want if (w[0], w[3], w[4], w[5]) == (r.model, r.clat_ix, r.clon_ix, r.day)]
        assert r.n == len(mine) and r.total == pytest.approx(sum(w[6] for w in mine)) and r.low == min(w[6] for w in mine)
    assert multimodel.paired(f, c.limit(0)).collect() == []


# --- the stored layout


def plans_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_pairs_meet_without_an_exchange(spark, tmp_path):
    fine, coarse, axes = records(3)
    f = spark.createDataFrame(fine, FINE)
    c = spark.createDataFrame([r[1:] for r in coarse if r[0] == "a"], COARSE.replace("model string, ", ""))
    path = f"file://{tmp_path}/pairs"
    want = sorted(map(tuple, pairing.paired(f, c, axes=axes["a"]).collect()))
    assert want
    for _ in range(2):  # storing twice leaves the same
        layout.store(f, c, path, axes["a"], buckets=4)
        pairs = layout.open_pairs(spark, path)
        assert sorted(map(tuple, pairs.collect())) == want
    plan = plans_of(layout.open_pairs(spark, path))  # before it has run
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("SelectedBucketsCount: 4 out of 4") == 2
    assert len(list((tmp_path / "pairs" / "fine").glob("part-*"))) <= 4
    layout.store(f.limit(0), c.limit(0), path, axes["a"])
    assert layout.open_pairs(spark, path).collect() == []


# --- the sphere


def plain_overlap(a, b, latitude):
    pieces = lambda lo, hi: [(lo, hi)] if latitude else [(lo + k, hi + k) for k in (-720, -360, 0, 360, 720)]
    size = (lambda x: math.sin(math.radians(x))) if latitude else (lambda x: x)
    return sum(size(min(a[1], h)) - size(max(a[0], lo)) for lo, h in pieces(*b) if min(a[1], h) > max(a[0], lo))


def test_remapping_is_conservative(spark):
    rng = np.random.default_rng(4)
    s_lat, s_lon = np.sort(rng.uniform(-90, 90, 12)), np.cumsum(rng.uniform(5, 30, 14)) + 100
    s_lat[0], s_lat[-1] = -90, 90
    s_lon = 100 + (s_lon - s_lon[0]) * 360 / (s_lon[-1] - s_lon[0])  # once around, past the date line
    t_lat, t_lon = np.array([-90, -37.2, -5, 0.1, 0.2, 66, 90.0]), np.array([-180, -100.0, -99.5, 20, 180.0])
    values = rng.normal(size=(11, 13))
    field = spark.createDataFrame([(i, j, "x", float(values[i, j])) for i in range(11) for j in range(13)], "clat_ix int, clon_ix int, day string, v double")
    lat, lon = remap.weights(spark, (s_lat, s_lon), (t_lat, t_lon))
    wa = {(r.clat_ix, r.lat_ix): r.w for r in lat.collect()}
    wo = {(r.clon_ix, r.lon_ix): r.w for r in lon.collect()}
    spans = lambda e: list(zip(e[:-1], e[1:]))
    for got, s, t, latitude in ((wa, s_lat, t_lat, True), (wo, s_lon, t_lon, False)):
        want = {(i, j): w for i, a in enumerate(spans(s)) for j, b in enumerate(spans(t)) if (w := plain_overlap(a, b, latitude)) > 1e-12}
        assert set(got) == set(want) and got == pytest.approx(want), (set(got) ^ set(want))
    out = remap.remapped(field, "v", lat, lon).collect()
    area = lambda i, j: (math.sin(math.radians(s_lat[i + 1])) - math.sin(math.radians(s_lat[i]))) * (s_lon[j + 1] - s_lon[j])
    whole = sum(values[i, j] * area(i, j) for i in range(11) for j in range(13))
    assert sum(r.v * r.area for r in out) == pytest.approx(whole, rel=1e-9) and sum(r.area for r in out) == pytest.approx(2 * 360, rel=1e-12)
    assert len(out) == 6 * 4
    holes = remap.remapped(field.withColumn("v", F.when(F.col("clat_ix") != 3, F.col("v"))), "v", lat, lon).collect()
    assert sum(r.area for r in holes) < 720 and remap.remapped(field.limit(0), "v", lat, lon).collect() == []


def test_descending_and_partial_axes(spark):
    edges = remap.edges_of([10.0, 8.0, 5.0])
    assert edges == [11.0, 9.0, 6.5, 3.5]
    rows = {(r.source, r.target): r.w for r in remap.overlaps(remap.intervals(spark, edges, False), remap.intervals(spark, [6.5, 7.5, 40.0], False), lambda x: x).collect()}
    assert rows == {(1, 0): 1.0, (1, 1): 1.5, (0, 1): 2.0}


# --- Moran's I


def test_permutation_test(spark):
    rng = random.Random(8)
    cells = {(i, j): (i + j) * 0.5 + rng.gauss(0, 1) for i in range(7) for j in range(6) if rng.random() < 0.9}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()] + [(30, 30, None), (31, 30, float("nan"))], "lat_ix int, lon_ix int, v double").repartition(3)
    names, n = sorted(cells), len(cells)
    mean = sum(cells.values()) / n

    def index(field):
        links = [(a, (a[0] + i, a[1] + j)) for a in names for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0)) if (a[0] + i, a[1] + j) in cells]
        return n * sum((field[a] - mean) * (field[b] - mean) for a, b in links) / (len(links) * sum((x - mean) ** 2 for x in field.values())), len(links)

    own, links = index(cells)
    others = []
    for r in range(1, 40):
        order = sorted(names, key=lambda c: hashlib.md5(f"5|{r}|{c[0]}|{c[1]}".encode()).hexdigest())
        others.append(index({c: cells[names[k]] for k, c in enumerate(order)})[0])
    got = ranks.morans_i_test(df, "v", replicates=39, seed=5).first()
    assert (got.n, got.links) == (n, links) and got.morans_i == pytest.approx(own) and got.mean_i == pytest.approx(sum(others) / 39)
    assert got.p == pytest.approx((1 + sum(x >= own for x in others)) / 40) and got.p < 0.1
    assert ranks.morans_i_test(df.limit(0), "v", 3).collect() == []
    flat = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "lat_ix int, lon_ix int, v double")
    assert ranks.morans_i_test(flat, "v", 3).collect() == []
