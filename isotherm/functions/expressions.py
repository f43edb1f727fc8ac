"""Column expressions that operators share. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SEASONS

#: Steps of the table by which the nearest axis line is found.
MAX_STEPS = 100_000

# --- missing values


def missing_to_null(value: Column) -> Column:
    """NaN becomes NULL; infinities stay."""
    return F.when(~F.isnan(value), value)


def is_finite(value: Column) -> Column:
    """Neither NULL nor NaN nor infinite; false rather than NULL."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


# --- dates


def parse_day(text: Column) -> Column:
    """The date a text begins with, or NULL if it isn't one."""
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def month_day(day: Column) -> Column:
    return F.date_format(day, "MM-dd")


def season(day: Column) -> Column:
    """DJF, MAM, JJA or SON by calendar month; December stays in its own calendar year."""
    out = None
    for name, months in SEASONS.items():
        test = F.month(day).isin(*months)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def no_leap_day(start_year: int | Column, days: Column) -> Column:
    """The date that is so many days after 1 January of start_year in a calendar without 29 February."""
    year = (start_year if isinstance(start_year, Column) else F.lit(start_year)) + F.floor(days / 365).cast("int")
    of_year = F.pmod(days.cast("int"), F.lit(365))
    leap = F.day(F.last_day(F.make_date(year, F.lit(2), F.lit(1)))) == 29
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), of_year + F.when(leap & (of_year >= 59), 1).otherwise(0))


def day_of_months_of_30(start_year: Column, days: Column) -> Column:
    """The same in a calendar with twelve months of 30 days; NULL for the days of February that no year has."""
    month = F.make_date(start_year + F.floor(days / 360).cast("int"), F.floor(F.pmod(days, F.lit(360)) / 30).cast("int") + 1, F.lit(1))
    at = F.pmod(days, F.lit(30)).cast("int")
    return F.when(at < F.day(F.last_day(month)), F.date_add(month, at))


def decode_day(start_year: Column, days: Column, calendar: Column) -> Column:
    """The date of a count of days since 1 January of a year in a standard, noleap or 360_day calendar; else NULL."""
    standard = F.date_add(F.make_date(start_year, F.lit(1), F.lit(1)), days.cast("int"))
    return F.when(calendar == "standard", standard).when(calendar == "noleap", no_leap_day(start_year, days)).when(calendar == "360_day", day_of_months_of_30(start_year, days))


def year_end(day: Column) -> Column:
    return F.make_date(F.year(day), F.lit(12), F.lit(31))


# --- places


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180). The sum is floored towards minus infinity, so -200 is 160."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def distance_degrees(lat: Column, lon: Column, center_lat: Column, center_lon: Column) -> Column:
    """Flat distance in degrees, longitude shrunk by the cosine of the mean latitude."""
    shrink = F.cos(F.radians((lat + center_lat) / 2))
    return F.sqrt(F.pow(lat - center_lat, F.lit(2)) + F.pow((lon - center_lon) * shrink, F.lit(2)))


def area_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def map_aspect(south: Column, north: Column) -> Column:
    return 1.0 / F.cos(F.radians((south + north) / 2))


def ticks(low: Column, high: Column, step: int) -> Column:
    """Multiples of step from low to high."""
    first, last = F.ceil(low / step).cast("int") * step, F.floor(high / step).cast("int") * step
    return F.when(first <= last, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _literals(values: Sequence[float] | Sequence[int]) -> Column:
    """An array of constants, folded to one literal; parsed at once, as a call for each would take long."""
    text = lambda v: (f"{v!r}D" if math.isfinite(v) else f"double('{v}')") if isinstance(v, float) else str(v)
    return F.expr(f"array({', '.join(map(text, values))})")


def _turn(a: float, b: float, tie: bool) -> float:
    """The least value from a to b that is nearer to b by the distances that doubles give; tie: equal ones count too."""
    low, high = a, b
    while low < (mid := low + (high - low) / 2) < high:
        before, after = mid - a, b - mid
        low, high = (low, mid) if after < before or (tie and after == before) else (mid, high)
    return high


def nearest_index(value: Column, axis: Sequence[float]) -> Column:
    """Place (from 0) of the axis coordinate nearest to value, the first of equals; NULL where value is.

    A table of even steps, at most a quarter of the smallest gap wide, names for each step the line that is nearest
    at its beginning; only that one and the next can be nearest to a value in it, and the table has the value from which
    the next one is. So a row costs the same whatever the length of the axis. An axis so uneven that the table would pass
    MAX_STEPS is searched line by line. The expression is small on purpose: filters and joins repeat it where it stands
    in their keys, and a generated method above 8,000 bytes is never compiled by the JVM.
    """
    lines = sorted({float(c): k for k, c in reversed(list(enumerate(axis)))}.items())  # the first place of equal coordinates
    coords, places = [c for c, _ in lines], [k for _, k in lines]
    known = value.isNotNull()
    if len(lines) == 1:
        return F.when(known, places[0])
    step = min(b - a for a, b in zip(coords, coords[1:])) / 4
    n = math.ceil((coords[-1] - coords[0]) / step) + 1
    if n > MAX_STEPS:
        gaps = F.transform(_literals([float(a) for a in axis]), lambda a: F.abs(value - a))
        return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")
    turns = [_turn(a, b, q < p) for (a, p), (b, q) in zip(lines, lines[1:])]
    at, turn, near = 0, [], []
    for k in range(n):
        x = coords[0] + (k - 1) * step
        while at + 2 < len(coords) and abs(coords[at + 1] - x) < abs(coords[at] - x):
            at += 1
        turn.append(turns[at])
        near += places[at : at + 2]
    x = F.nanvl(value.cast("double"), F.lit(coords[0] if places[0] < places[1] else coords[1]))
    cell = F.least(F.greatest(F.floor((x - coords[0]) / step), F.lit(0)), F.lit(n - 1)).cast("int")
    return F.when(known, F.get(_literals(near), 2 * cell + (x >= F.get(_literals(turn), cell)).cast("int")))


def coordinate(index: Column, axis: Sequence[float]) -> Column:
    """The axis coordinate at a place; NULL where there is none."""
    return F.get(_literals([float(a) for a in axis]), index)


# --- bins


def linspace(low: float, high: float, n: int) -> list[float]:
    """n equally spaced values; the last one is high itself."""
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


def _edges(edges: Sequence[float] | Column) -> tuple[Column, Column]:
    array = edges if isinstance(edges, Column) else F.array(*(F.lit(float(e)) for e in edges))
    return array, F.size(array) - 1


def bin_left(value: Column, edges: Sequence[float] | Column) -> Column:
    """Bins (a, b]; what is at or below the first bin's end is in bin 0, what is above all in the last."""
    array, n = _edges(edges)
    return F.when(value.isNotNull(), F.least(F.size(F.filter(F.slice(array, F.lit(2), n), lambda e: e < value)), n - 1))


def bin_histogram(value: Column, edges: Sequence[float] | Column) -> Column:
    """Bins [a, b), the last one closed; NULL outside."""
    array, n = _edges(edges)
    inside = (value >= F.element_at(array, 1)) & (value <= F.element_at(array, -1))
    return F.when(inside, F.least(F.size(F.filter(array, lambda e: e <= value)) - 1, n - 1))


def bin_equal(value: Column, low: Column, high: Column, bins: int) -> Column:
    """bin_histogram for equally wide bins, by arithmetic instead of a search; NULL outside.

    The quotient may be off by one bin next to an edge; comparing with the edges themselves mends that.
    """
    step = (high - low) / bins
    at = F.floor((value - low) / step)
    at = at - F.when(value < low + at * step, 1).otherwise(0) + F.when(value >= low + (at + 1) * step, 1).otherwise(0)
    at = F.greatest(F.lit(0), F.least(at.cast("int"), F.lit(bins - 1)))
    return F.when((value >= low) & (value <= high), F.when(high > low, at).otherwise(0))


def bin_cut(value: Column, edges: Sequence[float] | Column) -> Column:
    """Bins (a, b]; NULL outside, and so is the lowest edge itself."""
    array, n = _edges(edges)
    at = F.size(F.filter(array, lambda e: e < value)) - 1
    return F.when((at >= 0) & (at < n), at)


def distinct_few(*columns: str) -> Column:
    """Distinct non-null values of what is bounded by an axis (cells, days), without expanding the rows.

    count(DISTINCT) of several columns copies each row once for each of them; sets of axis size don't.
    """
    whole = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    return F.size(F.collect_set(F.when(present, whole))).cast("long")


# --- labels and reports


def longitude_label(x: Column) -> Column:
    whole = F.bround(x).cast("int")
    return F.when(whole >= 0, F.concat(whole.cast("string"), F.lit("°E"))).otherwise(F.concat((-whole).cast("string"), F.lit("°W")))


def latitude_label(y: Column) -> Column:
    whole = F.bround(y).cast("int")
    return F.when(whole >= 0, F.concat(whole.cast("string"), F.lit("°N"))).otherwise(F.concat((-whole).cast("string"), F.lit("°S")))


def temperature_label(t: Column) -> Column:
    return F.concat(t.cast("int").cast("string"), F.lit("°"))


def percent_bin_label(low: Column, high: Column) -> Column:
    return F.format_string("%d–%d%%", (low * 100).cast("int"), (high * 100).cast("int"))


def _above(mark: Fraction, tie: bool) -> float:
    """The least double above a mark, or the mark itself if it is a double and a tie counts."""
    x = float(mark)
    return x if Fraction(x) > mark or (tie and Fraction(x) == mark) else math.nextafter(x, math.inf)


#: The least part of a whole that is rounded to k + 1 tenths and not to k; a quarter goes down and three quarters up, to the even digit.
_NEXT_TENTH = [_above(Fraction(2 * k + 1, 20), k % 2 == 1) for k in range(10)]


def _one_decimal(value: Column, unit: str) -> Column:
    """A number with one decimal and a unit, by the exact value of the double; a tie goes to the even digit.

    format_string rounds the shortest text that tells a double from others, so x.85 goes up even where the double is below it.
    """
    size = F.abs(value)
    whole = F.floor(size)
    part = size - whole.cast("double")  # exact
    low = F.least(F.floor(part * 10), F.lit(9)).cast("int")  # one too many only just below a tenth, where that is the nearest
    tenths = low + (part >= F.get(_literals(_NEXT_TENTH), low)).cast("int")
    text = F.format_string("%s%d.%d " + unit, F.when(value < 0, "-").otherwise(""), whole + F.floor(tenths / 10), tenths % 10)
    return F.when(size < float(1 << 63), text).otherwise(F.format_string("%.1f " + unit, value))


def format_bytes(size: Column) -> Column:
    """1024-based units with one decimal; NULL has none."""
    out, units = None, ("B", "KB", "MB", "GB", "TB")
    for k, unit in enumerate(units):
        text = _one_decimal(size.cast("double") / float(1024**k), unit)
        last = k == len(units) - 1
        out = F.when(size < 1024 ** (k + 1), text) if out is None else out.otherwise(text) if last else out.when(size < 1024 ** (k + 1), text)
    return F.when(size.isNotNull(), out)


def transfer_estimate(size: Column, mb_per_second: Column) -> Column:
    """Seconds below a minute, else minutes; 0 seconds if the rate isn't positive."""
    seconds = F.when(mb_per_second > 0, F.try_divide(size.cast("double"), mb_per_second * float(1024**2))).otherwise(0.0)
    return F.when(size.isNotNull(), F.when(seconds < 60, _one_decimal(seconds, "sec")).otherwise(_one_decimal(seconds / 60, "min")))


# --- Student's t


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t distribution for p >= 0.5, by bisection."""
    low, high = 0.0, 1e8
    for _ in range(200):
        t = (low + high) / 2
        if 1 - incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2 < p:
            low = t
        else:
            high = t
    return (low + high) / 2
