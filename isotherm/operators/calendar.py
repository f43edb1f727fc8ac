"""Calendars: shared days, seasons, fixed dates, and means over months and years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..schema import BAND


def shared_days(a: DataFrame, b: DataFrame) -> DataFrame:
    """Days that both tables have, each once."""
    return a.select("day").filter("day is not null").intersect(b.select("day").filter("day is not null"))


def align(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables cut to the shared days, and those days. Repeated times stay."""
    days = shared_days(a, b)
    return a.join(days, "day", "left_semi"), b.join(days, "day", "left_semi"), days


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: a keyed join would multiply their rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def on_date(df: DataFrame, month_day: str) -> DataFrame:
    return df.filter(E.month_day(F.col("day")) == month_day)


def with_season(df: DataFrame) -> DataFrame:
    return df.withColumn("season", E.season(F.col("day")))


def seasonal_split(df: DataFrame, day: str = "day") -> dict[str, DataFrame]:
    """The four seasons as filters of one table, where a caller wants them apart."""
    return {s: df.filter(E.season(F.col(day)) == s) for s in ("DJF", "MAM", "JJA", "SON")}


def _label(freq: str):
    return F.last_day("day") if freq == "ME" else E.year_end(F.col("day"))


def _periods(series: DataFrame, freq: str) -> DataFrame:
    """Every period from the first to the last of each label, those without days too."""
    ends = series.groupBy("label").agg(F.min(_label(freq)).alias("lo"), F.max(_label(freq)).alias("hi"))
    step = F.expr("interval 1 month") if freq == "ME" else F.expr("interval 1 year")
    starts = F.sequence(F.trunc("lo", "month" if freq == "ME" else "year"), F.col("hi"), step)
    return ends.select("label", F.explode(starts).alias("day")).select("label", _label(freq).alias("period"))


def resample_mean(series: DataFrame, freq: str) -> DataFrame:
    """(label, period, value): means of a daily series by month ("ME") or year ("YE"), labelled by its last day.

    A period without days is there with NULL.
    """
    means = series.groupBy("label", _label(freq).alias("period")).agg(F.avg("value").alias("value"))
    return _periods(series, freq).join(means, ["label", "period"], "left")


def resample_band(series: DataFrame, freq: str, method: str | None) -> DataFrame:
    """(label, period, mean, lo, hi): mean with one sample SD around it ("sd"), or the 5th and 95th percentile.

    With another method there is no band, and no row.
    """
    v = F.col("value")
    if method == "sd":
        lo, hi = F.avg(v) - F.stddev_samp(v), F.avg(v) + F.stddev_samp(v)
    elif method == "percentile":
        lo, hi = F.percentile(v, BAND[0]), F.percentile(v, BAND[1])
    else:
        return series.select("label", F.col("day").alias("period"), F.col("value").alias("mean"), F.col("value").alias("lo"), F.col("value").alias("hi")).limit(0)
    bands = series.groupBy("label", _label(freq).alias("period")).agg(F.avg(v).alias("mean"), lo.alias("lo"), hi.alias("hi"))
    return _periods(series, freq).join(bands, ["label", "period"], "left")


def series_frequency(series: DataFrame) -> DataFrame:
    """(label, freq): YE if days are more than 300 apart on average, else ME."""
    gap = F.try_divide(F.datediff(F.max("day"), F.min("day")), F.count("*") - 1)
    return series.groupBy("label").agg(F.when(gap > 300, "YE").otherwise("ME").alias("freq"))


def monthly_climatology(series: DataFrame, method: str | None = "sd") -> DataFrame:
    """(label, month, mean, lo, hi): mean over years of the means of each month, with a band across years."""
    yearly = series.groupBy("label", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.avg("value").alias("value"))
    v = F.col("value")
    band = {"sd": (F.avg(v) - F.stddev_samp(v), F.avg(v) + F.stddev_samp(v)), "percentile": (F.percentile(v, BAND[0]), F.percentile(v, BAND[1]))}.get(method, (F.lit(None).cast("double"),) * 2)
    return yearly.groupBy("label", "month").agg(F.avg(v).alias("mean"), band[0].alias("lo"), band[1].alias("hi"))


def month_year_matrix(series: DataFrame, years: list[int]) -> DataFrame:
    """A row for each month and a column for each year, for export; the climatology needs no pivot."""
    monthly = series.select(F.month("day").alias("month"), F.year("day").alias("year"), "value")
    return monthly.groupBy("month").pivot("year", years).agg(F.avg("value"))


def labels_in_order(series: DataFrame, position: str) -> DataFrame:
    """Distinct labels by first appearance."""
    return series.groupBy("label").agg(F.min(position).alias("first")).withColumn("pos", F.row_number().over(Window.orderBy("first", "label")) - 1).select("label", "pos")
