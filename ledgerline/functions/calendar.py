"""Calendar dimension and date expressions (smart keys, padded names)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import schemas as S

# Text columns of the calendar are blank-padded to this width (the source
# system's 'Month' / 'Day' formats pad to the longest English name).
NAME_WIDTH = 9


def date_key(d: Column) -> Column:
    """YYYYMMDD integer key of a date."""
    return F.date_format(d, "yyyyMMdd").cast("int")


def month_name(d: Column) -> Column:
    return F.rpad(F.date_format(d, "MMMM"), NAME_WIDTH, " ")


def day_name(d: Column) -> Column:
    return F.rpad(F.date_format(d, "EEEE"), NAME_WIDTH, " ")


def day_of_week(d: Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return (F.dayofweek(d) - 1).cast("smallint")


def calendar_rows(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"),
                             F.expr("INTERVAL 1 DAY"))).alias("full_date"))


def dim_date(spark: SparkSession, start: str = S.CALENDAR_START,
             end: str = S.CALENDAR_END) -> DataFrame:
    """One row per day; size is fixed by the range (12,053 rows for 2018-2050)."""
    d = F.col("full_date")
    return calendar_rows(spark, start, end).select(
        date_key(d).alias("date_sk"),
        d.alias("full_date"),
        F.dayofmonth(d).cast("smallint").alias("day"),
        F.month(d).cast("smallint").alias("month"),
        month_name(d).alias("month_name"),
        F.quarter(d).cast("smallint").alias("quarter"),
        F.year(d).cast("smallint").alias("year"),
        F.weekofyear(d).cast("smallint").alias("week_of_year"),
        day_of_week(d).alias("day_of_week"),
        day_name(d).alias("day_name"),
        day_of_week(d).isin(0, 6).alias("is_weekend"),
        (d == F.last_day(d)).alias("is_month_end"),
    )


def calendar_size(start: str = S.CALENDAR_START, end: str = S.CALENDAR_END) -> int:
    from datetime import date
    return (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
