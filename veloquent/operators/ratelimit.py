"""Calendar-window counters and admission: minutes lie in days and days in months, so one pass over each suffices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veloquent.tables import once

PERIODS = ("minute", "day", "month")


def counters(logs: DataFrame, key: str = "api_key_id", at: str = "created_at", id_col: str = "id") -> DataFrame:
    """(key, period, period_start, n): requests per calendar minute, day and month.

    Minutes are counted from the rows, days and months from the minutes.
    """
    rows = once(logs.filter(F.col(at).isNotNull()), id_col, F.col(key), F.date_trunc("minute", at).alias("minute"))
    minutes = rows.groupBy(key, "minute").agg(F.count(F.lit(1)).alias("n"))
    starts = F.array(*[F.struct(F.lit(p).alias("period"), F.date_trunc(p, "minute").alias("period_start")) for p in PERIODS])
    return minutes.select(key, F.inline(starts), "n").groupBy(key, "period", "period_start").agg(F.sum("n").alias("n"))


def decisions(logs: DataFrame, keys: DataFrame, key: str = "api_key_id", at: str = "created_at", id_col: str = "id") -> DataFrame:
    """(id, key, at, denied_by): each request in order of (time, id), denied by minute, day or month, or null if served.

    Only served requests use up a limit of a longer period, and a period once full stays full to its end; so the
    requests served within a minute are its first ones, and how many earlier ones count against the day and the
    month follows from totals per minute. Row windows therefore never span more than a key's minute, and the
    windows above them see at most 44,640 minutes a month, whatever share of the rows a key holds.
    Null limits do not limit; requests of unknown keys are not limited; requests without a time are left out.
    """
    limits = keys.select(F.col("id").alias(key), *[F.coalesce(F.col(f"{n}_limit"), F.lit(2**31 - 1)).cast("bigint").alias(f"{p}_limit") for n, p in (("minute", "minute"), ("daily", "day"), ("monthly", "month"))])
    rows = once(logs.filter(F.col(at).isNotNull()), id_col, F.col(key), F.col(at)).withColumn("minute", F.date_trunc("minute", at))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key, "minute").orderBy(at, id_col)).cast("bigint"))
    minutes = rows.groupBy(key, "minute").agg(F.count(F.lit(1)).alias("n")).join(limits, key, "left").fillna(2**31 - 1, [f"{p}_limit" for p in PERIODS])
    before = lambda period, c: F.coalesce(F.sum(c).over(Window.partitionBy(key, F.date_trunc(period, "minute")).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = minutes.withColumn("by_minute", F.least("n", "minute_limit")).withColumn("day_before", before("day", "by_minute"))
    m = m.withColumn("by_day", F.greatest(F.lit(0), F.least("by_minute", F.col("day_limit") - F.col("day_before")))).withColumn("month_before", before("month", "by_day"))
    x = ranked.alias("r").join(m.drop("n").alias("m"), F.col(f"r.{key}").eqNullSafe(F.col(f"m.{key}")) & (F.col("r.minute") == F.col("m.minute")))
    why = F.when(F.col("rn") > F.col("minute_limit"), "minute").when(F.col("day_before") + F.col("rn") > F.col("day_limit"), "day").when(F.col("month_before") + F.col("rn") > F.col("month_limit"), "month")
    return x.select(f"r.{id_col}", f"r.{key}", f"r.{at}", why.alias("denied_by"))
