"""Totals and averages over trailing days, days without activity included, by binary doubling."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veloquent.tables import once


def daily(df: DataFrame, key: str, at: str, id_col: str, measures: Sequence[str]) -> DataFrame:
    """Per key and day: ``requests``, and per measure its sum and (``<m>_n``) how many were not null.

    Rows count once per id; rows without a time have no day and stay out; a null key is a key.
    """
    rows = once(df.filter(F.col(at).isNotNull()), id_col, F.col(key).alias("key"), F.to_date(at).alias("day"), *measures)
    aggs = [F.count(F.lit(1)).alias("requests")]
    for m in measures:
        aggs += [F.coalesce(F.sum(F.col(m).cast("bigint")), F.lit(0)).alias(m), F.count(m).alias(f"{m}_n")]
    return rows.groupBy("key", "day").agg(*aggs)


def calendar(days: DataFrame, values: Sequence[str], first: date, last: date) -> DataFrame:
    """Every key with every day from ``first`` to ``last``, 0 where it has no row.

    A key's days come from one array of dates and its rows from one map by day: both are as long as the
    calendar, never as long as the data.
    """
    per_key = days.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("day", F.struct(*values)))).alias("_by"))
    dense = per_key.select("key", "_by", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    hit = F.element_at("_by", F.col("day"))
    return dense.select("key", "day", *[F.coalesce(hit[v], F.lit(0)).alias(v) for v in values])


def trailing(df: DataFrame, key: str, at: str, id_col: str, measures: Sequence[str], windows: Sequence[int] = (7, 30), most_days: int = 36_525) -> DataFrame:
    """Per key and day of the calendar, for each window of w days ending that day:

    ``requests_<w>d``, ``avg_requests_<w>d`` (per day), and per measure ``<m>_<w>d``, ``avg_<m>_<w>d`` (per
    day) and ``mean_<m>_<w>d`` (per row that has the measure, null if none has).

    Sums of 1, 2, 4, 8, ... days come from adding a block to itself shifted by its length; a window is the
    sum of the blocks of its binary digits, each shifted past those before it. Each doubling is a lag over
    the same partitioning and order, so that one shuffle and one sort of the daily rows serve all windows.
    Days before the calendar's first count as days without activity. A calendar of more than ``most_days`` days
    is an error, since a single stray date would multiply every key's rows; such rows are for the caller to judge.
    """
    values = ["requests", *[x for m in measures for x in (m, f"{m}_n")]]
    span = df.agg(F.min(F.to_date(at)), F.max(F.to_date(at))).first()  # one row; without any day the calendar is empty
    if span[0] and (span[1] - span[0]).days >= most_days:
        raise ValueError(f"{at} runs from {span[0]} to {span[1]}, more than {most_days} days; filter stray dates or raise most_days")
    days = daily(df, key, at, id_col, measures)
    x = calendar(days, values, *span) if span[0] else days.select("key", "day", *values)
    order = Window.partitionBy("key").orderBy("day")

    def back(c: str, n: int):
        return F.lag(c, n, 0).over(order) if n else F.col(c)

    x = x.select("key", "day", *[F.col(v).alias(f"{v}__1") for v in values])
    block = 1
    while block * 2 <= max(windows):
        x = x.withColumns({f"{v}__{2 * block}": F.col(f"{v}__{block}") + back(f"{v}__{block}", block) for v in values})
        block *= 2

    def window_sum(v: str, w: int):
        total, shift = None, 0
        for b in (1 << i for i in reversed(range(w.bit_length())) if w >> i & 1):
            part = back(f"{v}__{b}", shift)
            total, shift = part if total is None else total + part, shift + b
        return total

    sums = x.select("key", "day", *[window_sum(v, w).alias(f"{v}_{w}d") for v in values for w in windows])
    out = [F.col("key").alias(key), F.col("day")]
    for w in windows:
        out += [F.col(f"requests_{w}d"), (F.col(f"requests_{w}d") / w).alias(f"avg_requests_{w}d")]
        for m in measures:
            s, n = F.col(f"{m}_{w}d"), F.col(f"{m}_n_{w}d")
            out += [s, (s / w).alias(f"avg_{m}_{w}d"), F.when(n > 0, s / n).alias(f"mean_{m}_{w}d")]
    return sums.select(*out)
