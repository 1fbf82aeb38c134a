"""Exact percentiles per group by bisection over mergeable histograms of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloquent import session
from veloquent.tables import once

PERCENTILES = (25, 50, 75, 90, 95, 99)


def histogram(df: DataFrame, id_col: str, value: str, groups: Sequence[str]) -> DataFrame:
    """(kind, grp, value, n): per group column and its value, how often each number occurs.

    This is the partial result: histograms of days or files merge by adding. Rows count once per id; null
    values are no values; all numbers count, zero and negative ones too; a null group is a group.
    """
    rows = once(df.filter(F.col(value).isNotNull()), id_col, F.col(value).cast("bigint").alias("value"), *groups)
    kinds = F.explode(F.array(*[F.struct(F.lit(g).alias("kind"), F.col(g).cast("string").alias("grp")) for g in groups])).alias("g")
    return rows.select(kinds, "value").groupBy("g.kind", "g.grp", "value").agg(F.count(F.lit(1)).alias("n"))


def merge(*parts: DataFrame) -> DataFrame:
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    return x.groupBy("kind", "grp", "value").agg(F.sum("n").alias("n"))


def percentiles(hist: DataFrame, wanted: Sequence[int] = PERCENTILES, levels: int = 8) -> DataFrame:
    """(kind, grp, n, percentile, value): the smallest value that at least p % of the group's rows do not exceed.

    The error is zero. For each group and percentile an interval (lo, hi] holds the target rank, with the
    count of rows up to ``lo``. A pass counts the rows between the midpoints of ``levels`` halvings at once,
    keeps the part in which the rank falls, and ends when every interval holds one integer: for a value range
    of 2**32 after 32/levels passes. Rows outside the open intervals are not counted again, and after every second
    pass the histogram is cut down to those inside one.

    Passes read the staged histogram; each one's intervals are written to the shared folder, which cuts the lineage,
    in place of the last ones. Groups are joined to their intervals; Spark broadcasts these only where it measures
    them small.
    """
    spark = hist.sparkSession
    parts = 1 << levels
    left = session.staged(hist, "histogram")
    ends = left.groupBy("kind", "grp").agg(F.sum("n").alias("total"), (F.min("value") - 1).alias("lo"), F.max("value").alias("hi"))
    rank = F.greatest(F.lit(1), F.floor((F.col("p") * F.col("total") + 99) / 100)).cast("bigint")
    state = ends.select("kind", "grp", "total", F.explode(F.array(*[F.lit(p) for p in wanted])).alias("p"), "lo", "hi", F.lit(0).cast("bigint").alias("base"))
    state = session.staged(state.withColumn("rank", rank), "intervals")
    width = F.col("hi") - F.col("lo")
    keys = ["kind", "grp", "total", "p", "lo", "hi", "base", "rank"]
    edge = lambda i: F.col("lo") + F.floor(width * i / parts).cast("bigint")
    widest = state.agg(F.max(width)).first()[0] or 0
    n_pass = 0
    while widest > 1:
        s, h = state.filter(width > 1).alias("s"), left.alias("h")
        inside = (F.col("h.value") > F.col("lo")) & (F.col("h.value") <= F.col("hi"))
        meets = F.col("h.kind").eqNullSafe(F.col("s.kind")) & F.col("h.grp").eqNullSafe(F.col("s.grp")) & inside
        if n_pass and n_pass % 2 == 0:
            fewer = session.staged(h.join(s, meets, "left_semi"), "histogram")
            session.unstage(spark, left)
            left, h = fewer, fewer.alias("h")
        rows = h.join(s, meets).select(*[F.col(f"s.{c}").alias(c) for c in keys], F.col("h.value").alias("value"), F.col("h.n").alias("n"))
        # the smallest k with value <= lo + floor(width * k / parts)
        k = F.ceil((F.col("value") - F.col("lo")) * parts / width).cast("bigint")
        k = F.when(F.col("value") > edge(k), k + 1).when(F.col("value") <= edge(k - 1), k - 1).otherwise(k)
        bins = rows.select(*keys, k.alias("k"), "n").groupBy(*keys, "k").agg(F.sum("n").alias("n"))
        listed = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("bins"))  # at most 2**levels entries
        zero = F.struct(F.lit(None).cast("bigint").alias("k"), F.col("base").alias("below"))

        def step(a, b):
            return F.when(a["k"].isNotNull(), a).when(a["below"] + b["n"] >= F.col("rank"), F.struct(b["k"].alias("k"), a["below"].alias("below"))).otherwise(F.struct(a["k"].alias("k"), (a["below"] + b["n"]).alias("below")))

        hit = listed.withColumn("at", F.aggregate("bins", zero, step))
        narrowed = hit.select("kind", "grp", "total", "p", edge(F.col("at.k") - 1).alias("lo"), edge(F.col("at.k")).alias("hi"), F.col("at.below").alias("base"), "rank")
        new = session.staged(narrowed.unionByName(state.filter(width <= 1)), "intervals")
        session.unstage(spark, state)
        state, n_pass = new, n_pass + 1
        widest = -(-widest // parts)  # no part is wider
    return state.select("kind", "grp", F.col("total").alias("n"), F.col("p").alias("percentile"), F.col("hi").alias("value"))
