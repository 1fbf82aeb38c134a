"""Insert, update and upsert over plain files: the new state of a table as a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """Old and new rows, the newest per key (new before old on ties, then the larger row); all columns of both.

    Versions of a key are compared within each task before the shuffle, so a key with any number of them is a row per task.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c != "_new"]
    rest = [c for c in names if c not in (*keys, newest)]
    last = both.groupBy(*keys).agg(F.max(F.struct(newest, "_new", *rest)).alias("_row"))
    return last.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in names])


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there yet; null keys never conflict."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def patch(old: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows with the changes' non-null values in place; one row of changes per key."""
    fields = [c for c in changes.columns if c not in keys]
    c = changes.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields])
    x = old.join(c, list(keys), "left")
    return x.select(*[F.coalesce(f"_new_{n}", n).alias(n) if n in fields else F.col(n) for n in old.columns])
