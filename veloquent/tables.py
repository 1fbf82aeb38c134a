"""Tables of a data folder, and rows that count once however often they were delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, id_col: str, *cols: str | Column) -> DataFrame:
    """One row per id with the given columns: the smallest of the differing versions, if there are any.

    Rows without an id have nothing to be recognised by; equal ones among them count once.
    Only the named columns travel. The shuffle is by id, so no hot key of the data can unbalance it.
    """
    wanted = df.select(F.col(id_col), *cols)
    rest = [c for c in wanted.columns if c != id_col]
    if not rest:
        return wanted.distinct()
    row = F.struct(*rest)
    picked = wanted.groupBy(id_col, F.when(F.col(id_col).isNull(), F.xxhash64(row)).alias("_anonymous")).agg(F.min(row).alias("_row"))
    return picked.select(id_col, *[F.col("_row")[c].alias(c) for c in rest])


def heavy_keys(df: DataFrame, key: str, share: int = 10_000, floor: int = 50_000) -> list:
    """Keys holding more than both ``1/share`` of the rows and ``floor`` rows.

    There are fewer than ``share`` of them, whatever the data, so they may be collected or broadcast; no other
    key leaves its task. The total comes from the files' footers where it can; counting keys is one map-side
    combined pass over the key column alone.
    """
    most = max(floor, df.count() // share)
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return sorted(r[0] for r in counts.filter(F.col("_n") > most).collect())
