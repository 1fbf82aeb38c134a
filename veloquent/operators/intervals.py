"""Which intervals lie inside which, by bucketed range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-4


def contained(outer: DataFrame, inner: DataFrame, on: str, width: float, epsilon: float = EPSILON) -> DataFrame:
    """Pairs of intervals (outer_*, inner_* of label, start, end) of the same ``on``, inner within outer up to epsilon.

    Outer intervals go into every bucket of ``width`` they touch, inner ones into that of their middle only, so
    that pairs meet once and the join is an equality on (on, bucket); a long recording is spread over its buckets.
    Inner labels that are blank or name silence are left out; null bounds lie in nothing.
    """
    silent = F.regexp_replace(F.lower("label"), "[^a-z0-9']+", "").isin("", "sil", "sp")
    bucket = lambda t: F.floor(t / width)
    a = outer.select(on, *[F.col(c).alias(f"outer_{c}") for c in ("label", "start", "end")])
    a = a.withColumn("_b", F.explode(F.sequence(bucket(F.col("outer_start") - epsilon), bucket(F.col("outer_end") + epsilon))))
    b = inner.filter(~silent).select(on, *[F.col(c).alias(f"inner_{c}") for c in ("label", "start", "end")], bucket((F.col("start") + F.col("end")) / 2).alias("_b"))
    inside = (F.col("inner_start") + epsilon >= F.col("outer_start")) & (F.col("inner_end") - epsilon <= F.col("outer_end"))
    return a.join(b, [on, "_b"]).filter(inside).drop("_b")


def words_with_phones(words: DataFrame, phones: DataFrame, on: str, width: float = 10.0, epsilon: float = EPSILON) -> DataFrame:
    """(on, label, start, end, phones): each spoken word with the phones inside it, by start; none is an empty list.

    ``phones`` is an array of (start, end, label), in order of start. Words whose label is blank or names silence are no
    spoken words; the others stay, whether or not a phone lies in them.
    """
    spoken = words.select(on, "label", "start", "end").filter(~F.regexp_replace(F.lower(F.trim("label")), "[^a-z0-9']+", "").isin("", "sil", "sp")).distinct()
    inside = contained(spoken, phones, on, width, epsilon)
    key = [on, "outer_label", "outer_start", "outer_end"]
    grouped = inside.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("inner_start").alias("start"), F.col("inner_end").alias("end"), F.col("inner_label").alias("label")))).alias("phones"))
    grouped = grouped.select(on, *[F.col(f"outer_{c}").alias(c) for c in ("label", "start", "end")], "phones")
    none = F.array().cast("array<struct<start:double,end:double,label:string>>")
    return spoken.join(grouped, [on, "label", "start", "end"], "left").withColumn("phones", F.coalesce("phones", none))
