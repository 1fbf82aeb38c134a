"""Sounds of words from a pronunciation lexicon, given as a table (word string, sounds array<string>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloquent.functions.udf import per_row

MOST_BROADCAST = 200_000
SOUNDS = "array<array<string>>"


def entries(lexicon: DataFrame) -> DataFrame:
    """One entry per word in lower case: of several the shortest, then the smallest. Null words and empty lists are none."""
    x = lexicon.select(F.lower("word").alias("word"), "sounds").filter(F.col("word").isNotNull() & (F.size("sounds") > 0))
    return x.groupBy("word").agg(F.min(F.struct(F.size("sounds").alias("n"), "sounds")).alias("e")).select("word", F.col("e.sounds").alias("sounds"))


def with_sounds(df: DataFrame, id_col: str, words: dict[str, Column], lexicon: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` with a column ``array<array<string>>`` per entry of ``words`` (arrays of words): each word's sounds, or null.

    Only entries whose word occurs in ``df`` are used. Up to ``most`` of them (counted, not assumed) are sent to the
    tasks, where the words of a row are looked up without a shuffle. Of more than that, words and entries are joined by
    word and gathered by ``id_col``, which must then tell the rows apart. The result is the same.
    """
    for name, c in words.items():
        df = df.withColumn(f"_{name}", F.transform(c, lambda w: F.lower(w)))
    used = None
    for name in words:
        x = df.select(F.explode(f"_{name}").alias("word"))
        used = x if used is None else used.unionByName(x)
    found = entries(lexicon).join(used.distinct(), "word", "left_semi")
    few = found.limit(most + 1).collect()
    if len(few) <= most:
        shared = df.sparkSession.sparkContext.broadcast({r["word"]: list(r["sounds"]) for r in few})
        look = per_row(lambda ws: None if ws is None else [shared.value.get(w) for w in ws], SOUNDS)
        return df.select("*", *[look(f"_{name}").alias(name) for name in words]).drop(*[f"_{name}" for name in words])
    for name in words:
        placed = df.select(id_col, F.posexplode(f"_{name}").alias("pos", "word")).join(found, "word", "left")
        rows = placed.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "sounds"))).alias("s"))
        df = df.join(rows.select(id_col, F.col("s.sounds").alias("_found")), id_col, "left")
        none = F.when(F.col(f"_{name}").isNotNull(), F.array().cast(SOUNDS))
        df = df.withColumn(name, F.coalesce("_found", none)).drop("_found", f"_{name}")
    return df


def observed(words: DataFrame) -> DataFrame:
    """A lexicon out of scored words (word string, sounds array<string>): the sounds each word is most often shown with.

    Of equally frequent ones the smallest. Words without sounds have no entry.
    """
    x = words.select(F.lower("word").alias("word"), "sounds").filter(F.col("word").isNotNull() & (F.size("sounds") > 0))
    n = x.groupBy("word", "sounds").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("k"), "sounds", "n")).alias("b"))
    return best.select("word", F.col("b.sounds").alias("sounds"), F.col("b.n").alias("n"))
