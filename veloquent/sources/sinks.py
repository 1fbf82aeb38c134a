"""Writers: append, replaced partitions, JSON columns, pronunciation dictionaries, reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from veloquent import session
from veloquent.functions import lexicon, phonemes, text
from veloquent.operators.upsert import upsert


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write the partitions the rows belong to anew and leave all others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def read_upserted(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """The table that ``upsert_into`` keeps below ``path``, or some parts of it."""
    m = json.loads(session.read_bytes(spark, f"{path}/current.json"))
    schema = StructType.fromJson(m["schema"])
    dirs = [f"{path}/gen={g}/part={p}" for p, g in sorted(m["parts"].items()) if only is None or int(p) in only]
    return spark.read.schema(schema).parquet(*dirs) if dirs else spark.createDataFrame([], schema)


def upsert_into(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], newest: str, parts: int = 64) -> list[int]:
    """Upsert into a table kept below ``path``; gives the parts that were written anew.

    Rows lie in ``parts`` parts by a hash of their key (fixed when the table is made), and only parts with a key of the
    batch are read and rewritten. The list of current parts is replaced at the end, at once, so readers never see half
    a batch; what it no longer names is removed with the next batch, when readers of the old list have had their time.
    """
    known = "current.json" in session.files(spark, path)
    m = json.loads(session.read_bytes(spark, f"{path}/current.json")) if known else {"n": parts, "generation": 0, "parts": {}}
    part = F.pmod(F.xxhash64(*keys), F.lit(m["n"])).cast("int").alias("part")
    batch = session.staged(new, "upsert")
    touched = sorted(r[0] for r in batch.select(part).distinct().collect())
    old = read_upserted(spark, path, touched) if known else batch.limit(0)
    state, g = upsert(old, batch, keys, newest), m["generation"] + 1
    session.delete_path(spark, f"{path}/gen={g}")  # of a batch that was cut short
    state.select("*", part).repartition(min(m["n"], max(1, len(touched))), "part").write.partitionBy("part").parquet(f"{path}/gen={g}")
    for done in session.files(spark, path):
        if done.startswith("gen=") and done != f"gen={g}":
            for p in session.files(spark, f"{path}/{done}"):
                if p.startswith("part=") and m["parts"].get(p[5:]) != int(done[4:]):
                    session.delete_path(spark, f"{path}/{done}/{p}")
    m |= {"generation": g, "parts": m["parts"] | {str(p): g for p in touched}, "schema": json.loads(state.schema.json())}
    session.write_bytes(spark, f"{path}/current.json", json.dumps(m).encode())
    session.unstage(spark, batch)
    return touched


def nested_as_json(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text, all else as it is."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (StructType, ArrayType, MapType)) else F.col(f"`{f.name}`") for f in df.schema])


def dictionary(df: DataFrame, text_col: str, known: DataFrame | None = None) -> DataFrame:
    """(value): ``word<tab>symbols`` of each distinct word of the texts, as an aligner's dictionary.

    Words of the lexicon ``known`` (word, sounds) have its sounds, by a join of distinct words.
    """
    words = df.select(F.explode(text.tokens(F.lower(text_col))).alias("word")).distinct()
    if known is None:
        return words.select(phonemes.dictionary_udf("word").alias("value")).filter("value IS NOT NULL")
    found = words.join(lexicon.entries(known), "word", "left")
    return found.select(phonemes.dictionary_udf("word", "sounds").alias("value")).filter("value IS NOT NULL")


def write_dictionary(df: DataFrame, text_col: str, path: str, known: DataFrame | None = None) -> None:
    dictionary(df, text_col, known).write.mode("overwrite").text(path)


def report(df: DataFrame, name: str, score: str) -> DataFrame:
    """(value): a Markdown table of names and scores with their mean first; made for summaries, so one file."""
    rows = df.select(F.lit(1).alias("k"), F.col(name).alias("n"), F.format_string("| %s | %.2f |", F.col(name), F.col(score)).alias("value"))
    head = df.agg(F.format_string("Mean: %.2f over %d rows\n\n| name | score |\n|-|-|", F.coalesce(F.avg(score), F.lit(0.0)), F.count(F.lit(1))).alias("value")).select(F.lit(0).alias("k"), F.lit("").alias("n"), "value")
    return head.unionByName(rows).orderBy("k", "n").select("value")


def write_report(df: DataFrame, name: str, score: str, path: str) -> None:
    report(df, name, score).coalesce(1).write.mode("overwrite").text(path)
