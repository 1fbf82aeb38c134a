"""One wide row per entity from its events: per event type a count, the latest time and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloquent.tables import heavy_keys


def event_types(df: DataFrame, kind: str, most: int = 2_000) -> list[str]:
    """The event types, sorted. More than ``most`` would not make columns, so that is an error."""
    found = [r[0] for r in df.select(kind).filter(F.col(kind).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{kind} has more than {most} values; use entity_runs, which is long instead of wide")
    return sorted(found)


def _rows(df: DataFrame, entity: str, kind: str, at: str, id_col: str, totals: Sequence[str]) -> DataFrame:
    values = F.struct(F.col(at).alias("at"), *[F.col(c).cast("bigint").alias(f"t{i}") for i, c in enumerate(totals)])
    return df.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("_e"), F.col(kind).alias("_k"), F.col(id_col).alias("_id"), F.when(F.col(id_col).isNull(), F.xxhash64(values)).alias("_a"), values.alias("_v"))


def _streamed(x: DataFrame, n_totals: int) -> DataFrame:
    # min and max over structs keep Spark with sorted aggregation, which needs constant memory
    one = x.groupBy("_e", "_k", "_id", "_a").agg(F.min("_v").alias("_v"))
    return one.groupBy("_e", "_k").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.col("_v.at"))).alias("_last"), *[F.sum(f"_v.t{i}").alias(f"t{i}") for i in range(n_totals)])


def _parts(df: DataFrame, entity: str, kind: str, at: str, id_col: str, totals: Sequence[str], heavy: Sequence | None) -> list[DataFrame]:
    """The runs of all ordinary entities, on their entities' partitions, and those of the heavy ones, if there are any."""
    rows = _rows(df, entity, kind, at, id_col, totals)
    heavy = heavy_keys(rows, "_e") if heavy is None else list(heavy)
    hot = F.col("_e").isin(heavy)
    cold = rows.filter(~hot) if heavy else rows
    parts = [_streamed(cold.repartition("_e").sortWithinPartitions("_e", "_k", "_id", "_a"), len(totals))]
    return parts + ([_streamed(rows.filter(hot), len(totals))] if heavy else [])


def entity_runs(df: DataFrame, entity: str, kind: str, at: str, id_col: str, totals: Sequence[str], heavy: Sequence | None = None) -> DataFrame:
    """One row per entity and type: ``n``, ``last_at`` and a sum per column of ``totals``.

    Events are bucketed by entity and sorted by (entity, type, id); sorted aggregation then streams the
    runs, first over equal ids (a repeated event counts once), then over equal types. Both use the one
    shuffle by entity. Entities of ``heavy`` (bounded in number, see ``heavy_keys``) are spread by event and
    combined before their shuffle instead, so that no task holds one of them whole.

    Null entities are no entities and yield no row; a null type is a type of its own; null times and
    totals count as events but add nothing (a sum over nothing but nulls is null). Events without an id are told
    apart by their time and totals, and equal ones count once.
    """
    parts = _parts(df, entity, kind, at, id_col, totals, heavy)
    runs = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return runs.select(F.col("_e").alias(entity), F.col("_k").alias(kind), "n", F.col("_last.at").alias("last_at"), *[F.col(f"t{i}").alias(c) for i, c in enumerate(totals)])


def entity_features(
    df: DataFrame, entity: str, kind: str, at: str, id_col: str, totals: Sequence[str], types: Sequence[str] | None = None, heavy: Sequence | None = None
) -> DataFrame:
    """One row per entity with the columns ``<type>_n``, ``<type>_last_at`` and ``<type>_<total>``.

    The runs of ``entity_runs`` are already on their entity's partition, so turning them into columns
    needs no further shuffle; heavy entities have few runs and get their columns apart, so that they do not
    take the others' partitioning away. A type an entity never had counts 0; its time and totals are null.
    ``types`` fixes the columns (other types then stay out); by default all types found, sorted. Events
    without a type are in no column, but make their entity a row.
    """
    types = event_types(df, kind) if types is None else list(types)

    def wide(runs: DataFrame) -> DataFrame:
        sums = [F.sum("n").alias("n"), F.max("_at").alias("last_at"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(len(totals))]]
        # columns are taken by place: names of types may hold anything
        x = runs.withColumn("_at", F.unix_micros("_last.at")).groupBy("_e").pivot("_k", types).agg(*sums)
        x = x.toDF("_e", *[f"c{i}" for i in range(len(x.columns) - 1)])
        place, name = map("c{}".format, range(len(x.columns))), lambda c: "`" + c.replace("`", "``") + "`"
        out = [f"_e AS {name(entity)}"]
        for t in types:  # as SQL text: hundreds of types make thousands of expressions
            out += [f"CAST(coalesce({next(place)}, 0) AS BIGINT) AS {name(f'{t}_n')}", f"timestamp_micros({next(place)}) AS {name(f'{t}_last_at')}"]
            out += [f"CAST({next(place)} AS BIGINT) AS {name(f'{t}_{c}')}" for c in totals]
        return x.selectExpr(*out)

    parts = [wide(x) for x in _parts(df, entity, kind, at, id_col, totals, heavy)]
    return parts[0].union(parts[1]) if len(parts) > 1 else parts[0]
