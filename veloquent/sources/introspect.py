"""What the catalog knows: tables, columns, functions. Keys and indexes do not exist in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veloquent.tables import table

TABLES = ("api_keys", "api_keys_tenants", "api_usage_logs", "context_sizes", "documents", "pronunciation_analyses", "tenants")


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """The tables of a folder as temporary views."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def columns(spark: SparkSession, names=TABLES) -> DataFrame:
    """(table_name, position, column_name, data_type, nullable), in order."""
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t in names for i, f in enumerate(spark.table(t).schema)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean").orderBy("table_name", "position")


def views(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, kind string, temporary boolean").orderBy("table_name")


def routines(spark: SparkSession, pattern: str = "*") -> DataFrame:
    return spark.sql(f"SHOW FUNCTIONS LIKE '{pattern}'")
