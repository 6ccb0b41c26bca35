"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Read ``folder/name.parquet``; with ``columns`` only those, so that the scan is pruned."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def schema_summary(df: DataFrame, name: str) -> DataFrame:
    """``table_name, num_samples, field_no, field, type`` of each column; rows are counted, an empty table has its fields too."""
    fields = F.array(*[F.struct(F.lit(i).alias("field_no"), F.lit(field).alias("field"), F.lit(kind).alias("type")) for i, (field, kind) in enumerate(df.dtypes)])
    return df.agg(F.count("*").alias("num_samples")).select(F.lit(name).alias("table_name"), "num_samples", F.inline(fields))


def write_manifest(summary: DataFrame, folder: str, config: str | None = None) -> None:
    """One JSON row for each table of ``schema_summary``: ``dataset, config, schema``."""
    fields = F.transform(F.array_sort(F.collect_list(F.struct("field_no", "field", "type"))), lambda x: F.struct(x["field"].alias("field"), x["type"].alias("type")))
    rows = summary.groupBy(F.col("table_name").alias("dataset")).agg(F.first("num_samples").alias("num_samples"), fields.alias("fields"))
    rows.select("dataset", F.lit(config).alias("config"), F.struct("num_samples", "fields").alias("schema")).write.mode("overwrite").option("ignoreNullFields", False).json(folder)
