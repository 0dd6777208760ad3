"""Stage tables (Parquet) and result records (JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None) -> None:
    """Replace the stage table; with ``partition_by`` only the partitions present in ``df``."""
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines, or files that each hold one JSON array."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_record_arrays(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Pretty-printed files that each hold one JSON array of records."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("multiLine", True).json(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
