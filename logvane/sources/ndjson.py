"""Newline-delimited JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """``event_key, path, line`` for every matching file at any depth below ``root``.

    The key numbers the lines of this scan. It is unique, but only lasting once
    written: store the normalized table and join on the stored key.
    """
    return (
        spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=pattern)
        .select(
            F.monotonically_increasing_id().alias("event_key"),
            F.col("_metadata.file_path").alias("path"),
            F.col("value").alias("line"),
        )
    )


def write_lines(lines: DataFrame, path: str, line_col: str = "line", partition_by: str | None = None) -> None:
    """One text per line, as ``.txt`` files (Spark's text writer fixes the extension)."""
    columns = [line_col] if partition_by is None else [line_col, partition_by]
    writer = lines.select(*columns).write.mode("overwrite").option("lineSep", "\n")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.text(path)
