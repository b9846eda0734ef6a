"""The raw archive: captured bodies as rows, from Parquet or from files named by date, run and hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schemas import SCHEMAS


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["raw_payloads"]).parquet(path)


def read_files(spark: SparkSession, folder: str, dates: str = "*") -> DataFrame:
    """body, captured date, run and hash of files at folder/date/run/hash; dates is a glob."""
    parts = F.split("path", "/")
    files = spark.read.format("binaryFile").load(f"{folder}/{dates}/*/*")
    return files.select(F.col("content").cast("string").alias("body"), F.element_at(parts, -3).alias("date"), F.element_at(parts, -2).alias("run"), F.element_at(parts, -1).alias("payload_hash"), F.col("length").alias("uncompressed_size"))
