"""Outputs: one JSON object a line with sorted names, month partitions, and a report as one document."""

from __future__ import annotations

from datetime import UTC

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.values import iso_utc
from tidelog.sources.files import register


def contract(df: DataFrame, algorithm: str, limit: str, version: int = 1) -> DataFrame:
    """df with the constants that every exported record carries."""
    return df.withColumns({"schema_version": F.lit(version), "algorithm": F.lit(algorithm), "interpretation_limit": F.lit(limit)})


def json_lines(df: DataFrame) -> DataFrame:
    """value: a compact JSON object of each row, names sorted, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """A folder of files of JSON lines. Spark commits it when all tasks have ended, so no half of it is ever seen as whole (_SUCCESS)."""
    json_lines(df).write.mode("overwrite").text(path)


def with_month(df: DataFrame, time: str) -> DataFrame:
    """captured_month: the UTC month (yyyy-MM) of a time, whatever the session's zone is; months are half-open."""
    return df.withColumn("captured_month", F.substring(iso_utc(F.unix_seconds(time)), 1, 7))


def write_by_month(df: DataFrame, time: str, path: str) -> None:
    with_month(df, time).write.mode("overwrite").partitionBy("captured_month").parquet(path)


def read_window(spark, path: str, time: str, since, until) -> DataFrame:
    """Rows of a window, whose ends may be in any zone; the months' partitions are pruned."""
    first, last = (f"{t.astimezone(UTC):%Y-%m}" for t in (since, until))
    months = (F.col("captured_month") >= F.lit(first)) & (F.col("captured_month") <= F.lit(last))
    return spark.read.parquet(path).where(months & (F.col(time) >= F.lit(since)) & (F.col(time) < F.lit(until)))


def guarded(df: DataFrame, most: int | None) -> DataFrame:
    """df, or an error where it has more than `most` rows (a check that is off by default)."""
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def report(most: int = 5000, **sections: DataFrame) -> DataFrame:
    """One row, one JSON document of sections, none of more than `most` rows: a longer one is an error, and write_report the way."""
    out = None
    for name, df in sections.items():
        part = guarded(df, most).agg(F.collect_list(F.struct(*sorted(df.columns))).alias(name))
        out = part if out is None else out.crossJoin(part)  # one row each
    return out.select(F.to_json(F.struct(*sections)).alias("document"))


def write_report(path: str, **sections: DataFrame) -> None:
    """JSON lines of each section, however long, in a folder of its own."""
    for name, df in sections.items():
        write_json_lines(df, f"{path}/{name}")


def report_lines(**sections: DataFrame) -> DataFrame:
    """section and value: each row of each section as a JSON line."""
    out = None
    for name, df in sections.items():
        part = json_lines(df).select(F.lit(name).alias("section"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def publish_report(path: str, **sections: DataFrame) -> None:
    """All sections as one version at path: readers see the whole report before or the whole new one."""
    lines = report_lines(**sections)
    register(lines.sparkSession)
    lines.write.format("tidelog_versions").mode("overwrite").save(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """section and value of the report that is current at path."""
    line = F.from_json("value", "section string, value string")
    return register(spark).read.format("tidelog_versions").load(path).select(line.alias("l")).select("l.*")
