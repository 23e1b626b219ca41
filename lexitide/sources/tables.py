"""Typed CSV and Parquet tables, parameter files, and the catalogue of runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, max_lines: int | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.limit(max_lines) if max_lines is not None else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def string_list(column) -> F.Column:
    """An array of strings from its printed form with either kind of quotes."""
    return F.from_json(F.when(column.contains('"'), column).otherwise(F.translate(column, "'", '"')), "array<string>")


def params_from_lines(lines: DataFrame) -> DataFrame:
    """(key, value) from lines of the form key:<tab>value; other lines go."""
    parts = F.split("value", ":\t", 2)
    return lines.where(F.col("value").contains(":\t")).select(parts[0].alias("key"), parts[1].alias("value"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return params_from_lines(spark.read.text(path))


def write_params(spark: SparkSession, rows: list[tuple[str, str]], path: str) -> None:
    df = spark.createDataFrame([(f"{k}:\t{v}",) for k, v in rows], "value string")
    df.coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, data, path: str) -> None:
    """A small value as one line of JSON, to any store."""
    spark.createDataFrame([(json.dumps(data, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def runs(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table name of all runs under base, with run_uid from the folders run_uid=<uid>."""
    return spark.read.option("basePath", base).parquet(f"{base}/run_uid=*/{name}")


def unpadded(params: DataFrame) -> DataFrame:
    """The first experience-gated run without an end buffer."""
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    wide = params.groupBy("run_uid").agg(of("threshold_in_days").alias("t"), of("end_buffer").alias("b"))
    return wide.where("t IS NOT NULL AND b = '0'").agg(F.min("run_uid").alias("run_uid")).where("run_uid IS NOT NULL")


def community(path_or_name, suffix: str = "_snapshots"):
    """What stands before the suffix."""
    return F.regexp_extract(path_or_name, f"^(.*?){suffix}", 1)
