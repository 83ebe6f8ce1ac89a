"""Sinks: tables, bundles of tables with their settings, snapshots."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.cache import config_hash


def write_table(df: DataFrame, path: str, csv_twin: bool = False) -> None:
    """Parquet or CSV by suffix, overwritten; a CSV twin beside a Parquet table if asked for."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    elif path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
        if csv_twin:
            write_table(df, path.removesuffix(".parquet") + ".csv")
    else:
        raise ValueError(f"neither .parquet nor .csv: {path}")


def save_bundle(tables: Mapping[str, DataFrame], folder: str, options: Mapping[str, object]) -> None:
    """All tables, and their settings with a hash that the next load compares."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}.parquet")
    row = [(config_hash(options), json.dumps(dict(options), sort_keys=True, default=str))]
    spark.createDataFrame(row, "hash string, options string").coalesce(1).write.mode("overwrite").json(f"{folder}/config.json")


def load_bundle(spark: SparkSession, names: list[str], folder: str, options: Mapping[str, object]) -> dict[str, DataFrame] | None:
    """The tables if they are there and were made with the same settings, else None."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema("hash string, options string").json(f"{folder}/config.json").first()
        if found is None or found["hash"] != config_hash(options):
            return None
        return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    except AnalysisException:
        return None


def write_summary(report: DataFrame, path: str) -> None:
    """A report of few rows as one folder of JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)
