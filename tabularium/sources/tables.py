"""Table scans: one Parquet table per name under a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabularium.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``; Catalyst prunes columns and pushes filters into this scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
