"""What several operators read from the candidates table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.plans.current import current_candidates, tidy  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
