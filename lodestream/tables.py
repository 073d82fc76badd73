"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; zone-less timestamps are taken as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = {field.name for field in df.schema.fields if field.dataType.typeName() == "timestamp_ntz"}
    if not zoneless:
        return df
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in zoneless else F.col(c) for c in df.columns])
