"""Readers, writers and the inline code list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dosewise.session import scratch_dir


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    sampling_ratio: float = 0.1,
) -> DataFrame:
    """CSV with a header. Without a schema the types are guessed from a sample."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", sampling_ratio).csv(path)


def scan_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def export_csv(df: DataFrame, path: str) -> str:
    """Write with a header, replacing what is there."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def persist_stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    The copy outlives lost executors and cuts the lineage, so later steps that
    use the stage several times neither recompute nor re-join it.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def code_list_filter(
    rows: DataFrame, codes: str, code: str = "atc3", columns: tuple[str, ...] = ("prod", "fcc", "p_id", "trans_date", "atc3")
) -> DataFrame:
    """Distinct ``columns`` of the rows whose code is in a blank-separated list."""
    listed = codes.split()
    return rows.where(F.col(code).isin(listed)).select(*columns).distinct()
