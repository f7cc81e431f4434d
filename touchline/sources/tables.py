"""Parquet tables by folder, with timestamps kept free of zones."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; FileNotFoundError, naming the path, where it is missing."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no parquet table at {path}") from e
        raise


def save_parquet(df: DataFrame, path: str | PurePath, partition_by: list[str] | None = None) -> None:
    """Overwrite ``path``, parents included; partitioned by columns where asked."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(str(path))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))
