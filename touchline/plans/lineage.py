"""Cutting lineage in the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at ``spark.checkpoint.dir``; a temporary folder only in local mode where that is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="touchline-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (an action) and return it without its history."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
