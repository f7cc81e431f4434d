"""Queries of problem 9: the sentences of every document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import sentences as S
from touchline.sources.tables import table

#: Bounds of the training sample: texts a language label at most, and code points of a text in it.
SAMPLE_PER_LABEL, SAMPLE_CHARS = 200, 4000
#: Labels with a sample of their own; the rarer ones share one more.
MOST_LABELS = 40


def training_texts(documents: DataFrame, per_label: int = SAMPLE_PER_LABEL, most_chars: int = SAMPLE_CHARS, most_labels: int = MOST_LABELS) -> list[str]:
    """At most per_label * (most_labels + 1) texts, a hash of the id deciding which, the same at every size.

    Long texts are left out of the sample, never cut. The bound holds for any table.
    """
    short = documents.filter((F.length("text") <= most_chars) & F.col("text").isNotNull()).select("doc_id", "text", F.lower(F.substring(F.coalesce("lang", F.lit("")), 1, 2)).alias("label"))
    common = short.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "label").limit(most_labels).select(F.col("label").alias("_own"))
    short = short.join(F.broadcast(common), F.col("label") == F.col("_own"), "left").withColumn("label", F.col("_own"))  # at most most_labels rows
    counts = short.groupBy(F.col("label").alias("_l")).agg(F.count(F.lit(1)).alias("n"))
    share = short.join(F.broadcast(counts), F.col("label").eqNullSafe(F.col("_l")))  # one row more
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    picked = share.filter(draw < F.lit(float(per_label)) / F.col("n")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label * (most_labels + 1))
    return [r["text"] for r in picked.select("text").collect()]


def sentences(documents: DataFrame, model: S.Model) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence; texts are read whole, whatever their length.

    Null and blank texts have no sentence. A text repeated under another id is cut again under that id.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, a, b) for i, t in zip(part["doc_id"], part["text"]) for a, b in S.split(t, model)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "end_pos"]).astype({"doc_id": "int64", "start_pos": "int32", "end_pos": "int32"})

    tasks = documents.sparkSession.sparkContext.defaultParallelism * 4
    spread = documents.select("doc_id", "text").repartition(tasks, "doc_id")
    return spread.mapInPandas(run, "doc_id long, start_pos int, end_pos int")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document."""
    documents = table(spark, sf_dir, "documents")
    return sentences(documents, S.train(training_texts(documents)))


QUERIES = {"p9_found": p9_found}
SQL: dict[str, str] = {}
