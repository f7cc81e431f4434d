"""Queries of problems 7 (filling containers) and 8 (mixing sources)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import mixing, packing, tokens
from touchline.plans.lineage import cut
from touchline.sources.tables import table


def sized(spark: SparkSession, sf_dir: str, vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, source, text_key and tokens of every document, written once; texts themselves are not kept."""
    documents = tokens.spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return cut(documents.select("doc_id", "source", F.md5("text").alias("text_key"), tokens.count_tokens(F.col("text"), vocabulary).alias("tokens")))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the containers of each kind."""
    items = sized(spark, sf_dir)
    kinds = table(spark, sf_dir, "container_sizes").filter("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()  # a row for each kind of container
    parts = [packing.pack(items, "doc_id", "tokens", int(k["capacity_tokens"])).withColumn("container_kind", F.lit(k["container_kind"])) for k in kinds]
    return reduce(lambda a, b: a.unionByName(b), parts)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used of each kind, against the fewest that could hold the tokens."""
    placed = p7_pack(spark, sf_dir).filter("container_id > 0").join(table(spark, sf_dir, "container_sizes"), "container_kind")
    per = placed.groupBy("container_kind", "capacity_tokens").agg(F.sum("tokens").alias("tokens"), F.count_distinct("container_id").alias("containers"))
    return per.withColumn("fewest", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mix with their uses."""
    return mixing.mix(sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mix reaches."""
    return mixing.shares(cut(p8_mix(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))


QUERIES = {"p7_pack": p7_pack, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
