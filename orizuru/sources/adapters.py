"""The engine's logical tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orizuru.operators import nested
from orizuru.session import table

ROLES = ("director", "series_comp", "char_design", "unit_director", "sakkan", "music", "art_dir", "genga", "studio")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, work_id, title, title_en, year, raw_score, z (a stand-in target for operators that need no model)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        F.col("p_partkey").cast("string").alias("work_id"),
        F.col("p_name").alias("title"),
        F.concat("p_brand", F.lit(" "), "p_type").alias("title_en"),
        (F.lit(1970) + F.col("p_size")).cast("int").alias("year"),
        (F.col("p_retailprice") - 900).alias("raw_score"),
        ((F.col("p_retailprice") - 950) / 25).alias("z"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, score; several ratings of an item by a user are legal and all count."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").cast("string").alias("item_id"),
        F.greatest(F.lit(10.0), F.least(F.lit(100.0), 2 * F.col("l_quantity"))).alias("score"),
    )


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_ord, work_id, role, pos, name, rank, ep_ratio, one row per credited name."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    persons = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(persons, F.col("o_custkey") == F.col("c_custkey"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 9 + 1).cast("int"))
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "c_name"]
    ranked = joined.withColumn("role", role).withColumn("pos", F.row_number().over(W.partitionBy("l_partkey", "role").orderBy(*order)))
    return ranked.select(
        F.col("l_partkey").alias("work_ord"),
        F.col("l_partkey").cast("string").alias("work_id"),
        "role",
        "pos",
        F.col("c_name").alias("name"),
        F.col("l_linenumber").cast("double").alias("rank"),
        (10 * F.col("l_discount")).alias("ep_ratio"),
    )


#: What a missing year counts as, when works are listed and when their history is taken.
LISTED_YEAR, HISTORY_YEAR = 2020, 0


def works_of(metadata: DataFrame) -> DataFrame:
    """Catalogued works as the engine's works, each once: ord (the number in the id), work_id, title, title_en, year,
    listed_year, raw_score, format, episodes, anilist_id, bangumi_id. A missing score is null, a missing title the id."""
    return metadata.select(
        F.coalesce(F.regexp_extract("work_id", r"(\d+)$", 1).try_cast("long"), F.lit(0)).alias("ord"), "work_id", F.coalesce("title", "work_id").alias("title"), F.coalesce("title_en", F.lit("")).alias("title_en"),
        F.coalesce("year", F.lit(HISTORY_YEAR)).alias("year"), F.coalesce("year", F.lit(LISTED_YEAR)).alias("listed_year"), F.col("anilist_mean_score").alias("raw_score"), "format", "episodes", "anilist_id", "bangumi_id",
    ).distinct()


def credits_of(metadata: DataFrame, maps: bool = True) -> DataFrame:
    """Credits of the works (not of their episodes) as the engine's credits, each once: a missing rank is the place in
    the list, a missing share 1. Names that are keys of a map have place 0 and rank 1 unless they bring one; the
    records of persons leave them out (`maps=False`), the features keep them."""
    rows = nested.flatten_credits(metadata).where("ep_pos = 0")
    rows = rows if maps else rows.where("pos > 0")
    genga = F.col("role") == "genga"
    return rows.select(
        F.coalesce(F.regexp_extract("work_id", r"(\d+)$", 1).try_cast("long"), F.lit(0)).alias("work_ord"), "work_id", "role", F.col("pos").cast("int").alias("pos"), "name",
        F.when(genga, F.coalesce("rank", F.greatest("pos", F.lit(1)).cast("double"))).otherwise(1.0).alias("rank"), F.when(genga, F.coalesce("ep_ratio", F.lit(1.0))).otherwise(1.0).alias("ep_ratio"),
    ).distinct()
