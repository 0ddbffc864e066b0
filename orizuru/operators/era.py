"""Standardise item biases within windows of release years that widen until they hold enough items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orizuru.session import cut

EPS = 1e-6


def _merge(years: DataFrame, keys: list[str], mean: str, deviation: str) -> DataFrame:
    """Mean, population deviation and count over years that are counted (c), averaged (a) and have a variance (v)."""
    parts = years.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("a")) / F.sum("c")).alias("_m"), F.collect_list(F.struct("c", "a", "v")).alias("_l"))
    spread = F.aggregate("_l", F.lit(0.0), lambda t, x: t + x["c"] * (x["v"] + (x["a"] - F.col("_m")) * (x["a"] - F.col("_m"))))
    return parts.select(*keys, F.col("_m").alias(mean), F.sqrt(spread / F.col("n")).alias(deviation), "n")


def year_stats(items: DataFrame, window: int = 3, min_items: int = 3, widest: int = 15) -> DataFrame:
    """(year, mu, sigma, n, w) of each year of `items` (year, b).

    w is the smallest half-width from `window` to `widest` with at least `min_items` items; without one the global
    statistics hold and w is null. The items are counted, averaged and spread by year once; the windows are merged from
    the table of years, which alone meets itself, by equality, over the years each one lies near to.
    """
    valid = items.where(F.col("year").isNotNull() & F.col("b").isNotNull() & ~F.isnan("b")).select("year", "b")
    years = cut(valid.groupBy("year").agg(F.count("*").alias("c"), F.avg("b").alias("a"), F.coalesce(F.var_pop("b"), F.lit(0.0)).alias("v")))
    overall = _merge(years, [], "gm", "gs").drop("n")
    near = years.select(F.explode(F.sequence(F.col("year") - widest, F.col("year") + widest)).alias("y"), "*").join(years.select(F.col("year").alias("y")), "y")
    widths = F.explode(F.sequence(F.greatest(F.lit(window), F.abs(F.col("year") - F.col("y"))), F.lit(widest))).alias("w")
    sized = near.select("y", "c", widths).groupBy("y", "w").agg(F.sum("c").alias("n"))
    chosen = sized.groupBy("y").agg(F.min(F.when(F.col("n") >= min_items, F.col("w"))).alias("w"), F.max("n").alias("few"))
    inside = near.join(chosen.where("w is not null"), "y").where(F.abs(F.col("year") - F.col("y")) <= F.col("w"))
    joined = chosen.join(_merge(inside, ["y"], "m", "s"), "y", "left").join(F.broadcast(overall.withColumn("gs", F.col("gs") + EPS)))  # one row
    sigma = F.when(F.col("s") < EPS, F.col("gs")).otherwise(F.coalesce("s", "gs"))
    return joined.select(F.col("y").alias("year"), F.coalesce("m", "gm").alias("mu"), sigma.alias("sigma"), F.coalesce("n", "few").alias("n"), "w")


def standardise(items: DataFrame, stats: DataFrame) -> DataFrame:
    """`items` (..., year, b) with z = (b - mu) / max(sigma, eps)."""
    return items.join(stats.select("year", "mu", "sigma"), "year").withColumn("z", (F.col("b") - F.col("mu")) / F.greatest("sigma", F.lit(EPS))).drop("mu", "sigma")


def standardise_known(rows: DataFrame, stats: DataFrame, overall: tuple[float, float]) -> DataFrame:
    """`rows` (..., year, b) with z; years without statistics take the global ones."""
    out = rows.join(stats.select("year", "mu", "sigma"), "year", "left")
    z = (F.col("b") - F.coalesce("mu", F.lit(overall[0]))) / F.greatest(F.coalesce("sigma", F.lit(overall[1])), F.lit(EPS))
    return out.withColumn("z", z).drop("mu", "sigma")


def invert(rows: DataFrame, stats: DataFrame, overall: tuple[float, float], z: str = "z") -> DataFrame:
    """`rows` (..., year, z) with b = z * sigma + mu; years without statistics take the global ones."""
    out = rows.join(stats.select("year", "mu", "sigma"), "year", "left")
    b = F.col(z) * F.coalesce("sigma", F.lit(overall[1])) + F.coalesce("mu", F.lit(overall[0]))
    return out.withColumn("b", b).drop("mu", "sigma")
