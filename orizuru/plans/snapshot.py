"""Fit the whole chain once; queries read the tables of the snapshot."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orizuru.functions.expressions import exact_sum, rnd
from orizuru.operators import bias, era, history, model, staff
from orizuru.session import cut, table
from orizuru.sources import adapters


def bias_and_era(spark: SparkSession, sf_dir: str, rounds: int = 3) -> dict:
    """Biases after a fixed number of rounds, statistics of years, z of items, and the global statistics."""
    fitted = bias.fit(adapters.ratings(spark, sf_dir), max_iter=rounds, tol=None)
    dated = fitted["items"].join(adapters.works(spark, sf_dir).select("work_id", "year"), F.col("item_id") == F.col("work_id")).select("work_id", "year", F.col("b_i").alias("b"))
    return {"model": fitted, **_standardised(dated)}


def scored_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogued works with z: their mean score above the mean of all, standardised within its years."""
    works = adapters.works_of(table(spark, sf_dir, "anime_metadata"))
    valid = works.where("raw_score is not null and not isnan(raw_score) and year > 0")
    mean = valid.agg((exact_sum("raw_score") / F.count("*")).alias("mean"))
    dated = cut(valid.join(F.broadcast(mean)).select("work_id", "year", (F.col("raw_score") - F.col("mean")).alias("b")))  # one row
    z = era.standardise(dated, cut(era.year_stats(dated))).select("work_id", rnd(F.col("z"), 6).alias("z"))
    return works.join(z, "work_id", "left")


def _standardised(dated: DataFrame) -> dict:
    stats = cut(era.year_stats(dated))
    overall = dated.agg(F.avg("b"), F.stddev_pop("b") + era.EPS).first()
    return {"stats": stats, "z": era.standardise(dated, stats).select("work_id", "z"), "overall": (overall[0], overall[1])}


@dataclass(frozen=True)
class Snapshot:
    """Immutable result of a fit; every field but the credits given is a table in the shared folder or a small model. The
    records of persons are made when first asked for."""

    biases: dict
    stats: DataFrame
    overall: tuple[float, float]
    works: DataFrame
    matrix: DataFrame
    model: GBTRegressionModel
    credits: DataFrame

    @cached_property
    def records(self) -> DataFrame:
        return cut(staff.records(self.credits, self.works))


def fit(ratings: DataFrame, works: DataFrame, credits: DataFrame, max_iter: int = 40, trees: int = 100) -> Snapshot:
    """Ratings, works and credits -> biases -> z -> features -> model and person records.

    Ratings of unknown items still shape the mean and the users' biases; they drop out where years are joined.
    Raises where no rated work has a year, as nothing can be standardised then.
    """
    fitted = bias.fit(ratings, max_iter)
    dated = fitted["items"].join(works.select("work_id", "year"), F.col("item_id") == F.col("work_id")).where("year is not null").select("work_id", "year", F.col("b_i").alias("b"))
    dated = cut(dated)
    if not dated.take(1):
        raise ValueError("no rated work with a year")
    era_ = _standardised(dated)
    scored = cut(works.drop("z").join(era_["z"], "work_id", "left"))
    matrix = cut(history.feature_matrix(credits, scored))
    return Snapshot(fitted, era_["stats"], era_["overall"], scored, matrix, model.fit(matrix, trees=trees), credits)


def refresh(works: DataFrame, credits: DataFrame, new_works: DataFrame, ratings: DataFrame, new_ratings: DataFrame, folder: str | None = None, **fit_options) -> Snapshot:
    """Collected works put in place of those with their id or appended, their ratings added, the chain fitted anew and,
    where a folder is given, all documents of the export written."""
    from orizuru.operators.export import write_all
    from orizuru.operators.works import merge

    merged = cut(merge(works, new_works))
    out = fit(ratings.unionByName(new_ratings), merged, credits, **fit_options)
    if folder:
        write_all(out.records, out.works, credits, folder)
    return out
