"""Features of a work from the strictly earlier works of its staff.

The inequality join with all earlier works of a person is rewritten: works are summed by (name, year), a cumulative
range frame up to the year before gives each (name, year) its past, and credits join it by equality. A person's
window holds at most one row per year, so no group is large however many works a person has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orizuru.functions.expressions import MAIN_ROLES, PSEUDO_COUNT, exact_sum, pseudo_count

TOP_TALENT = 0.4


def people(credits: DataFrame) -> DataFrame:
    """Different persons of each work, studios left out."""
    return credits.where(F.col("role") != "studio").select("work_id", "name").distinct()


def past(credits: DataFrame, works: DataFrame) -> DataFrame:
    """(name, year, n, sum_z, max_z) of the works of `name` before `year`, for all years of works with that name."""
    dated = people(credits).join(works.where(F.col("z").isNotNull()).select("work_id", "year", "z"), "work_id")
    by_year = dated.groupBy("name", "year").agg(F.count("*").alias("c"), F.sum(F.col("z").cast("decimal(20,9)")).alias("s"), F.max("z").alias("m"))
    before = W.partitionBy("name").orderBy("year").rangeBetween(W.unboundedPreceding, -1)
    return by_year.select(
        "name",
        "year",
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("n"),
        F.coalesce(F.sum("s").over(before).cast("double"), F.lit(0.0)).alias("sum_z"),
        F.max("m").over(before).alias("max_z"),
    )


def _with_past(credits: DataFrame, works: DataFrame) -> DataFrame:
    dated = credits.join(works.where(F.col("z").isNotNull()).select("work_id", "year"), "work_id")
    return dated.join(past(credits, works), ["name", "year"])


def _weight() -> Column:
    return F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.coalesce("ep_ratio", F.lit(1.0))))


def _genga(mine: Column) -> list[Column]:
    """Features of key animators over rows with their past, of those rows where `mine` holds."""
    s = F.col("sum_z") / (F.col("n") + PSEUDO_COUNT["genga"])
    w = F.when(mine, _weight())
    return [
        (exact_sum(w * s) / exact_sum(w)).alias("genga_weighted_s"),
        F.avg(F.when(mine, (s > TOP_TALENT).cast("double"))).alias("genga_top_density"),
        F.max(F.when(mine, s)).alias("genga_max_s"),
        F.sum(F.when(mine, 1.0)).alias("genga_total_count"),
        F.avg(F.when(mine, (F.col("n") > 0).cast("double"))).alias("genga_experienced_ratio"),
        exact_sum(w).alias("genga_sum_weights"),
    ]


def _role(mine: Column, m: Column, prefix: str = "") -> list[Column]:
    """Features of the members of a role over the sums of their pasts."""
    k, t = F.sum(F.when(mine, F.col("n"))), exact_sum(F.when(mine, F.col("sum_z")))
    return [
        F.when(k > 0, t / (k + m)).otherwise(0.0).alias(f"{prefix}bayesian_s"),
        F.when(k > 0, t / k).otherwise(0.0).alias(f"{prefix}mean_z"),
        F.coalesce(F.max(F.when(mine, F.col("max_z"))), F.lit(0.0)).alias(f"{prefix}max_z"),
        k.cast("double").alias(f"{prefix}past_count"),
    ]


def _all_features() -> list[Column]:
    """All 34 features of a work in one aggregation over the rows of its staff."""
    out = _genga(F.col("role") == "genga")
    for r in MAIN_ROLES:
        out += _role(F.col("role") == r, F.lit(PSEUDO_COUNT[r]), f"{r}_")
    return out


def genga_features(credits: DataFrame, works: DataFrame) -> DataFrame:
    """Features of a work's key animators; works without any are absent here and 0 in the matrix."""
    return _with_past(credits, works).where("role = 'genga'").groupBy("work_id").agg(*_genga(F.lit(True)))


def role_features(credits: DataFrame, works: DataFrame) -> DataFrame:
    """(work_id, role, bayesian_s, mean_z, max_z, past_count) of the main roles, over the pasts of all its members."""
    rows = _with_past(credits, works).where(F.col("role").isin(*MAIN_ROLES))
    return rows.groupBy("work_id", "role").agg(*_role(F.lit(True), pseudo_count(F.first("role"))))


GENGA_COLUMNS = ["genga_weighted_s", "genga_top_density", "genga_max_s", "genga_total_count", "genga_experienced_ratio", "genga_sum_weights"]
ROLE_COLUMNS = ["bayesian_s", "mean_z", "max_z", "past_count"]
FEATURES = [*GENGA_COLUMNS, *[f"{r}_{c}" for r in MAIN_ROLES for c in ROLE_COLUMNS]]


def feature_matrix(credits: DataFrame, works: DataFrame) -> DataFrame:
    """One row per work with z: work_id, year, z and the 34 features, 0 where nothing is known. The pasts are joined
    once and all features come from one aggregation by work."""
    base = works.where(F.col("z").isNotNull()).select("work_id", "year", "z")
    made = _with_past(credits, works).groupBy("work_id").agg(*_all_features())
    return base.join(made, "work_id", "left").fillna(0.0, FEATURES)


def complete_matrix(known: DataFrame, credits: DataFrame, works: DataFrame) -> DataFrame:
    """A matrix for all works with z from features computed before: those of `known` stay, the missing are computed."""
    base = works.where(F.col("z").isNotNull()).select("work_id", "year", "z")
    kept = base.join(known.select("work_id", *FEATURES), "work_id")
    new = base.join(known.select("work_id"), "work_id", "left_anti").select("work_id")
    made = _with_past(credits, works).join(new, "work_id", "left_semi").groupBy("work_id").agg(*_all_features())
    return kept.unionByName(base.join(new, "work_id", "left_semi").join(made, "work_id", "left").fillna(0.0, FEATURES))


def features_of(staff: DataFrame, year: int, credits: DataFrame, works: DataFrame, own_id: str | None = None) -> DataFrame:
    """One row of features of a planned work: `staff` (role, pos, name, ep_ratio) is small and its names select the
    history before anything is joined; works of the same or a later year, and `own_id`, don't count."""
    dated = people(credits).join(staff.select("name").distinct(), "name", "left_semi")
    dated = dated.join(works.where(F.col("z").isNotNull() & (F.col("year") < year) & (F.col("work_id") != F.lit(own_id or ""))).select("work_id", "z"), "work_id")
    known = dated.groupBy("name").agg(F.count("*").alias("n"), exact_sum("z").alias("sum_z"), F.max("z").alias("max_z"))
    rows = staff.join(known, "name", "left").fillna(0, ["n"]).fillna(0.0, ["sum_z"])
    return rows.agg(*_all_features()).fillna(0.0)
