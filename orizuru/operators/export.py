"""Documents of the static export: boards, works, profiles, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orizuru.functions.expressions import MAIN_ROLES, deviation, percentile, pseudo_count, rnd, score_tier, staff_tier
from orizuru.operators import staff
from orizuru.operators.ranking import placed
from orizuru.session import cut


def boards(rows: DataFrame) -> DataFrame:
    """All boards in one frame, with the compact keys of the export: one aggregation with grouping sets, then one
    ranking over all boards for each of the two orders."""
    name = F.coalesce("role", F.lit("all"))
    rolled = rows.groupingSets([["name"], ["role", "name"]], "role", "name").agg(*staff.board_columns())
    board = rolled.select(name.alias("board"), F.col("s").alias("exact"), *staff.board_row(pseudo_count(name)), (F.col("s") / (F.col("works_count") + pseudo_count(name))).alias("rating"))
    ranked = placed(board, [F.col("bayesian_rating").desc(), "ord"], "rk", ["board"], "total")
    ranked = placed(ranked, [F.col("exact").desc(), F.when(F.col("board") == "all", F.col("rating")).desc(), "ord"], "ck", ["board"])
    return ranked.select(
        "board", F.col("name").alias("n"), F.col("works_count").alias("w"), F.col("bayesian_rating").alias("r"), F.col("career_cumulative_z").alias("z"), "rk", "ck",
        staff_tier(F.col("rk"), F.col("total")).alias("rt"), staff_tier(F.col("ck"), F.col("total")).alias("ct"),
        F.col("best_work_title").alias("bt"), F.col("best_work_year").alias("by"), rnd(F.col("best_work_z"), 2).alias("bz"),
    )


def works(rows: DataFrame, catalogue: DataFrame, credits: DataFrame) -> DataFrame:
    """Works by deviation with ranks, tier, percentile and staff: an array of (name, rt, ct) for each role, key animators
    cut to the first 15, studios without tiers."""
    known = catalogue.where(F.col("z").isNotNull())
    ranked = placed(known.withColumn("_z", rnd(F.col("z"), 9)), [F.col("_z").desc(), "ord"], "deviation_rank", total="total")
    ranked = placed(ranked.withColumn("_r", rnd(F.coalesce("raw_score", F.lit(0.0)), 9)), [F.col("_r").desc(), "ord"], "raw_rank")
    ranks = staff.role_ranks(staff.ratings(rows))
    tiers = ranks.select("role", "name", staff_tier(F.col("rating_rank"), F.col("role_total")).alias("rt"), staff_tier(F.col("cumulative_rank"), F.col("role_total")).alias("ct"))
    tier = lambda c: F.when(F.col("role") != "studio", F.coalesce(c, F.lit("-")))
    first = credits.where("trim(name) <> ''").withColumn("name", F.trim("name")).where((F.col("role") != "genga") | (F.col("pos") <= 15))
    named = first.join(tiers, ["role", "name"], "left").select("work_id", "role", F.struct("pos", "name", tier("rt").alias("rt"), tier("ct").alias("ct")).alias("e"))
    lists = named.groupBy("work_id").pivot("role", [*MAIN_ROLES, "genga", "studio"]).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["name"].alias("name"), e["rt"].alias("rt"), e["ct"].alias("ct"))))
    d = deviation(F.col("z"))
    return ranked.join(lists, "work_id", "left").select(
        "work_id", "title", "title_en", "year", d.alias("deviation_score"), "deviation_rank", rnd(F.col("raw_score"), 1).alias("raw_score"), "raw_rank",
        score_tier(d).alias("tier"), rnd(percentile(F.col("deviation_rank"), F.col("total")), 2).alias("percentile"), *[*MAIN_ROLES, "genga", "studio"],
    )


def active_names(board: DataFrame, top: int = 300) -> DataFrame:
    """Persons among the first by rank or by cumulative rank on any board."""
    return board.where((F.col("rk") <= top) | (F.col("ck") <= top)).select(F.col("n").alias("name")).distinct()


def profiles(rows: DataFrame, top: int = 300) -> DataFrame:
    """Whole profiles of the active persons with their tiers among all persons."""
    out = staff.profiles(rows, cut(active_names(boards(rows), top)))
    total = F.col("total_staff")
    return out.withColumn("overall_rating_tier", staff_tier(F.col("overall_rank"), total)).withColumn("overall_cum_tier", staff_tier(F.col("cumulative_rank"), total))


def summary(catalogue: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts and span of years; years up to 1900 don't count, defaults where none is left."""
    w = catalogue.where(F.col("z").isNotNull()).agg(F.count("*").alias("total_works"), F.coalesce(F.min(F.when(F.col("year") > 1900, F.col("year"))), F.lit(1960)).alias("year_min"), F.coalesce(F.max(F.when(F.col("year") > 1900, F.col("year"))), F.lit(2026)).alias("year_max"))
    s = rows.agg(F.countDistinct("name").alias("total_staff"))
    return w.join(F.broadcast(s))  # one row each


def write_all(rows: DataFrame, catalogue: DataFrame, credits: DataFrame, folder: str) -> None:
    """All documents of the export as JSON lines below `folder`: boards by board, works, profiles, summary."""
    boards(rows).write.mode("overwrite").partitionBy("board").json(f"{folder}/leaderboards")
    works(rows, catalogue, credits).write.mode("overwrite").json(f"{folder}/works")
    profiles(rows).write.mode("overwrite").json(f"{folder}/profiles")
    summary(catalogue, rows).withColumn("updated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).write.mode("overwrite").json(f"{folder}/summary")
