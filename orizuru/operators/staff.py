"""Records, ratings, ranks, boards and profiles of persons.

Persons are ordered by first appearance (work, role, place); that ordinal settles all ties, so ranks are row numbers.
Ranks over all persons are taken by range partitions (`ranking`), over one row per person, after aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orizuru.functions import text
from orizuru.functions.expressions import PSEUDO_COUNT, STAFF_ROLES, exact_sum, pseudo_count, pseudo_counts, rnd, role_order, staff_tier
from orizuru.operators.ranking import first_placed, placed
from orizuru.session import cut


def records(credits: DataFrame, works: DataFrame) -> DataFrame:
    """One row per credit of a work with z: name, role, work_id, title, year, z, rank, ep_ratio, ord."""
    known = works.where(F.col("z").isNotNull()).select("work_id", "title", "year", "z")
    staff = credits.where(F.col("role").isin(*STAFF_ROLES) & (F.trim("name") != ""))
    ord_ = F.struct(F.col("work_ord").cast("long").alias("w"), role_order(F.col("role")).alias("r"), F.col("pos").cast("long").alias("p"))
    genga = F.col("role") == "genga"
    return staff.join(known, "work_id").select(
        F.trim("name").alias("name"), "role", "work_id", "title", "year", "z",
        F.when(genga, F.coalesce("rank", F.col("pos").cast("double"))).otherwise(1.0).alias("rank"),
        F.when(genga, F.coalesce("ep_ratio", F.lit(1.0))).otherwise(1.0).alias("ep_ratio"),
        ord_.alias("ord"),
    )


def ratings(rows: DataFrame, pseudo: dict[str, float] | None = None) -> DataFrame:
    """(role, name, n, z_sum, rating, ord), role null over all roles: one pass with grouping sets. `pseudo` replaces
    some of the pseudo-counts."""
    counts = pseudo_counts(pseudo)
    rolled = rows.groupingSets([["name"], ["role", "name"]], "role", "name").agg(F.count("*").alias("n"), exact_sum("z").alias("z_sum"), F.min("ord").alias("ord"))
    m = F.when(F.col("role").isNull(), counts["all"]).otherwise(pseudo_count(F.col("role"), counts))
    return rolled.withColumn("rating", F.col("z_sum") / (F.col("n") + m))


def overall_ranks(rated: DataFrame) -> DataFrame:
    by_rating = placed(rated.where("role is null").drop("role"), [F.col("rating").desc(), "ord"], "overall_rank", total="total_staff")
    both = placed(by_rating, [F.col("z_sum").desc(), F.col("rating").desc(), "ord"], "cumulative_rank")
    return both.select("name", "n", "rating", "z_sum", "overall_rank", "cumulative_rank", "total_staff", "ord")


def role_ranks(rated: DataFrame) -> DataFrame:
    by_rating = placed(rated.where("role is not null"), [F.col("rating").desc(), "ord"], "rating_rank", ["role"], "role_total")
    both = placed(by_rating, [F.col("z_sum").desc(), "ord"], "cumulative_rank", ["role"])
    return both.select("role", "name", "n", "rating", "z_sum", "rating_rank", "cumulative_rank", "role_total", "ord")


def board_columns() -> list[Column]:
    """Aggregates of a person's credits on a board; ties of the best work go to the first."""
    best = F.min_by(F.struct("title", "year", "z"), F.struct((-F.col("z")).alias("z"), "ord"))
    return [F.count("*").alias("works_count"), exact_sum("z").alias("s"), F.max("z").alias("p"), best.alias("b"), F.min("ord").alias("ord")]


def board_row(m: Column) -> list[Column]:
    """What a board shows of a person, rounded; `m` is the pseudo-count."""
    n = F.col("works_count")
    return [
        F.col("name"), n, rnd(F.col("s") / (n + m), 3).alias("bayesian_rating"), rnd(F.col("s"), 2).alias("career_cumulative_z"),
        rnd(F.col("s") / n, 3).alias("mean_z"), rnd(F.col("p"), 3).alias("peak_z"),
        F.col("b.title").alias("best_work_title"), F.col("b.year").alias("best_work_year"), rnd(F.col("b.z"), 3).alias("best_work_z"), F.col("ord"),
    ]


def role_of(name: str | None) -> str | None:
    """A requested role; none for those that mean all."""
    return None if name in (None, "", "all", "none", "None") else name


def leaderboard(rows: DataFrame, role: str | None = None, sort_by: str = "rating", min_works: int = 1, limit: int | None = 1000, pseudo: dict[str, float] | None = None) -> DataFrame:
    """rank, name, works_count, bayesian_rating, career_cumulative_z, mean_z, peak_z, best work; ranked by rounded values."""
    role, counts = role_of(role), pseudo_counts(pseudo)
    mine = rows if role is None else rows.where(F.col("role") == role)
    m = F.lit(counts.get(role or "all", counts["all"]))
    board = cut(mine.groupBy("name").agg(*board_columns()).where(F.col("works_count") >= max(min_works, 1)).select(*board_row(m)))
    key = "career_cumulative_z" if sort_by in ("cumulative", "z_sum") else "bayesian_rating"
    order = [F.col(key).desc(), "ord"]
    if limit is None:
        return placed(board, order, "rank", total="total_count").drop("ord")
    total = board.agg(F.count("*").alias("total_count"))
    return first_placed(board, order, "rank", limit).join(F.broadcast(total)).drop("ord")  # one row


def primary_roles(rows: DataFrame) -> DataFrame:
    """(name, primary_role, works): the most frequent role, the one seen first among equals."""
    counted = rows.groupBy("name", "role").agg(F.count("*").alias("works"), F.min("ord").alias("ord"))
    return counted.groupBy("name").agg(F.min_by(F.struct("role", "works"), F.struct((-F.col("works")).alias("w"), "ord")).alias("r")).select("name", F.col("r.role").alias("primary_role"), F.col("r.works").alias("works"))


def profile_stats(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("name").agg(F.count("*").alias("total_works"), exact_sum("z").alias("s"), F.max("z").alias("p"), F.stddev_pop("z").alias("d"))
    n = F.col("total_works")
    return out.select(
        "name", "total_works", rnd(F.col("s") / (n + PSEUDO_COUNT["all"]), 3).alias("bayesian_rating"),
        rnd(F.col("s"), 2).alias("career_cumulative_z"), rnd(F.col("s") / n, 3).alias("raw_mean_z"), rnd(F.col("p"), 3).alias("peak_z"), rnd(F.col("d"), 3).alias("std_z"),
    )


def best_works(rows: DataFrame, n: int = 3) -> DataFrame:
    """The n best credits of each person, earlier years first among equals."""
    order = W.partitionBy("name").orderBy(F.col("z").desc(), "year", "ord")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("name", "place", "work_id", "title", "year", "role", rnd(F.col("z"), 3).alias("z_score"))


def trajectory(rows: DataFrame) -> DataFrame:
    """Each person's credits by year as one array of structs."""
    entry = F.struct("year", "ord", "work_id", "role", rnd(F.col("z"), 3).alias("z_score"))
    return rows.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat_ws(":", e["year"], e["work_id"], e["role"])).alias("career"))


def role_stats(rows: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Per person and role: works, rating, sum, ranks, head-count; `place` orders the roles by works, first seen first.
    `ranks`: those among all persons, where `rows` holds some of them only."""
    ranks = role_ranks(ratings(rows)) if ranks is None else ranks
    order = W.partitionBy("name").orderBy(F.col("n").desc(), "first_year", "ord2")
    first = rows.groupBy("name", "role").agg(F.min(F.struct("year", "ord")).alias("f"))
    both = ranks.join(first, ["name", "role"]).withColumn("first_year", F.col("f.year")).withColumn("ord2", F.col("f.ord"))
    return both.select(
        "name", "role", F.row_number().over(order).alias("place"), F.col("n").alias("works_count"), rnd(F.col("z_sum"), 2).alias("cumulative_z"),
        rnd(F.col("rating"), 3).alias("bayesian_rating"), "rating_rank", "cumulative_rank", "role_total",
    )


def found(rows: DataFrame) -> DataFrame:
    """Name, works and rounded rating of the persons of some credits."""
    out = rows.groupBy("name").agg(F.count("*").alias("works_count"), exact_sum("z").alias("s"), F.min("ord").alias("ord"))
    return out.withColumn("rating", rnd(F.col("s") / (F.col("works_count") + PSEUDO_COUNT["all"]), 3))


def search(rows: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """Persons whose name contains the query, by rounded rating; a blank query matches everyone."""
    hit = rows.where(F.contains(F.lower("name"), F.lit(query.strip().lower())))
    return found(hit).orderBy(F.col("rating").desc(), "ord").limit(limit).select("name", "rating", "works_count")


def index(rows: DataFrame) -> DataFrame:
    """name -> rating over all roles and in each role, one column per role (null where not credited)."""
    rated = ratings(rows)
    return rated.groupBy("name").agg(*[F.max(F.when(F.coalesce("role", F.lit("all")) == r, rnd(F.col("rating"), 3))).alias(f"r_{r}") for r in ("all", *STAFF_ROLES)])


def profiles(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Whole profiles of the persons in `names` (name), one nested row each: statistics, ranks, role statistics ordered
    by works, the three best works and the career by year. Ranks are among all persons; only the records of the
    asked ones are nested. A name without records has no row."""
    rated = cut(ratings(rows))
    mine = rows.join(names.select("name").distinct(), "name", "left_semi")
    ranks = overall_ranks(rated).select("name", "overall_rank", "cumulative_rank", "total_staff")
    stats = role_stats(mine, role_ranks(rated))
    total = F.col("role_total")
    one = F.struct("place", "role", "works_count", "cumulative_z", "bayesian_rating", "rating_rank", "cumulative_rank", "role_total", staff_tier(F.col("rating_rank"), total).alias("rating_tier"), staff_tier(F.col("cumulative_rank"), total).alias("cum_tier"))
    nested = stats.groupBy("name").agg(F.array_sort(F.collect_list(one)).alias("all_role_stats"))
    best = best_works(mine).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "work_id", "title", "year", "role", "z_score"))).alias("best_works"))
    entry = F.struct("year", "ord", "work_id", "title", "role", rnd(F.col("z"), 3).alias("z_score"))
    career = mine.groupBy("name").agg(F.array_sort(F.collect_list(entry)).alias("career_trajectory"))
    out = profile_stats(mine).join(ranks, "name").join(nested, "name").join(best, "name").join(career, "name")
    first = F.col("all_role_stats")[0]
    return out.withColumn("primary_role", first["role"]).withColumn("role_rank", first["rating_rank"]).withColumn("role_total", first["role_total"])


def profile(rows: DataFrame, name: str) -> DataFrame:
    """The profile of one person, or no row."""
    return profiles(rows, rows.sparkSession.createDataFrame([(name,)], "name string"))


def board_page(board: DataFrame, query: str = "", sort: str = "rk", page: int = 1, size: int = 50) -> DataFrame:
    """One page of a board (n, rk, ck, ...) by `rk` or `ck`; while searching, `shown` is the place in the list found."""
    rows = board.where(F.contains(text.client_form(F.col("n")), F.lit(text.client_form_of(query)))) if query.strip() else board
    order = [F.col(sort).asc(), F.col("rk").asc(), F.col("n").asc()]
    first = first_placed(rows, order, "_place", page * size).where(F.col("_place") > (page - 1) * size)
    return first.withColumn("shown", F.col("_place") if query.strip() else F.col(sort)).drop("_place")


def fallback_roles(boards: DataFrame) -> DataFrame:
    """(n, primary_role) of persons without a profile: the role board with most works, the first board among equals."""
    place = F.when(F.lit(False), 0)
    for k, r in enumerate(STAFF_ROLES):
        place = place.when(F.col("board") == r, k)
    rows = boards.where("board <> 'all'")
    return rows.groupBy("n").agg(F.min_by("board", F.struct((-F.col("w")).alias("w"), place.alias("place"))).alias("primary_role"))
