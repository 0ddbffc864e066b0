"""Ranks, comparison, search, browsing, detail and merging of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from orizuru.functions import text
from orizuru.functions.expressions import deviation, rnd, verdict
from orizuru.operators.ranking import placed


def ranks(works: DataFrame, predicted: str = "predicted_z") -> DataFrame:
    """Row-number ranks by predicted score, raw score and z; works without a value count as 0."""
    key = lambda c: rnd(F.coalesce(F.col(c), F.lit(0.0)), 9)
    out = works.select("work_id", "ord", key(predicted).alias("_pred"), key("raw_score").alias("_raw"), key("z").alias("_z"))
    for name in ("pred", "raw", "z"):
        out = placed(out, [F.col(f"_{name}").desc(), "ord"], f"{name}_rank")
    return out.select("work_id", "pred_rank", "raw_rank", "z_rank")


def comparison(works: DataFrame, biases: DataFrame, stats: DataFrame, mean: float, overall: tuple[float, float], predicted: str = "predicted_z") -> DataFrame:
    """True and predicted quality side by side, for works with z only; sorted by rounded z, first works first."""
    from orizuru.operators.era import invert

    ranked = works.join(ranks(works, predicted), "work_id").where(F.col("z").isNotNull())
    inverted = invert(ranked.join(biases, F.col("work_id") == F.col("item_id"), "left").drop("item_id"), stats, overall, predicted)
    residual = F.col("z") - F.col(predicted)
    out = inverted.select(
        "ord", "work_id", "title", "year", rnd(F.col("raw_score"), 1).alias("raw_score"), rnd(F.coalesce("b_i", F.lit(0.0)), 2).alias("debiased"),
        rnd(F.col("z"), 3).alias("true_z"), deviation(F.col("z")).alias("deviation_score"), rnd(F.col(predicted), 3).alias("predicted_z"),
        rnd(F.greatest(F.lit(10.0), F.least(F.lit(100.0), F.lit(mean) + F.col("b"))), 1).alias("predicted_score"),
        "z_rank", "pred_rank", "raw_rank", rnd(residual, 3).alias("residual"), verdict(residual).alias("verdict"),
    )
    return out.orderBy(F.col("true_z").desc(), "ord").drop("ord")


def _holds(column: Column, query: str) -> Column:
    return F.contains(column, F.lit(query)) if query else F.lit(False)


def search(works: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Works whose titles contain the query as typed or in the search form, by z to two digits."""
    raw = query.strip().lower()
    form = text.search_form_of(query)
    hit = F.lit(False)
    for c in ("title", "title_en"):
        hit = hit | _holds(F.lower(F.coalesce(c, F.lit(""))), raw) | _holds(text.search_form(F.col(c)), form)
    found = works.where(hit).select("ord", "work_id", "title", "title_en", "year", rnd(F.coalesce("z", F.lit(0.0)), 2).alias("true_z"), deviation(F.coalesce("z", F.lit(0.0))).alias("deviation_score"))
    return found.orderBy(F.col("true_z").desc(), "ord").limit(limit).drop("ord")


def era_filter(era: str) -> Column:
    """Decades; the oldest holds everything before 1990."""
    y = F.col("year")
    if era in ("", "all"):
        return F.lit(True)
    start = int(era.rstrip("s"))
    return y < 1990 if start == 1980 else (y >= start) & (y < start + 10)


def browse(works: DataFrame, credits: DataFrame, query: str = "", tier: str = "", era: str = "", sort: str = "deviation_score", descending: bool = True, page: int = 1, size: int = 50) -> DataFrame:
    """One page of works, filtered by titles or credited names, tier and era. `works` holds a tier column."""
    rows = works.where(era_filter(era))
    if tier not in ("", "all"):
        rows = rows.where(F.col("tier") == tier)
    if query:
        q = text.client_form_of(query)
        named = credits.where(_holds(text.client_form(F.col("name")), q)).select("work_id").distinct().withColumn("named", F.lit(True))
        rows = rows.join(named, "work_id", "left").where(_holds(text.client_form(F.col("title")), q) | _holds(text.client_form(F.col("title_en")), q) | F.coalesce("named", F.lit(False))).drop("named")
    key = F.collate(F.col(sort), "ja") if dict(works.dtypes)[sort] == "string" else F.col(sort)
    return rows.orderBy(key.desc() if descending else key.asc(), "ord").offset((page - 1) * size).limit(size)


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def merge(old: DataFrame, new: DataFrame, key: str = "work_id") -> DataFrame:
    """New rows win, known keys keep their place, unknown ones are appended in their own order."""
    last = old.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last"))
    values = [c for c in old.columns if c not in (key, "ord")]
    o = old.select(key, F.col("ord").alias("_old"), F.struct(*values).alias("_o"))
    n = new.select(key, F.col("ord").alias("_new"), F.struct(*values).alias("_n"))
    both = o.join(n, key, "full_outer").join(F.broadcast(last))  # one row
    place = F.coalesce("_old", F.col("last") + F.col("_new"))
    return both.select(place.alias("ord"), key, F.coalesce("_n", "_o").alias("_v")).select("ord", key, "_v.*")


def uncollected(catalogue: DataFrame, existing: DataFrame, limit: int) -> DataFrame:
    """Entries not collected yet, or collected without an outer id; all of them where none is left."""
    open_ = catalogue.join(existing.where(F.coalesce("bangumi_id", F.lit(0)) != 0).select("anilist_id"), "anilist_id", "left_anti")
    left = open_.agg(F.count("*").alias("_left"))
    known = existing.where(F.coalesce("bangumi_id", F.lit(0)) != 0).select("anilist_id").distinct().withColumn("_known", F.lit(True))
    rows = catalogue.join(known, "anilist_id", "left").join(F.broadcast(left))  # one row
    return rows.where(F.col("_known").isNull() | (F.col("_left") == 0)).drop("_known", "_left").orderBy("ord").limit(limit)


def filter_comparison(rows: DataFrame, title: str = "", verdict_part: str = "") -> DataFrame:
    """Rows of a comparison whose title and verdict contain the given parts; empty parts match all."""
    return rows.where(F.contains(F.lower("title"), F.lit(title.strip().lower())) & F.contains("verdict", F.lit(verdict_part)))
