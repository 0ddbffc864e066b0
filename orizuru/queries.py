"""Registry of the core's queries; the SQL they are compared with is in `plans.oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orizuru.functions import text
from orizuru.functions.expressions import deviation, exact_sum, percentile, rank_tier, rnd, score_tier, staff_tier, top_percent, top_text, verdict, z_of_deviation, z_tier
from orizuru.operators import bias, era, export, history, matching, model, nested, staff, works
from orizuru.plans import oracles, snapshot
from orizuru.plans.snapshot import bias_and_era, scored_works
from orizuru.session import table
from orizuru.sources import adapters, store, wiki

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _records(spark: SparkSession, d: str) -> DataFrame:
    return staff.records(adapters.credits(spark, d), adapters.works(spark, d))


# --- nested documents
@query
def p5_found(spark, d):
    return nested.found_credits(table(spark, d, "anime_metadata"))


@query
def p5_credits(spark, d):
    return nested.flatten_credits(table(spark, d, "anime_metadata")).distinct()


@query
def p5_episodes(spark, d):
    return nested.flatten_episodes(table(spark, d, "anime_metadata"))


# --- bias decomposition
@query
def global_mean(spark, d):
    return adapters.ratings(spark, d).agg(rnd(F.avg("score"), 6).alias("mean"), F.count("*").alias("n"))


def _fit5(spark, d):
    return bias.fit(adapters.ratings(spark, d), max_iter=5, tol=None)


@query
def user_bias_k5(spark, d):
    return _fit5(spark, d)["users"].select("user_id", rnd(F.col("b_u"), 6).alias("b_u"))


@query
def item_bias_k5(spark, d):
    return _fit5(spark, d)["items"].select("item_id", rnd(F.col("b_i"), 6).alias("b_i"))


@query
def als_loss_k5(spark, d):
    fitted = _fit5(spark, d)
    return spark.createDataFrame([(fitted["losses"][-1],)], "v double").select(rnd(F.col("v"), 3).alias("loss"))


@query
def predict_rating(spark, d):
    ratings = adapters.ratings(spark, d)
    pairs = ratings.select("user_id", "item_id").distinct()
    return bias.predict(pairs, bias.fit(ratings, max_iter=5, tol=None)).select("user_id", "item_id", rnd(F.col("predicted"), 5).alias("predicted"))


# --- era standardisation, over biases of three rounds
@query
def year_stats(spark, d):
    return bias_and_era(spark, d)["stats"].select("year", rnd(F.col("mu"), 6).alias("mu"), rnd(F.col("sigma"), 6).alias("sigma"), "n")


@query
def year_stats_sparse(spark, d):
    w = adapters.works(spark, d).where("(year % 12 = 0 and ord % 40 = 0) or year = 2019").select("year", F.col("z").alias("b"))
    return era.year_stats(w).select("year", rnd(F.col("mu"), 6).alias("mu"), rnd(F.col("sigma"), 6).alias("sigma"), "n", F.coalesce("w", F.lit(-1)).cast("int").alias("w"))


@query
def era_zscore(spark, d):
    return bias_and_era(spark, d)["z"].select("work_id", rnd(F.col("z"), 5).alias("z"))


@query
def deviation_score(spark, d):
    return adapters.works(spark, d).select("work_id", deviation(F.col("z")).alias("deviation_score"))


@query
def inverse_z(spark, d):
    s = bias_and_era(spark, d)
    return era.invert(adapters.works(spark, d).select("work_id", "year", F.lit(0.5).alias("z")), s["stats"], s["overall"]).select("work_id", rnd(F.col("b"), 5).alias("b"))


@query
def staff_leaderboard_all(spark, d):
    """Ratings -> biases -> era z -> persons ranked: the whole chain of the engine."""
    z = bias_and_era(spark, d)["z"].select("work_id", rnd(F.col("z"), 6).alias("z"))
    w = adapters.works(spark, d).drop("z").join(z, "work_id", "left")
    board = staff.leaderboard(staff.records(adapters.credits(spark, d), w), limit=1000)
    return board.select("name", "works_count", "bayesian_rating", "career_cumulative_z", "rank", "total_count")


# --- credits and history
@query
def credits_long(spark, d):
    return adapters.credits(spark, d).select("work_id", "role", F.col("pos").cast("long").alias("pos"), "name", "rank", rnd(F.col("ep_ratio"), 6).alias("ep_ratio"))


@query
def work_people_distinct(spark, d):
    return history.people(adapters.credits(spark, d))


@query
def staff_records(spark, d):
    return _records(spark, d).select("name", "role", "work_id", "year", rnd(F.col("z"), 6).alias("z"), "rank", rnd(F.col("ep_ratio"), 6).alias("ep_ratio"))


@query
def history_past(spark, d):
    h = history.past(adapters.credits(spark, d), adapters.works(spark, d))
    return h.select("name", "year", F.col("n").cast("long").alias("n"), rnd(F.col("sum_z"), 6).alias("sum_z"), rnd(F.coalesce("max_z", F.lit(0.0)), 6).alias("max_z"))


@query
def genga_features(spark, d):
    f = history.genga_features(adapters.credits(spark, d), adapters.works(spark, d))
    return f.select("work_id", *[rnd(F.col(c), 6).alias(c) for c in history.GENGA_COLUMNS])


@query
def role_features(spark, d):
    f = history.role_features(adapters.credits(spark, d), adapters.works(spark, d))
    return f.select("work_id", "role", *[rnd(F.col(c), 6).alias(c) for c in history.ROLE_COLUMNS])


@query
def feature_matrix(spark, d):
    f = history.feature_matrix(adapters.credits(spark, d), adapters.works(spark, d))
    return f.select("work_id", "year", *[rnd(F.col(c), 6).alias(c) for c in history.FEATURES])


# --- persons
@query
def staff_overall_ranks(spark, d):
    r = staff.overall_ranks(staff.ratings(_records(spark, d)))
    return r.select("name", F.col("n").alias("works"), rnd(F.col("rating"), 6).alias("rating"), rnd(F.col("z_sum"), 6).alias("z_sum"), "overall_rank", "cumulative_rank", "total_staff")


@query
def staff_role_ranks(spark, d):
    r = staff.role_ranks(staff.ratings(_records(spark, d)))
    return r.select("role", "name", F.col("n").alias("works"), rnd(F.col("rating"), 6).alias("rating"), rnd(F.col("z_sum"), 6).alias("z_sum"), "rating_rank", "cumulative_rank", "role_total")


@query
def leaderboard_director(spark, d):
    return staff.leaderboard(_records(spark, d), "director", limit=100)


@query
def leaderboard_genga(spark, d):
    return staff.leaderboard(_records(spark, d), "genga", limit=100)


@query
def leaderboard_cumulative(spark, d):
    return staff.leaderboard(_records(spark, d), None, "cumulative", limit=100)


@query
def leaderboard_min_works(spark, d):
    return staff.leaderboard(_records(spark, d), "sakkan", min_works=3, limit=100)


@query
def primary_role(spark, d):
    return staff.primary_roles(_records(spark, d))


@query
def profile_stats(spark, d):
    return staff.profile_stats(_records(spark, d))


@query
def best_works_top3(spark, d):
    return staff.best_works(_records(spark, d))


@query
def trajectory(spark, d):
    return staff.trajectory(_records(spark, d)).select("name", F.array_join("career", ",").alias("career"))


@query
def profile_role_stats(spark, d):
    return staff.role_stats(_records(spark, d))


@query
def search_staff(spark, d):
    return staff.search(_records(spark, d), "00012")


@query
def staff_index(spark, d):
    return staff.index(_records(spark, d))


@query
def staff_head_counts(spark, d):
    r = _records(spark, d)
    return r.groupBy("role").agg(F.countDistinct("name").alias("persons")).unionByName(r.agg(F.countDistinct("name").alias("persons")).select(F.lit("all").alias("role"), "persons"))


def _flat(column: str, fields: list[str]):
    """An array of structs as text."""
    return F.array_join(F.transform(column, lambda e: F.concat_ws(":", *[e[f].cast("string") for f in fields])), ",").alias(column)


_ROLE_STATS = ["role", "works_count", "cumulative_z", "bayesian_rating", "rating_rank", "cumulative_rank", "role_total", "rating_tier", "cum_tier"]


@query
def staff_profile(spark, d):
    """The whole profile of one person by name."""
    p = staff.profile(_records(spark, d), "Customer#000000012")
    return p.select("name", "total_works", "bayesian_rating", "career_cumulative_z", "raw_mean_z", "peak_z", "std_z", "overall_rank", "cumulative_rank", "total_staff", "primary_role", "role_rank", "role_total", _flat("all_role_stats", _ROLE_STATS), _flat("best_works", ["work_id", "year", "role", "z_score"]), _flat("career_trajectory", ["year", "work_id", "role", "z_score"]))


@query
def board_search(spark, d):
    """A page of a board by cumulative rank, found by a part of the name; what is shown is the place in the list."""
    board = export.boards(_records(spark, d)).where("board = 'genga'")
    return staff.board_page(board, " 0001", "ck", 1, 20).select("n", "w", "r", "z", "rk", "ck", "shown")


@query
def board_browse(spark, d):
    board = export.boards(_records(spark, d)).where("board = 'all'")
    return staff.board_page(board, "", "rk", 2, 25).select("n", "w", "r", "rk", "ck", "shown")


@query
def fallback_roles(spark, d):
    return staff.fallback_roles(export.boards(_records(spark, d)))


@query
def own_pseudo_counts(spark, d):
    """A board with a pseudo-count of the caller in place of the usual one."""
    return staff.leaderboard(_records(spark, d), "director", limit=100, pseudo={"director": 5.0}).select("name", "bayesian_rating", "rank", "total_count")


@query
def unified_search(spark, d):
    """Works and persons that a query finds, the best of each."""
    w = works.search(adapters.works(spark, d), "12", 15).select(F.lit("work").alias("kind"), F.col("work_id").alias("id"), F.col("title").alias("label"), F.col("true_z").alias("score"))
    p = staff.search(_records(spark, d), "12").select(F.lit("person").alias("kind"), F.col("name").alias("id"), F.col("name").alias("label"), F.col("rating").alias("score"))
    return w.unionByName(p)


@query
def status(spark, d):
    """Counts, global mean and quality of a prediction, in one row."""
    w = adapters.works(spark, d)
    counts = w.agg(F.count("*").alias("works_count"))
    r = adapters.ratings(spark, d).agg(F.count("*").alias("ratings_count"), rnd(exact_sum("score") / F.count("*"), 2).alias("global_mean"))
    m = model.metrics(w.withColumn("predicted_z", rnd(F.col("z") * 0.8 + F.col("year") / 1000, 6)))
    return counts.join(F.broadcast(r)).join(F.broadcast(m)).withColumn("status", F.lit("ready"))  # one row each


# --- the catalogue's own works and credits
@query
def real_works(spark, d):
    return adapters.works_of(table(spark, d, "anime_metadata")).select("ord", "work_id", "title", "title_en", "year", "listed_year", "raw_score", "format", "episodes")


@query
def real_credits(spark, d):
    return adapters.credits_of(table(spark, d, "anime_metadata"))


@query
def real_z(spark, d):
    return scored_works(spark, d).where("z is not null").select("work_id", rnd(F.col("z"), 5).alias("z"))


def _real_records(spark, d):
    return staff.records(adapters.credits_of(table(spark, d, "anime_metadata"), maps=False), scored_works(spark, d))


@query
def real_staff_records(spark, d):
    return _real_records(spark, d).select("name", "role", "work_id", "year", rnd(F.col("z"), 5).alias("z"), "rank", "ep_ratio")


@query
def real_leaderboard_all(spark, d):
    return staff.leaderboard(_real_records(spark, d), limit=1000).select("name", "works_count", "rank", "total_count")


@query
def real_feature_matrix(spark, d):
    f = history.feature_matrix(adapters.credits_of(table(spark, d, "anime_metadata")), scored_works(spark, d))
    return f.select("work_id", "year", *[rnd(F.col(c), 4).alias(c) for c in history.FEATURES])


# --- tiers
@query
def work_tiers(spark, d):
    w = works.ranks(adapters.works(spark, d), "z").join(adapters.works(spark, d), "work_id")
    total = F.broadcast(adapters.works(spark, d).agg(F.count("*").alias("total")))  # one row
    dev = deviation(F.col("z"))
    return w.join(total).select("work_id", dev.alias("deviation_score"), score_tier(dev).alias("tier"), rnd(percentile(F.col("z_rank"), F.col("total")), 2).alias("percentile"))


@query
def client_tiers(spark, d):
    """What the client writes beside a score: the share at the top as text, and z back from the shown deviation."""
    w = adapters.works(spark, d).withColumn("d", deviation(F.col("z")))
    return w.select("work_id", top_text(top_percent(z_of_deviation(F.col("d")))).alias("top"), rnd(z_of_deviation(F.col("d")), 2).alias("z"))


@query
def staff_tiers(spark, d):
    r = staff.role_ranks(staff.ratings(_records(spark, d)))
    return r.select("role", "name", staff_tier(F.col("rating_rank"), F.col("role_total")).alias("rt"), staff_tier(F.col("cumulative_rank"), F.col("role_total")).alias("ct"))


@query
def rank_tiers(spark, d):
    r = staff.overall_ranks(staff.ratings(_records(spark, d)))
    return r.select("name", rank_tier(F.col("overall_rank"), F.col("total_staff")).alias("tier"))


@query
def z_tiers(spark, d):
    return adapters.works(spark, d).select("work_id", rnd(top_percent(F.col("z")), 6).alias("top_percent"), z_tier(F.col("z")).alias("tier"))


# --- works
@query
def work_ranks(spark, d):
    return works.ranks(adapters.works(spark, d).withColumn("predicted_z", F.col("z") * 0.5))


@query
def comparison_core(spark, d):
    s = bias_and_era(spark, d)
    w = adapters.works(spark, d).withColumn("predicted_z", rnd(F.col("z") * 0.5 + F.col("raw_score") / 200, 6))
    out = works.comparison(w, s["model"]["items"], s["stats"], s["model"]["mean"], s["overall"])
    return out


@query
def comparison_filter(spark, d):
    w = adapters.works(spark, d).select("ord", "title", "year", F.col("z").alias("true_z"), verdict(F.col("z") * 0.5).alias("verdict"))
    return works.filter_comparison(w, " cOLD", "expect").drop("ord")


@query
def works_by_tier(spark, d):
    w = adapters.works(spark, d).withColumn("deviation_score", deviation(F.col("z"))).withColumn("tier", score_tier(F.col("deviation_score")))
    return works.browse(w, adapters.credits(spark, d), tier="A+", era="1980s", size=40).select("work_id", "title", "year", "deviation_score", "tier")


@query
def standardise_known(spark, d):
    """z of given biases, years without statistics by the global ones."""
    s = bias_and_era(spark, d)
    rows = adapters.works(spark, d).select("work_id", F.when(F.col("ord") % 3 == 0, 1900).otherwise(F.col("year")).alias("year"), F.lit(1.5).alias("b"))
    return era.standardise_known(rows, s["stats"], s["overall"]).select("work_id", rnd(F.col("z"), 5).alias("z"))


@query
def search_works(spark, d):
    return works.search(adapters.works(spark, d), " Cold P")


@query
def browse_filter_sort_page(spark, d):
    w = adapters.works(spark, d).withColumn("deviation_score", deviation(F.col("z"))).withColumn("tier", score_tier(F.col("deviation_score")))
    return works.browse(w, adapters.credits(spark, d), query="0001", era="1990s", page=2, size=10).select("work_id", "title", "year", "deviation_score", "tier")


@query
def works_by_title_ja(spark, d):
    w = adapters.works(spark, d)
    return works.browse(w, adapters.credits(spark, d), sort="title", descending=False, size=30).select("work_id", "title")


@query
def merge_works(spark, d):
    w = adapters.works(spark, d).select("ord", "work_id", "title", "year")
    new = w.where("ord % 7 = 0").select("ord", F.when(F.col("ord") % 2 == 0, F.col("work_id")).otherwise(F.concat(F.lit("n"), "work_id")).alias("work_id"), F.concat(F.lit("New "), "title").alias("title"), "year")
    return works.merge(w, new)


@query
def append_ratings(spark, d):
    r = adapters.ratings(spark, d)
    return r.unionByName(r.where("score > 90")).groupBy("item_id").agg(F.count("*").alias("n"), rnd(F.sum("score"), 4).alias("total"))


@query
def first_wins_dedupe(spark, d):
    c = adapters.credits(spark, d).select("name", "work_ord", "role", "pos")
    return works.first_wins(c.withColumn("k", F.struct("work_ord", "role", "pos")).drop("k"), "name", ["work_ord", "role", "pos"]).select("name", "work_ord", "role")


@query
def uncollected_filter(spark, d):
    e = table(spark, d, "anilist_client").select("anilist_id").distinct().withColumn("ord", F.col("anilist_id"))
    return works.uncollected(e, table(spark, d, "anime_metadata").select("anilist_id", "bangumi_id"), 50).select("anilist_id")


@query
def person_works(spark, d):
    """Works of each person with their roles."""
    c = adapters.credits(spark, d)
    return c.groupBy("name", "work_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("role"))).alias("roles"))


# --- model
def _trained(spark, d):
    m = history.feature_matrix(adapters.credits(spark, d), adapters.works(spark, d)).cache()
    return m, model.fit(m)


@query
def gbdt_predictions(spark, d):
    m, fitted = _trained(spark, d)
    return model.predict(m, fitted).select("work_id", "z", "predicted_z")


@query
def converged_predictions(spark, d):
    """The whole chain over converged biases: ratings -> biases -> era z -> features -> model of 100 trees."""
    s = snapshot.fit(adapters.ratings(spark, d), adapters.works(spark, d), adapters.credits(spark, d))
    return model.predict(s.matrix, s.model).select("work_id", "z", "predicted_z")


@query
def regression_metrics(spark, d):
    w = adapters.works(spark, d).withColumn("predicted_z", rnd(F.col("z") * 0.8 + F.col("year") / 1000, 6))
    return model.metrics(w)


@query
def shap_top_factors(spark, d):
    m, fitted = _trained(spark, d)
    return model.top_factors(model.attribute(m, fitted))


@query
def shap_shown(spark, d):
    m, fitted = _trained(spark, d)
    return model.labelled(model.shown_factors(model.attribute(m, fitted)))


@query
def shap_adds_up(spark, d):
    """Works whose attributions and base don't add up to the prediction: none."""
    m, fitted = _trained(spark, d)
    told = model.attribute(m, fitted).groupBy("work_id").agg((F.sum("shap") + F.first("base_value")).alias("told"))
    return model.predict(m, fitted).join(told, "work_id").where(F.abs(F.col("told") - F.col("predicted_z")) > 1e-6).select("work_id")


@query
def fallback_attribution(spark, d):
    """Attribution by the weights of features alone."""
    weights = spark.createDataFrame([(f, float(k % 5)) for k, f in enumerate(history.FEATURES)], "feature string, importance double")
    return model.fallback_attribution(adapters.works(spark, d).select("work_id", F.col("z").alias("predicted_z")), weights, 0.25).select("work_id", "feature", rnd(F.col("shap"), 7).alias("shap"))


@query
def feature_importances(spark, d):
    m, fitted = _trained(spark, d)
    return model.labelled(model.importances(fitted, spark))


@query
def work_detail(spark, d):
    """One work in whole: scores, ranks, prediction with its factors, and staff."""
    w, c = adapters.works(spark, d), adapters.credits(spark, d)
    m, fitted = _trained(spark, d)
    s = bias_and_era(spark, d)
    predicted = model.predict(m, fitted).select("work_id", "predicted_z")
    listed = works.comparison(w.join(predicted, "work_id", "left"), s["model"]["items"], s["stats"], s["model"]["mean"], s["overall"]).where("work_id = '12'")
    factors = model.top_factors(model.attribute(m.where("work_id = '12'"), fitted))
    sides = factors.groupBy("work_id").pivot("side", ["positive", "negative"]).agg(F.array_sort(F.collect_list(F.struct("place", "feature", "value", "shap"))))
    team = c.where("work_id = '12'").groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("role", "pos", "name"))).alias("staff"))
    return listed.join(sides, "work_id", "left").join(team, "work_id", "left")


@query
def predict_custom(spark, d):
    """A planned work: its features from the staff's earlier works, its prediction and score."""
    c, w = adapters.credits(spark, d), adapters.works(spark, d)
    m, fitted = _trained(spark, d)
    s = bias_and_era(spark, d)
    team = c.groupBy("role").agg(F.min("name").alias("name")).select("role", F.lit(1).alias("pos"), "name", F.lit(1.0).alias("ep_ratio"))
    row = history.features_of(team, 2015, c, w).withColumn("work_id", F.lit("custom")).withColumn("year", F.lit(2015))
    out = era.invert(model.predict(row, fitted), s["stats"], s["overall"], "predicted_z")
    return out.select("work_id", "year", rnd(F.col("predicted_z"), 3).alias("predicted_z"), rnd(F.greatest(F.lit(10.0), F.least(F.lit(100.0), F.col("b") + s["model"]["mean"])), 1).alias("predicted_score"))


@query
def custom_features(spark, d):
    c, w = adapters.credits(spark, d), adapters.works(spark, d)
    team = c.groupBy("role").agg(F.min("name").alias("name")).select("role", F.lit(1).alias("pos"), "name", F.lit(0.5).alias("ep_ratio"))
    return history.features_of(team, 2000, c, w).select(*[rnd(F.col(f), 6).alias(f) for f in history.FEATURES])


# --- texts and pages
@query
def page_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.trim("line").alias("line")).where("line <> ''")


def _pages(spark, d):
    """Wiki pages made of the catalogue's documents: main staff first, then each episode under its header."""
    meta = table(spark, d, "anime_metadata").select("work_id", "title", "year", "staff").distinct()
    c = nested.flatten_credits(meta)
    head = F.element_at(F.create_map(*[F.lit(x) for pair in wiki.PAGE_HEADERS.items() for x in pair]), F.col("role"))
    lines = c.where(head.isNotNull()).groupBy("work_id", "ep_pos", "ep_num", head.alias("head")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda e: e["name"]), "、").alias("names"))
    blocks = lines.groupBy("work_id", "ep_pos", "ep_num").agg(F.array_join(F.array_sort(F.collect_list(F.concat("head", F.lit("："), "names"))), "<br>").alias("body"))
    block = F.concat(F.when(F.col("ep_pos") > 0, F.concat(F.lit("第"), F.col("ep_num").cast("string"), F.lit("話「」<br>"))).otherwise(""), "body")
    area = blocks.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ep_pos", block.alias("b")))), lambda e: e["b"]), "<br>").alias("area"))
    html = F.concat(F.lit("<title>"), F.coalesce("title", F.lit("")), F.lit('</title><div class="user-area">'), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("年 全12話<br>"), "area", F.lit("</div>"))
    return meta.join(area, "work_id").select(F.regexp_extract("work_id", r"(\d+)$", 1).cast("long").alias("page_id"), html.alias("html"))


@query
def episode_credits(spark, d):
    return wiki.credits(_pages(spark, d))


@query
def clean_names(spark, d):
    """The names of boards that pass as names of persons."""
    names = table(spark, d, "leaderboards").select(F.trim("n").alias("name")).where("name <> ''").distinct()
    return names.where(wiki.is_clean_name(F.col("name")))


@query
def split_names(spark, d):
    """Names in the titles of pages, as the scanner splits a value."""
    t = table(spark, d, "seesaa_client").select("page_id", "title").where("title is not null").distinct()
    return t.select("page_id", F.posexplode(wiki.split_value(F.col("title"))).alias("pos", "name"))


def _entries(spark, d):
    e = table(spark, d, "anilist_client").select("anilist_id", "year", "popularity", "mean_score", "average_score", "format", "episodes").distinct()
    return e.withColumn("start_date", F.when(F.col("year") > 0, F.col("year") * 10_000 + 701))


@query
def era_catalogue(spark, d):
    return store.era_catalogue(_entries(spark, d))


@query
def popular_entries(spark, d):
    return store.popular_entries(_entries(spark, d), 100).select("place", "anilist_id", "year")


@query
def title_aliases(spark, d):
    """Titles of works with all other names of the catalogue's entries that bear them."""
    t = table(spark, d, "anime_metadata").where("title is not null").select(F.col("work_id").alias("q_id"), F.col("title").alias("query")).distinct()
    e = table(spark, d, "anilist_client").where("title_native is not null").select(F.col("title_native").alias("canonical"), F.explode("synonyms").alias("alias")).where("trim(alias) <> ''").distinct()
    return matching.with_aliases(t, e)


@query
def united_names(spark, d):
    """Key animators of a work and of its episodes in one list, each where it comes first, two letters at least."""
    c = nested.flatten_credits(table(spark, d, "anime_metadata")).where("role = 'genga'").select("work_id", "ep_pos", "pos", "name").distinct()
    lists = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ep_pos", "pos", "name")))), lambda e: e["name"])
    both = c.groupBy("work_id").agg(lists(F.col("ep_pos") == 0).alias("own"), lists(F.col("ep_pos") > 0).alias("eps"))
    return both.select("work_id", F.array_join(wiki.union_names("own", "eps"), "|").alias("names"))


@query
def animator_participation(spark, d):
    c = adapters.credits(spark, d).where("role = 'genga'")
    rows = c.select(F.col("work_ord").alias("page_id"), F.lit(12).alias("total_episodes"), F.col("rank").cast("int").alias("ep_num"), "pos", "name")
    return wiki.participation(rows)


def _titles(spark, d):
    t = table(spark, d, "anime_metadata").select("title").unionByName(table(spark, d, "anilist_client").select(F.col("title_native").alias("title")))
    return t.where("title is not null").distinct()


@query
def text_forms(spark, d):
    t = F.col("title")
    return _titles(spark, d).select("title", text.client_form(t).alias("client"), text.candidate_form(t).alias("candidate"), F.array_join(text.subtitles(t), " ").alias("subtitles"))


#: Titles that compatibility composition leaves as they are.
PLAIN_TITLE = "^[\\x20-\\x7e\\x{3001}-\\x{3015}\\x{3041}-\\x{3094}\\x{30a1}-\\x{30fe}\\x{4e00}-\\x{9fff}]*$"


@query
def search_forms(spark, d):
    """Search and title forms of the titles whose composition SQL can follow; the others are tested apart."""
    t = F.col("title")
    return _titles(spark, d).where(t.rlike(PLAIN_TITLE)).select("title", text.search_form(t).alias("search"), text.title_form(t).alias("form"))


@query
def title_match_best(spark, d):
    q = table(spark, d, "seesaa_client").where("title is not null").select(F.col("page_id").alias("q_id"), F.col("title").alias("query")).distinct()
    t = table(spark, d, "anilist_client").where("title_native is not null").select(F.col("anilist_id").alias("t_id"), F.col("title_native").alias("title")).distinct()
    return matching.best_titles(q, t)


@query
def candidate_scoring(spark, d):
    """The best entry of the catalogue for each work among those that a search by its title finds."""
    q = table(spark, d, "anime_metadata").where("title is not null").select(F.col("work_id").alias("q_id"), "title", "year", "episodes", "format").distinct()
    c = table(spark, d, "anilist_client").where("title_native is not null").select(
        F.col("anilist_id").alias("c_ord"), F.col("anilist_id").alias("c_id"), F.col("title_native").alias("c_name"), F.coalesce("title_english", F.lit("")).alias("c_name_cn"),
        F.when(F.col("year") > 0, F.concat(F.col("year").cast("string"), F.lit("-04-01"))).alias("c_date"), F.col("episodes").alias("c_eps"),
    ).distinct()
    return matching.score_candidates(matching.search_candidates(q, c))


@query
def relation_roles(spark, d):
    names = list(matching.RELATION_ROLES)
    c = adapters.credits(spark, d)
    rel = F.element_at(F.array(*map(F.lit, [*names, "其他"])), ((F.col("rank").cast("int") + F.col("work_ord") + F.col("pos")) % (len(names) + 1) + 1).cast("int"))
    rows = c.select(F.col("work_ord").alias("subject_id"), (F.col("pos") * 10 + F.length("role")).alias("o"), "name", rel.alias("relation"), "role")
    rows = rows.withColumn("ord", F.col("o") * 100 + F.ascii("role") % 100).drop("o", "role")
    first = rows.groupBy("subject_id", "name", "ord").agg(F.min("relation").alias("relation"))
    return matching.relation_roles(first).select("subject_id", "role", "name", "ep_ratio")


# --- exports
@query
def export_leaderboards(spark, d):
    return export.boards(_records(spark, d))


@query
def export_works(spark, d):
    out = export.works(_records(spark, d), adapters.works(spark, d), adapters.credits(spark, d))
    listed = [c for c, t in out.dtypes if t.startswith("array")]
    return out.select(*[c for c in out.columns if c not in listed], *[F.coalesce(F.array_join(F.transform(c, lambda e: F.concat_ws("|", e["name"], e["rt"], e["ct"])), ","), F.lit("")).alias(c) for c in listed])


@query
def export_profiles(spark, d):
    p = export.profiles(_records(spark, d))
    return p.select("name", "total_works", "bayesian_rating", "career_cumulative_z", "overall_rank", "cumulative_rank", "primary_role", "overall_rating_tier", "overall_cum_tier", _flat("all_role_stats", _ROLE_STATS), _flat("best_works", ["work_id", "year", "role", "z_score"]), _flat("career_trajectory", ["year", "work_id", "role", "z_score"]))


@query
def export_summary(spark, d):
    return export.summary(adapters.works(spark, d), _records(spark, d))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
