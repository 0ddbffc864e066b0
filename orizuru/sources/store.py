"""Readers and writers of works and ratings: JSON of works by id, CSV of ratings, cached remote documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RATINGS_SCHEMA = "user_id BIGINT, item_id STRING, score DOUBLE"


def read_works_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object keyed by work id -> ord, work_id, title, title_en, year, raw_score, format, episodes, anilist_id,
    bangumi_id, source_url, staff (JSON text). A file that isn't such an object raises; missing fields are null."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,variant>", {"mode": "FAILFAST"}).alias("m"))
    rows = doc.select(F.posexplode("m").alias("ord", "work_id", "v"))
    get = lambda field, kind: F.expr(f"try_variant_get(v, '$.{field}', '{kind}')")
    return rows.select(
        F.col("ord").cast("long"), "work_id", get("title", "string").alias("title"), get("title_en", "string").alias("title_en"),
        get("year", "int").alias("year"), get("anilist_mean_score", "double").alias("raw_score"), get("format", "string").alias("format"),
        get("episodes", "int").alias("episodes"), get("anilist_id", "bigint").alias("anilist_id"), get("bangumi_id", "bigint").alias("bangumi_id"),
        get("source_url", "string").alias("source_url"), F.expr("to_json(try_variant_get(v, '$.staff', 'variant'))").alias("staff"),
    )


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=RATINGS_SCHEMA, mode="FAILFAST")


def write_works(works: DataFrame, path: str) -> None:
    works.write.mode("overwrite").json(path)


def write_ratings(ratings: DataFrame, path: str) -> None:
    ratings.write.mode("overwrite").csv(path, header=True)


def upsert(works: DataFrame, ratings: DataFrame, work: DataFrame, new_ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One or more works put in place of those with their id, or appended; their ratings added, not deduplicated."""
    from orizuru.operators.works import merge

    return merge(works, work), ratings.unionByName(new_ratings)


def media_to_entries(documents: DataFrame, column: str = "json") -> DataFrame:
    """Cached catalogue responses (one media object as JSON text each) -> flat entries."""
    schema = "id BIGINT, title STRUCT<romaji: STRING, english: STRING, native: STRING>, synonyms ARRAY<STRING>, seasonYear INT, startDate STRUCT<year: INT>, format STRING, episodes INT, meanScore DOUBLE, averageScore DOUBLE, popularity BIGINT, studios STRUCT<nodes: ARRAY<STRUCT<name: STRING>>>"
    m = documents.select(F.from_json(column, schema).alias("m")).where("m.id is not null")
    return m.select(
        F.col("m.id").alias("anilist_id"), F.col("m.title.romaji").alias("title_romaji"), F.col("m.title.english").alias("title_english"), F.col("m.title.native").alias("title_native"),
        F.col("m.synonyms").alias("synonyms"), F.coalesce("m.seasonYear", "m.startDate.year", F.lit(0)).alias("year"), F.col("m.format").alias("format"), F.col("m.episodes").alias("episodes"),
        F.col("m.meanScore").alias("mean_score"), F.col("m.averageScore").alias("average_score"), F.col("m.popularity").alias("popularity"), F.transform("m.studios.nodes", lambda n: n["name"]).alias("studios"),
    )


def user_scores(documents: DataFrame, column: str = "json") -> DataFrame:
    """Cached list responses -> (user_id, item_id, score) of all positive scores."""
    schema = "mediaList ARRAY<STRUCT<userId: BIGINT, mediaId: BIGINT, score: DOUBLE>>"
    rows = documents.select(F.explode(F.from_json(column, schema)["mediaList"]).alias("e")).where("e.score > 0")
    return rows.select(F.col("e.userId").alias("user_id"), F.col("e.mediaId").cast("string").alias("item_id"), F.col("e.score").alias("score"))


def synthetic_ratings(spark: SparkSession, works: DataFrame, users: int = 100, density: float = 0.65, seed: int = 42) -> DataFrame:
    """Ratings drawn around the raw scores of works: user bias N(0, 4), noise N(0, 2.5), one decimal, 10 to 100.
    Every draw is a function of seed, user and work, so partitions draw the same numbers wherever they run."""
    user = spark.range(1, users + 1).withColumnRenamed("id", "user_id")
    unit = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda tag, *c: F.sqrt(-2 * F.log(unit(F.lit(tag), *c))) * F.cos(2 * 3.141592653589793 * unit(F.lit(tag + 1), *c))
    pairs = works.select("work_id", "raw_score").join(F.broadcast(user), unit(F.lit(9), "work_id", "user_id") < density)  # `users` rows
    score = F.col("raw_score") + 4 * normal(1, "user_id") + 2.5 * normal(3, "work_id", "user_id")
    return pairs.select("user_id", F.col("work_id").alias("item_id"), F.greatest(F.lit(10.0), F.least(F.lit(100.0), F.round(score, 1))).alias("score"))


def read_page_cache(spark: SparkSession, path: str, encoding: str = "EUC-JP") -> DataFrame:
    """Cached wiki pages as (url_key, html), decoded from their encoding."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("url_key"), F.decode("content", encoding).alias("html"))


def cache_key(url):
    """Name of a cached document."""
    return F.md5(F.encode(url, "UTF-8"))


def catalogue_pages(pages: DataFrame) -> DataFrame:
    """Paged listing (page_ord, entries array of structs with id) -> entries, the first of each id in page order."""
    rows = pages.select("page_ord", F.posexplode("entries").alias("pos", "e")).select("page_ord", "pos", "e.*")
    columns = [c for c in rows.columns if c not in ("page_ord", "pos")]
    return rows.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("page_ord", "pos")).alias("r"), F.min(F.struct("page_ord", "pos")).alias("o")).select("r.*", F.col("o.page_ord").alias("page_ord"), F.col("o.pos").alias("pos"))


def links(pages: DataFrame, prefix: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """Anchors of cached listing pages below `prefix`: (url, title), the first title of each url."""
    found = F.regexp_extract_all("html", F.lit(r'<a[^>]+href="([^"]+)"[^>]*>([^<]+)</a>'), F.lit(0))
    rows = pages.select("page_ord", F.posexplode(found).alias("pos", "a"))
    rows = rows.select("page_ord", "pos", F.regexp_extract("a", r'href="([^"]+)"', 1).alias("url"), F.trim(F.regexp_extract("a", r">([^<]+)<", 1)).alias("title"))
    rows = rows.where(F.col("url").startswith(prefix) & (F.col("title") != "") & ~F.col("title").isin(*stop, ""))
    return rows.groupBy("url").agg(F.min_by("title", F.struct("page_ord", "pos")).alias("title"))


#: Eras of the catalogue (first and last start date, pages of each), pages of all times, and defaults.
ERAS = ((19500101, 19691231, 3), (19700101, 19791231, 4), (19800101, 19891231, 6), (19900101, 19991231, 6), (20000101, 20091231, 6), (20100101, 20191231, 8), (20200101, 20261231, 8))
POPULAR_PAGES, PER_PAGE = 5, 50
ERA_YEAR, POPULAR_YEAR, NO_SCORE, NO_FORMAT, NO_EPISODES = 2000, 2020, 75.0, "TV", 12


def era_catalogue(entries: DataFrame) -> DataFrame:
    """The most popular entries of each era, page by page, then those of all times; each entry once, where it comes
    first. entries (anilist_id, year, start_date, popularity, mean_score, average_score, format, episodes, ...) ->
    place, anilist_id, year and scores with their defaults. Entries without a date are found among those of all times."""
    known = entries.where("anilist_id is not null").withColumn("popularity", F.coalesce("popularity", F.lit(-1)))
    era = F.when(F.lit(False), -1)
    for k, (first, last, _) in enumerate(ERAS):
        era = era.when((F.col("start_date") > first) & (F.col("start_date") < last), k)
    pages = F.element_at(F.array(*[F.lit(p * PER_PAGE) for *_, p in ERAS]), F.col("era") + 1)
    order = W.partitionBy("era").orderBy(F.col("popularity").desc(), "anilist_id")
    most = max(p for *_, p in ERAS) * PER_PAGE
    of_era = known.withColumn("era", era).where("era is not null").withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).where(F.col("at") <= pages)
    top = known.orderBy(F.col("popularity").desc(), "anilist_id").limit(POPULAR_PAGES * PER_PAGE)
    all_times = top.withColumn("era", F.lit(len(ERAS))).withColumn("at", F.row_number().over(W.orderBy(F.col("popularity").desc(), "anilist_id")))  # over the limit's rows
    rows = of_era.unionByName(all_times)
    fallback = F.when(F.col("era") < len(ERAS), ERA_YEAR).otherwise(POPULAR_YEAR)
    made = rows.select(
        (F.col("era") * 100_000 + F.col("at")).alias("place"), "anilist_id", F.coalesce(F.nullif(F.col("year"), F.lit(0)), fallback).alias("year"), F.coalesce("format", F.lit(NO_FORMAT)).alias("format"),
        F.coalesce("episodes", F.lit(NO_EPISODES)).alias("episodes"), F.coalesce("mean_score", "average_score", F.lit(NO_SCORE)).alias("mean_score"), F.coalesce("average_score", F.lit(NO_SCORE)).alias("average_score"),
    )
    return made.groupBy("anilist_id").agg(F.min_by(F.struct(*[c for c in made.columns if c != "anilist_id"]), "place").alias("r")).select("r.place", "anilist_id", *[f"r.{c}" for c in made.columns[2:]])


def popular_entries(entries: DataFrame, n: int = 150) -> DataFrame:
    """The first n of `era_catalogue`."""
    return era_catalogue(entries).orderBy("place").limit(n)


def fresh_results(cached: DataFrame) -> DataFrame:
    """Cached search results (year: asked for, date: of what was found) without those three years off or more; where
    either is unknown the result stays."""
    found = F.when(F.col("date").rlike("^[0-9]{4}"), F.substring("date", 1, 4).cast("int"))
    return cached.where(F.coalesce((F.coalesce("year", F.lit(0)) == 0) | (F.abs(found - F.col("year")) < 3), F.lit(True)))


def persons_of(documents: DataFrame, column: str = "json") -> DataFrame:
    """Cached lists of persons (subject_id, JSON text) -> (subject_id, ord, name, relation), blank ones left out."""
    rows = documents.select("subject_id", F.posexplode(F.from_json(column, "array<struct<name:string,relation:string>>")).alias("ord", "p"))
    return rows.select("subject_id", "ord", F.trim("p.name").alias("name"), F.trim("p.relation").alias("relation")).where("name <> '' and relation <> ''")


def ingest(candidates: DataFrame, fetch: Callable[[dict], dict | None], schema: str, tasks: int = 10) -> DataFrame:
    """What `fetch` brings for each candidate (ord, ...), in `tasks` tasks at a time; a candidate that brings nothing or
    fails is left out. The rows keep the candidates' `ord`, whichever task is done first; a task that is run again
    fetches again, so `fetch` should read from its cache."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    found = fetch(row)
                except Exception:
                    found = None
                if found:
                    rows.append({"ord": row["ord"]} | found)
            if rows:
                yield pd.DataFrame(rows)

    return candidates.repartition(tasks, "ord").mapInPandas(run, schema)
