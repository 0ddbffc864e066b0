"""Micro goldens, properties and edge cases of the core operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orizuru.functions import expressions as X
from orizuru.functions import text
from orizuru.operators import bias, era, export, history, matching, model, nested, staff, works
from orizuru.sources import store, wiki

RATINGS = [(1, "A", 80.0), (1, "B", 60.0), (2, "A", 90.0), (2, "C", 70.0), (3, "B", 50.0), (3, "C", 75.0), (3, "D", 95.0)]
YEARS = {"A": 2000, "B": 2001, "C": 2003, "D": 2030, "E": 2002}
CREDITS = [
    ("A", "director", ["P"]), ("A", "sakkan", ["P", "Q"]), ("A", "genga", [("Q", 0.5), ("R", 1.0)]), ("B", "director", ["P"]), ("B", "genga", [("R", 1.0), ("P", 0.25)]),
    ("C", "director", ["P", "Q"]), ("C", "genga", [("Q", 0.5), ("R", 1.0), ("T", 0.0)]), ("D", "director", ["R"]), ("D", "sakkan", ["Q"]), ("D", "genga", [("T", 1.0)]),
]


@pytest.fixture(scope="module")
def tables(spark):
    ratings = spark.createDataFrame(RATINGS, "user_id bigint, item_id string, score double")
    fitted = bias.fit(ratings, 40, 1e-5)
    catalogue = spark.createDataFrame([(i, w, w, "", y, 0.0) for i, (w, y) in enumerate(YEARS.items())], "ord bigint, work_id string, title string, title_en string, year int, raw_score double")
    dated = fitted["items"].join(catalogue, F.col("item_id") == F.col("work_id")).select("work_id", "year", F.col("b_i").alias("b"))
    stats = era.year_stats(dated).cache()
    z = era.standardise(dated, stats).select("work_id", "z")
    scored = catalogue.join(z, "work_id", "left").cache()
    rows = []
    for w, role, names in CREDITS:
        for p, n in enumerate(names, 1):
            name, ep = n if isinstance(n, tuple) else (n, 1.0)
            rows.append((list(YEARS).index(w), w, role, p, name, float(p), ep))
    credits = spark.createDataFrame(rows, "work_ord bigint, work_id string, role string, pos int, name string, rank double, ep_ratio double")
    return fitted, stats, scored, credits


def test_bias_golden(tables):
    fitted = tables[0]
    assert len(fitted["losses"]) == 4
    assert fitted["losses"][-1] == pytest.approx(1306.420602464143)
    assert fitted["losses"] == sorted(fitted["losses"], reverse=True)
    assert {r.user_id: r.b_u for r in fitted["users"].collect()} == pytest.approx({1: -0.598409478361494, 2: 0.835157033269736, 3: -0.09485217313220408})
    assert {r.item_id: r.b_i for r in fitted["items"].collect()} == pytest.approx({"A": 1.7659853228052647, "B": -3.156513909994574, "C": -0.3593111192971763, "D": 1.8917398079470829})


def test_bias_edges(spark):
    with pytest.raises(ValueError):
        bias.fit(spark.createDataFrame([], "user_id bigint, item_id string, score double"))
    one = bias.fit(spark.createDataFrame([(1, "A", 5.0), (1, "A", 5.0), (2, "A", None), (2, "A", float("nan"))], "user_id bigint, item_id string, score double"), 2)
    assert one["mean"] == 5.0 and one["n"] == 2


def test_bias_with_a_hot_user(spark):
    rng = np.random.default_rng(2)
    rows = [(0, f"i{k}", float(rng.integers(10, 100))) for k in range(300)] + [(1 + k % 60, f"i{k % 37}", float(rng.integers(10, 100))) for k in range(500)]
    got = bias.fit(spark.createDataFrame(rows, "user_id bigint, item_id string, score double"), 3, None)
    mean = np.mean([s for *_, s in rows])
    u, i = {}, {}
    for _ in range(3):
        for mine, other, k, o in ((u, i, 0, 1), (i, u, 1, 0)):
            sums = {}
            for r in rows:
                sums.setdefault(r[k], []).append(r[2] - mean - other.get(r[o], 0.0))
            mine.update({key: sum(v) / (len(v) + 10.0) for key, v in sums.items()})
    assert {r.user_id: r.b_u for r in got["users"].collect()} == pytest.approx(u) and {r.item_id: r.b_i for r in got["items"].collect()} == pytest.approx(i)


def test_era_golden(tables):
    stats = {r.year: (r.mu, r.sigma, r.n) for r in tables[1].collect()}
    for y in (2000, 2001, 2003):
        assert stats[y] == pytest.approx((-0.5832799021621619, 2.0158325304122306, 3))
    assert stats[2030][2] == 1 and stats[2030][1] == pytest.approx(2.048478135342037)
    z = {r.work_id: r.z for r in tables[2].where("z is not null").collect()}
    assert z == pytest.approx({"A": 1.1654069420573394, "B": -1.2765117979846246, "C": 0.11110485592728515, "D": 0.9061677303536319})
    dev = {r.work_id: r.d for r in tables[2].where("z is not null").select("work_id", X.deviation(F.col("z")).alias("d")).collect()}
    assert dev == {"A": 61.7, "B": 37.2, "C": 51.1, "D": 59.1}


def test_history_golden(tables):
    _, _, scored, credits = tables
    m = {r.work_id: r.asDict() for r in history.feature_matrix(credits, scored).collect()}
    assert set(m) == set("ABCD")
    assert m["B"]["genga_weighted_s"] == pytest.approx(0.166487, abs=1e-6) and m["B"]["genga_experienced_ratio"] == 1
    assert m["C"]["genga_weighted_s"] == pytest.approx(0.045931, abs=1e-6) and m["C"]["genga_sum_weights"] == pytest.approx(1.51)
    assert m["C"]["director_bayesian_s"] == pytest.approx(0.21086, abs=1e-5) and m["C"]["director_past_count"] == 3
    assert m["D"]["sakkan_bayesian_s"] == pytest.approx(0.212752, abs=1e-6) and m["A"]["director_past_count"] == 0


def test_history_never_looks_ahead(tables):
    _, _, scored, credits = tables
    changed = scored.withColumn("z", F.when(F.col("year") >= 2003, F.col("z") + 5).otherwise(F.col("z")))
    before = {r.work_id: r.genga_weighted_s for r in history.feature_matrix(credits, scored).where("year <= 2003").collect()}
    after = {r.work_id: r.genga_weighted_s for r in history.feature_matrix(credits, changed).where("year <= 2003").collect()}
    assert before == pytest.approx(after)


def test_leaderboards_golden(tables):
    rows = staff.records(tables[3], tables[2])
    board = [(r["rank"], r["name"], r.works_count, r.bayesian_rating) for r in staff.leaderboard(rows).orderBy("rank").collect()]
    assert board == [(1, "Q", 5, 0.314), (2, "T", 2, 0.127), (3, "R", 4, 0.091), (4, "P", 5, -0.01)]
    genga = [(r["name"], r.works_count, r.bayesian_rating, r.best_work_title) for r in staff.leaderboard(rows, "genga").orderBy("rank").collect()]
    assert genga == [("Q", 2, 0.16, "A"), ("T", 2, 0.127, "D"), ("R", 3, 0.0, "A"), ("P", 1, -0.182, "B")]
    assert staff.leaderboard(rows, "studio").count() == 0
    ranks = [r.overall_rank for r in staff.overall_ranks(staff.ratings(rows)).collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_custom_features_match_matrix(tables, spark):
    _, _, scored, credits = tables
    row = history.features_of(credits.where("work_id = 'C'"), 2003, credits, scored, "C").first().asDict()
    whole = history.feature_matrix(credits, scored).where("work_id = 'C'").first().asDict()
    assert {k: row[k] for k in history.FEATURES} == pytest.approx({k: whole[k] for k in history.FEATURES})


def test_scalar_goldens(spark):
    f = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert f(text.search_form(F.lit("ヱヴァンゲリヲン新劇場版：序"))) == "エブァンゲリオン新劇場版序"
    assert f(text.title_form(F.lit("ぼっち・ざ・ろっく！（2022年）"))) == "ぼっちざろっく" and f(text.title_form(F.lit("キルラキル"))) == "きるらきる"
    assert f(text.search_form(F.lit(None).cast("string"))) == "" and f(text.client_form(F.lit("ＡＢＣ・ゑ"))) == "abcえ"
    assert [f(X.score_tier(F.lit(v))) for v in (70.0, 65.0, 60.0, 55.0, 50.0, 45.0, 40.0, 39.9)] == ["S+", "S", "A+", "A", "B+", "B", "C", "D"]
    assert [f(X.staff_tier(F.lit(a), F.lit(b))) for a, b in ((23, 1000), (24, 1000), (0, 10), (1, 0), (851, 1000))] == ["S+", "S", "-", "-", "D"]
    for z, want in ((-1.5, 93.319133), (0.0, 50.0), (0.5, 30.855155), (1.0, 15.869736), (2.5, 0.61567), (4.0, 0.01)):
        assert f(X.top_percent(F.lit(z))) == pytest.approx(want, abs=1e-5)
    assert [f(X.z_tier(F.lit(z))) for z in (0.0, 0.5, 1.0, 1.5, 2.5, -1.5)] == ["B", "B", "A", "A+", "S+", "D"]
    assert f(text.year_of_date(F.lit("2013-04-06"))) == 2013 and f(text.year_of_date(F.lit("n/a"))) is None


def test_white_space_of_all_kinds(spark):
    f = lambda c: spark.range(1).select(c.alias("v")).first().v
    for s in ("　", " ", " ", "\x1c", "\x85", " ", "\t"):
        t = f"進撃{s}の巨人{s}"
        assert f(text.client_form(F.lit(t))) == f(text.title_form(F.lit(t))) == "進撃の巨人" and f(text.candidate_form(F.lit(t))) == "進撃 の巨人"
        assert text.client_form_of(t) == "進撃の巨人"
    for t in ("ＡＢＣ・ゑ ｱ", "ヱヴァンゲリヲン：序", "", "ゔ〜Ⅳ"):
        assert text.client_form_of(t) == f(text.client_form(F.lit(t))) and text.search_form_of(t) == f(text.search_form(F.lit(t)))
    assert f(X.rnd(F.lit(0.4999995), 0)) == 0.0 and f(X.rnd(F.lit(0.5), 0)) == 1.0


def test_places_of_hot_groups_and_ties(spark):
    from orizuru.operators.ranking import first_placed, placed

    rows = [("hot" if i % 3 else f"g{i % 7}", float(i % 2), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(9)
    got = {r.i: (r.k, r.n) for r in placed(df, [F.col("v").desc(), "i"], "k", ["g"], "n").collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in mine] == [(k, len(mine)) for k in range(1, len(mine) + 1)]
    whole = {r.i: r.k for r in placed(df, [F.col("v").desc(), "i"], "k").collect()}
    assert [i for i, _ in sorted(whole.items(), key=lambda x: x[1])] == [r[2] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]
    assert placed(df.limit(0), ["i"], "k", total="n").count() == 0
    assert [(r.i, r.k) for r in first_placed(df, ["i"], "k", 3).orderBy("k").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_plans_hold_at_scale(spark, tables):
    _, _, scored, credits = tables
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = staff.records(credits, scored)
    for df in (staff.overall_ranks(staff.ratings(rows)), staff.role_ranks(staff.ratings(rows)), works.ranks(scored.withColumn("predicted_z", F.col("z"))), export.boards(rows)):
        assert "row_number" not in plan(df)  # no window over persons or works
    assert plan(era.year_stats(scored.select("year", F.col("z").alias("b")))).count("NestedLoopJoin") <= 1  # the one row of all items


def test_profiles_boards_and_fallbacks(spark, tables):
    _, _, scored, credits = tables
    rows = staff.records(credits, scored)
    p = staff.profile(rows, "Q").first()
    assert p.total_works == 5 and p.primary_role == "sakkan" and [w.work_id for w in p.best_works] == ["A", "A", "D"] and len(p.career_trajectory) == 5
    assert staff.profile(rows, "nobody").count() == 0
    board = export.boards(rows)
    assert [(r.n, r.shown) for r in staff.board_page(board.where("board = 'all'"), "", "rk", 2, 2).orderBy("shown").collect()] == [("R", 3), ("P", 4)]
    assert [(r.n, r.rk, r.shown) for r in staff.board_page(board.where("board = 'all'"), " r ", "ck").collect()] == [("R", 3, 1)]
    assert {r.n: r.primary_role for r in staff.fallback_roles(board).collect()}["T"] == "genga"
    lower = staff.leaderboard(rows, "director", pseudo={"director": 0.0}).where("name = 'R'").first()
    assert lower.bayesian_rating == pytest.approx(0.906)


def test_features_kept_and_completed(spark, tables):
    _, _, scored, credits = tables
    whole = history.feature_matrix(credits, scored)
    known = whole.where("work_id in ('A', 'B')").withColumn("genga_max_s", F.lit(9.0))
    got = {r.work_id: r for r in history.complete_matrix(known, credits, scored).collect()}
    want = {r.work_id: r for r in whole.collect()}
    assert got["A"].genga_max_s == 9.0 and got["C"].director_bayesian_s == pytest.approx(want["C"].director_bayesian_s) and set(got) == set("ABCD")


def test_export_writes_documents(spark, tables, tmp_path):
    _, _, scored, credits = tables
    export.write_all(staff.records(credits, scored), scored, credits, str(tmp_path))
    boards = spark.read.json(str(tmp_path / "leaderboards"))
    assert {"n", "w", "r", "z", "rk", "ck", "rt", "ct", "bt", "by", "bz", "board"} == set(boards.columns)
    assert {r.work_id for r in spark.read.json(str(tmp_path / "works")).collect()} == set("ABCD")
    assert spark.read.json(str(tmp_path / "profiles")).where("name = 'Q'").first().all_role_stats[0].role == "sakkan"
    assert spark.read.json(str(tmp_path / "summary")).first().total_works == 4


def test_documents_become_works_and_credits(spark):
    from orizuru.sources import adapters

    doc = json.dumps({"director": [" A ", {"name": "B"}], "genga": [{"name": "C", "rank": 3}, "", {"name": "D", "ep_ratio": 0.2}], "studio": "S", "episodes": [{"ep_num": 1, "genga": ["no"]}]})
    rows = [("anime_7", "T", None, None, 71.0, doc, 1), ("anime_7", "T", None, None, 71.0, doc, 1), ("x", None, "E", 2001, None, '{"genga": {"F": 0.5, "G": {"rank": 2}}}', 2), ("anime_9", "U", None, 1999, 50.0, None, 3)]
    meta = spark.createDataFrame(rows, "work_id string, title string, title_en string, year int, anilist_mean_score double, staff string, role int").select("*", F.lit("TV").alias("format"), F.lit(12).alias("episodes"), F.lit(1).cast("long").alias("anilist_id"), F.lit(2).cast("long").alias("bangumi_id"))
    assert sorted((r.ord, r.work_id, r.title, r.year, r.listed_year) for r in adapters.works_of(meta).collect()) == [(0, "x", "x", 2001, 2001), (7, "anime_7", "T", 0, 2020), (9, "anime_9", "U", 1999, 1999)]
    got = {(r.work_id, r.role, r.pos, r.name, r["rank"], r.ep_ratio) for r in adapters.credits_of(meta).collect()}
    assert got == {("anime_7", "director", 1, "A", 1.0, 1.0), ("anime_7", "director", 2, "B", 1.0, 1.0), ("anime_7", "genga", 1, "C", 3.0, 1.0), ("anime_7", "genga", 3, "D", 3.0, 0.2), ("anime_7", "studio", 1, "S", 1.0, 1.0), ("x", "genga", 0, "F", 1.0, 0.5), ("x", "genga", 0, "G", 2.0, 1.0)}
    assert {r.name for r in adapters.credits_of(meta, maps=False).where("work_id = 'x'").collect()} == set()


def test_search_and_fallback_attribution(spark):
    q = spark.createDataFrame([(1, "青空 Windmill"), (2, "ひとり"), (3, "zz")], "q_id int, title string")
    c = spark.createDataFrame([(5, "Windmill 空"), (6, "青空 Windmill"), (7, "青空")], "c_id int, c_name string")
    assert {(r.q_id, r.c_id) for r in matching.search_candidates(q, c).collect()} == {(1, 5), (1, 6)}
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "feature string, importance double")
    got = {r.feature: r.shap for r in model.fallback_attribution(spark.createDataFrame([("w", 0.9)], "work_id string, predicted_z double"), weights, 0.1).collect()}
    assert got == pytest.approx({"a": 0.2, "b": 0.6}, abs=1e-5)
    assert len(model.labels()) == 34 and model.labelled(weights).where("feature = 'a'").first().label == "a"


def test_refresh_fits_anew(spark, tables, tmp_path):
    from orizuru.plans import snapshot

    _, _, scored, credits = tables
    ratings = spark.createDataFrame(RATINGS, "user_id bigint, item_id string, score double")
    new = scored.drop("z").where("work_id = 'A'").withColumn("title", F.lit("A2")).select("ord", "work_id", "title", "title_en", "year", "raw_score")
    s = snapshot.refresh(scored.drop("z"), credits, new, ratings, ratings.where("user_id = 1"), str(tmp_path / "out"), max_iter=2, trees=2)
    assert s.works.where("work_id = 'A'").first().title == "A2" and s.biases["n"] == 9 and (tmp_path / "out" / "summary").exists()


def test_candidates_golden(spark):
    rows = [(1, "進撃の巨人", 2013, 25, None, 1, 10, "進撃の巨人", "进击的巨人", "2013-04-06", 25), (1, "進撃の巨人", 2013, 25, None, 2, 11, "進撃の巨人 Season 2", "", "2017-04-01", 12)]
    df = spark.createDataFrame(rows, "q_id int, title string, year int, episodes int, format string, c_ord int, c_id int, c_name string, c_name_cn string, c_date string, c_eps int")
    assert matching.score_candidates(df).collect() == [(1, 10, 195.0)]
    assert matching.score_candidates(df.where("c_id = 11")).count() == 0
    best = matching.best_titles(spark.createDataFrame([(1, "ぼっち・ざ・ろっく"), (2, "まったく別")], "q_id int, query string"), spark.createDataFrame([(5, "ぼっち・ざ・ろっく！"), (6, "ろっく")], "t_id int, title string"))
    assert [(r.q_id, r.t_id) for r in best.collect()] == [(1, 5)]
    pairs = [("abcd", "axcd"), ("ああああ", "ああああ"), ("ab", "ac"), ("xyz", "xwz"), ("かきくけこ", "かきのけこ")]
    near = matching.best_titles(spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "q_id int, query string"), spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)], "t_id int, title string"), threshold=60.0)
    want = {i for i, (a, _) in enumerate(pairs) if max(matching.similarity(a, b) for _, b in pairs) >= 60}
    assert {r.q_id for r in near.collect()} == want >= {0, 1, 3, 4}


def test_loss_of_a_round_needs_no_pairs(spark, monkeypatch):
    rows = [*RATINGS, *RATINGS[:3]]
    seen = []
    kept = bias._round_loss
    monkeypatch.setattr(bias, "_round_loss", lambda *a: seen.append((a[2].collect(), a[3].collect())) or kept(*a))
    got = bias.fit(spark.createDataFrame(rows, "user_id bigint, item_id string, score double"), max_iter=3, tol=1e-12)
    assert "s2" not in got["users"].columns + got["items"].columns and got["users"].columns == ["user_id", "b_u"]
    valid = [(u, i, s) for u, i, s in rows if s is not None and not math.isnan(s)]
    for (users, items), loss in zip(seen, got["losses"]):
        b_u, b_i = {r.user_id: r.b_u for r in users}, {r.item_id: r.b_i for r in items}
        errors = sum((s - got["mean"] - b_u[u] - b_i[i]) ** 2 for u, i, s in valid)
        assert loss == pytest.approx(errors + 10 * sum(b * b for b in b_u.values()) + 10 * sum(b * b for b in b_i.values()), rel=1e-9)
    assert len(seen) == len(got["losses"]) == 3


def test_titles_lose_no_pair_that_reaches_the_threshold(spark):
    rng = np.random.default_rng(3)
    words = ["眠らない", "石橋", "の", "と", "第2期", "abc", "ten", *"あいうえお"]
    made = [["".join(rng.choice(words, rng.integers(1, 7))) for _ in range(250)] for _ in range(2)]
    asked, titles = [*made[0], "abxcdyefzg", "い" * 63 + "う", "あ" * 66], [*made[1], "axbcydezfg", "い" * 64, "あ" * 70]
    got = {a: (round(s, 9), i) for a, s, i in matching.best_of_block(list(dict.fromkeys(asked)), titles, list(range(len(titles))), 70.0)}
    best = {a: max((matching.similarity(a, b), -i) for i, b in enumerate(titles)) for a in asked}
    assert got == {a: (round(s, 9), -i) for a, (s, i) in best.items() if s >= 70.0} and len(got) > 50
    one, other, first = matching._Forms(["abxcdyefzg"]), matching._Forms(["axbcydezfg"]), np.array([0])
    assert matching._common(one, first, other, first, matching._letters(one, other)).tolist() == [7]
    # one pair of letters stands side by side in both, ids of equal forms, a title asked for twice
    q = spark.createDataFrame([(1, "abcdefg"), (2, "Same!"), (3, "same"), (4, ""), (5, None)], "q_id int, query string")
    t = spark.createDataFrame([(9, "SAME"), (7, "same"), (8, "axbxcxdxeyfg"), (3, None)], "t_id long, title string")
    rows = {r.q_id: (r.t_id, r.score_pct) for r in matching.best_titles(q, t).collect()}
    assert rows == {1: (8, int(matching.similarity("abcdefg", "axbxcxdxeyfg") * 100 + 0.5)), 2: (7, 10000), 3: (7, 10000)}
    assert matching.best_titles(q.limit(0), t).count() == matching.best_titles(q, t.limit(0)).count() == 0


def test_relations(spark):
    rows = [(1, 1, "X", "第二原画"), (1, 2, "X", "原画"), (1, 3, "Y", "导演"), (1, 4, "Y", "总导演"), (1, 5, "Z", "其他"), (1, 6, " ", "音乐")]
    out = matching.relation_roles(spark.createDataFrame(rows, "subject_id int, ord int, name string, relation string")).collect()
    assert {(r.role, r.name, r.ep_ratio, r.ord) for r in out} == {("genga", "X", 0.5, 1), ("director", "Y", 1.0, 3)}


def brute_nested(work, doc):
    try:
        j = json.loads(doc) if doc is not None else None
    except ValueError:
        return set()
    if not isinstance(j, dict):
        return set()

    def names(v, role):
        if isinstance(v, str):
            yield 1, v
        elif isinstance(v, list):
            for i, x in enumerate(v, 1):
                x = x.get("name") if isinstance(x, dict) else x
                if isinstance(x, str):
                    yield i, x
        elif isinstance(v, dict):
            yield from ((0, k) for k in v) if role == "genga" else ([(1, v["name"])] if isinstance(v.get("name"), str) else [])

    out = {(work, 0, r, p, n.strip(" ")) for r in nested.WORK_ROLES for p, n in names(j.get(r), r) if n.strip(" ")}
    for e in j.get("episodes") or []:
        out |= {(work, e.get("ep_num"), r, p, n.strip(" ")) for r in nested.EPISODE_ROLES for p, n in names(e.get(r), r) if n.strip(" ")}
    return out


def test_nested_shapes(spark):
    docs = [
        None, "", "{broken", "[]", "3", "{}", '{"director": " A "}', '{"director": ["", "B", {"name": "C"}, {"name": null}, 5, {"x": 1}], "music": null, "studio": []}',
        '{"genga": {"D": {"rank": 1, "ep_ratio": 0.5}, "E": 0.3, "F": null, " ": 1}, "sakkan": {"name": "G"}}', '{"genga": [{"name": "H", "rank": 2.5, "relation": "x"}, "H"]}',
        '{"episodes": [{"ep_num": 3, "genga": ["I", " "], "conte_enshutsu": "J", "director": "no"}, {"ep_num": 4}]}', '{"director": ["' + "長" * 5000 + '"]}',
    ]
    df = spark.createDataFrame([(f"w{i}", d, i) for i, d in enumerate(docs)] + [("w6", docs[6], 0)], "work_id string, staff string, name int")
    want = set().union(*(brute_nested(f"w{i}", d) for i, d in enumerate(docs)))
    rows = [tuple(r) for r in nested.found_credits(df).collect()]
    assert set(rows) == want and len(rows) == len(want)
    full = {(r.name, r.rank, r.ep_ratio, r.relation) for r in nested.flatten_credits(df).where("role = 'genga'").collect()}
    assert {("D", 1.0, 0.5, None), ("E", None, 0.3, None), ("F", None, None, None), ("H", 2.5, None, "x")} <= full
    assert {(r.work_id, r.ep_pos, r.ep_num) for r in nested.flatten_episodes(df).collect()} == {("w10", 1, 3), ("w10", 2, 4)}
    assert nested.found_credits(df.limit(0)).count() == 0


def test_wiki_page(spark):
    page = """<html><title>作品名 - wiki</title><div class="user-area">2013年 全4話<br>監督：山田太郎<br>音楽：鈴木<br>第1話<br>原画：佐藤花子、高橋<br>田中次郎<br>動画<br>無視される<br>第2話<br>原画：高橋<br>作画監督：佐藤花子(*1)</div></html>"""
    read = wiki.scan(page)
    assert (read["title"], read["year"], read["total_episodes"]) == ("作品名", 2013, 4)
    assert (0, "director", 1, "山田太郎") in read["credits"] and (1, "genga", 3, "田中次郎") in read["credits"] and (2, "sakkan", 1, "佐藤花子") in read["credits"]
    assert not any(n == "無視される" for *_, n in read["credits"])
    ahead = """<title>T</title><div class="user-area">キャラクターデザイン<br>CHARACTER DESIGN<br>山田太郎<br>高橋花子<br>監督：スタジオ山、原画田、鈴木一（仮）、A1、あ<br>シリーズ構成<br>x1<br>x2<br>x3<br>x4<br>x5<br>佐藤次郎<br>第1話<br>作画監督：田中、中村<br>第2話<br>原画：中村 田中<br>西村<br>動画<br>東山</div>"""
    found = wiki.scan(ahead)["credits"]
    assert [(e, r, n) for e, r, _, n in found] == [(0, "char_design", "山田太郎"), (0, "director", "鈴木一"), (1, "sakkan", "田中"), (1, "sakkan", "中村"), (2, "genga", "中村"), (2, "genga", "田中"), (2, "genga", "西村")]
    value = "山田 太郎（仮）「題」、Sunny, 田中監督/A1・ｱ 東映子"
    assert wiki.split_names(value) == spark.range(1).select(wiki.split_value(F.lit(value)).alias("v")).first().v == ["山田", "太郎", "Sunny"]
    assert wiki.scan("")["credits"] == [] and wiki.scan("<p>x</p>")["year"] == 0
    rows = spark.createDataFrame([(1, 4, 1, 1, "X"), (1, 4, 1, 2, "Y"), (1, 4, 2, 1, "Y"), (1, 4, 2, 2, "X")], "page_id int, total_episodes int, ep_num int, pos int, name string")
    assert {(r["name"], r["rank"], r.ep_ratio) for r in wiki.participation(rows).collect()} == {("X", 1.5, 0.5), ("Y", 1.5, 0.5)}
    got = spark.range(1).select(wiki.union_names(F.array(F.lit("a1"), F.lit("b")), F.array(F.lit("a1"), F.lit("cc"))).alias("v")).first().v
    assert got == ["a1", "cc"]


def test_merge_and_dedupe(spark):
    old = spark.createDataFrame([(1, "a", "A"), (2, "b", "B")], "ord bigint, work_id string, title string")
    new = spark.createDataFrame([(1, "b", "B2"), (2, "c", "C")], "ord bigint, work_id string, title string")
    assert sorted(tuple(r) for r in works.merge(old, new).collect()) == [(1, "a", "A"), (2, "b", "B2"), (4, "c", "C")]
    assert works.merge(old.limit(0), new).count() == 2


def test_model_attribution_adds_up(spark):
    rng = np.random.default_rng(1)
    rows = [(f"w{i}", float(a), float(b), float(2 * a - (b > 0.5))) for i, (a, b) in enumerate(rng.random((80, 2)))]
    m = spark.createDataFrame(rows, "work_id string, a double, b double, z double")
    fitted = model.fit(m, ["a", "b"], trees=8)
    predicted = {r.work_id: r.predicted_z for r in model.predict(m, fitted, ["a", "b"]).collect()}
    shap = model.attribute(m, fitted, ["a", "b"]).groupBy("work_id").agg((F.sum("shap") + F.first("base_value")).alias("v"))
    assert {r.work_id: r.v for r in shap.collect()} == pytest.approx(predicted)
    # exact values: the mean over both orders of fixing the two features
    trees, x = model._trees(fitted), np.array(rows[3][1:3])

    def expected(t, known, at=0):
        """Mean of the leaves where the features in the bit set are fixed to x and the others follow the cover."""
        f, left, right = int(t["feature"][at]), t["left"][at], t["right"][at]
        if f < 0:
            return t["value"][at]
        if known >> f & 1:
            return expected(t, known, left if x[f] <= t["threshold"][at] else right)
        wl, wr = t["cover"][left], t["cover"][right]
        return (wl * expected(t, known, left) + wr * expected(t, known, right)) / (wl + wr)

    value = lambda known: sum(expected(t, known) for t in trees)
    want = {"a": 0.5 * (value(1) - value(0) + value(3) - value(2)), "b": 0.5 * (value(2) - value(0) + value(3) - value(1))}
    assert {r.feature: r.shap for r in model.attribute(m.where("work_id = 'w3'"), fitted, ["a", "b"]).collect()} == pytest.approx(want)


def test_store_round_trip(spark, tmp_path):
    (tmp_path / "works.json").write_text(json.dumps({"w1": {"title": "甲", "year": 2001, "anilist_mean_score": 71.5, "staff": {"director": "X"}}, "w2": {}}, ensure_ascii=False))
    rows = store.read_works_json(spark, str(tmp_path / "works.json")).orderBy("ord").collect()
    assert [(r.ord, r.work_id, r.title, r.year) for r in rows] == [(0, "w1", "甲", 2001), (1, "w2", None, None)]
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(Exception):
        store.read_works_json(spark, str(tmp_path / "bad.json")).collect()
    works_ = spark.createDataFrame([("w1", 70.0), ("w2", 20.0)], "work_id string, raw_score double")
    a, b = (sorted(map(tuple, store.synthetic_ratings(spark, works_.repartition(n)).collect())) for n in (1, 3))
    assert a == b and all(10 <= s <= 100 for _, _, s in a)
    doc = [('{"id": 7, "title": {"romaji": "R"}, "startDate": {"year": 1999}, "studios": {"nodes": [{"name": "S"}]}}',), ("null",)]
    assert [(r.anilist_id, r.year, r.studios) for r in store.media_to_entries(spark.createDataFrame(doc, "json string")).collect()] == [(7, 1999, ["S"])]


def test_cached_sources(spark):
    rows = [(1, 1995, "1995-04-01"), (2, 1995, "1999-01-01"), (3, 0, "1999-01-01"), (4, 1995, None), (5, None, "x"), (6, 1995, "1997")]
    assert {r.i for r in store.fresh_results(spark.createDataFrame(rows, "i int, year int, date string")).collect()} == {1, 3, 4, 5, 6}
    docs = [(7, '[{"name": " A ", "relation": "导演"}, {"name": "", "relation": "x"}, {"name": "B", "relation": "原画"}]'), (8, None), (9, "broken")]
    assert [(r.subject_id, r.ord, r["name"]) for r in store.persons_of(spark.createDataFrame(docs, "subject_id int, json string")).collect()] == [(7, 0, "A"), (7, 2, "B")]
    candidates = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "ord int, title string")

    def fetch(row):
        if row["ord"] == 3:
            raise OSError("no answer")
        return {"title": row["title"].upper()} if row["ord"] % 2 else None

    assert sorted((r.ord, r.title) for r in store.ingest(candidates, fetch, "ord int, title string", 3).collect()) == [(i, f"T{i}") for i in range(1, 20, 2) if i != 3]
    entries = [(i, 1990 + i % 3 if i % 5 else 0, (1990 + i % 3) * 10000 + 701 if i % 5 else None, 1000 - i, None, None, None, None) for i in range(400)]
    df = spark.createDataFrame(entries, "anilist_id bigint, year int, start_date int, popularity bigint, mean_score double, average_score double, format string, episodes int")
    got = {r.anilist_id: r for r in store.era_catalogue(df).collect()}
    assert got[1].year == 1991 and got[0].year == 2020 and got[0].mean_score == 75.0 and got[0].episodes == 12 and got[1].place < got[0].place
    assert {i for i in range(250)} <= set(got) and len([i for i in got if i % 5]) == 300
    assert [r.anilist_id for r in store.popular_entries(df, 3).orderBy("place").collect()] == [1, 2, 3]


def test_streamed_sums(spark, tmp_path):
    from orizuru.streaming import ratings as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("user_id,item_id,score\n1,A,50\n1,A,60\n2,A,\n")
    for n in (1, 2):
        stream.write_sums(stream.rating_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
        (tmp_path / "in" / "2.csv").write_text("user_id,item_id,score\n1,A,70\n")
    assert [tuple(r) for r in stream.current_sums(spark, str(tmp_path / "out")).collect()] == [(1, "A", 3, 180.0)]


def test_snapshot_end_to_end(spark):
    from orizuru.plans.snapshot import fit

    rng = np.random.default_rng(0)
    ids = [f"w{i}" for i in range(40)]
    ratings = spark.createDataFrame([(int(u), w, float(50 + 10 * rng.standard_normal())) for u in range(15) for w in ids], "user_id bigint, item_id string, score double")
    catalogue = spark.createDataFrame([(i, w, w, "", 1990 + i % 20, 60.0) for i, w in enumerate(ids)], "ord bigint, work_id string, title string, title_en string, year int, raw_score double")
    credits = spark.createDataFrame([(i, w, r, 1, f"p{(i * 7 + k) % 9}", 1.0, 1.0) for i, w in enumerate(ids) for k, r in enumerate(("director", "genga"))], "work_ord bigint, work_id string, role string, pos int, name string, rank double, ep_ratio double")
    s = fit(ratings, catalogue, credits, max_iter=5, trees=5)
    assert s.matrix.count() == 40 and s.records.count() == 80
    assert all(math.isfinite(r.predicted_z) for r in model.predict(s.matrix, s.model).collect())
    assert export.summary(s.works, s.records).first().total_works == 40


def test_model_queries_do_the_whole_job(spark, tables, monkeypatch):
    from orizuru import queries

    fitted, _, scored, credits = tables
    ratings = spark.createDataFrame(RATINGS, "user_id bigint, item_id string, score double")
    for name, rows in (("ratings", ratings), ("works", scored), ("credits", credits)):
        monkeypatch.setattr(queries.adapters, name, lambda *_, rows=rows: rows)
    assert queries._trained(spark, "")[1].getNumTrees == 100
    kept = {}
    fit = queries.snapshot.fit
    monkeypatch.setattr(queries.snapshot, "fit", lambda *a: kept.setdefault("s", fit(*a)))
    got = {r.work_id: r.z for r in queries.queries()["converged_predictions"](spark, "").collect()}
    assert kept["s"].model.getNumTrees == 100 and len(kept["s"].biases["losses"]) == len(fitted["losses"]) > 3
    want = {r.work_id: r.z for r in scored.where("z is not null").collect()}
    assert set(got) == set(want) and all(got[w] == pytest.approx(want[w], abs=1e-9) for w in want)


def test_sample_by_hash(spark):
    from orizuru.session import hashed_sample

    df = spark.range(20_000).selectExpr("id % 15000 as id", "null as x").union(spark.range(9000).selectExpr("7L", "null"))
    a, b = ([r.id for r in hashed_sample(df.repartition(k), 300).collect()] for k in (2, 7))
    assert a == b and len(set(a)) == 300
    assert hashed_sample(df.limit(0), 5).count() == 0 and hashed_sample(df.where("id < 3"), 10).count() == 3
