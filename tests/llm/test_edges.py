"""Every query of the problems over empty tables and over tables of nulls, blanks and repeated rows."""

import json

import pytest

SCHEMAS = {
    "anime_metadata": "work_id string, title string, title_en string, year int, anilist_mean_score double, format string, episodes int, anilist_id bigint, bangumi_id bigint, source_url string, staff string, collected_at timestamp",
    "anilist_client": "anilist_id bigint, title_romaji string, title_english string, title_native string, synonyms array<string>, year int, format string, episodes int, mean_score double, average_score double, popularity bigint, studios array<string>, fetched_at timestamp",
    "seesaa_client": "page_id bigint, title string, year int, total_episodes int, staff string, source_url string, fetched_at timestamp",
    "genga": "credit_id bigint, work_id string, name string, rank double, ep_ratio double, relation string, added_at timestamp, loaded_at timestamp",
    "leaderboards": "entry_id bigint, board string, n string, w int, r double, z double, rk int, ck int, rt string, ct string, bt string, byr int, bz double, exported_at timestamp, loaded_at timestamp",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, work_id string, posted_at timestamp",
}
STAFF = json.dumps({"director": ["青山花子", " ", None], "genga": {"Robert Nukayuri": 0.5}, "studio": "スタジオ空"}, ensure_ascii=False)
ROWS = {
    "anime_metadata": [("w1", "青い空", None, 2000, None, "TV", 12, 1, None, None, STAFF, None), ("w2", "", "", 0, float("nan"), None, None, None, None, None, "{broken", None), (None,) * 12],
    "anilist_client": [(1, "Aoi Sora", None, "青い空", ["あおいそら", None, " "], 2000, "TV", 12, None, None, None, ["Studio Sora", None], None), (2, "", None, None, None, 0, None, None, None, None, None, None, None), (None,) * 13],
    "seesaa_client": [(7, "青い空", 2000, 12, '{"director": ["青山花子"], "studio": ["スタジオ空"]}', None, None), (8, None, 0, None, "[]", None, None), (9, " ", None, None, None, None, None), (None,) * 7],
    "genga": [(1, "w1", "青山花子", None, float("nan"), None, None, None), (2, None, " ", None, None, None, None, None), (3, "w1", "長" * 3000, None, None, None, None, None), (None,) * 8],
    "leaderboards": [(1, "a", "青山花子", 1, 1.0, None, 1, None, None, None, None, None, None, None, None), (2, "a", None, None, 1.0, None, None, None, None, None, None, None, None, None, None), (None,) * 15],
    "documents": [(1, "連絡は a.b@box.invalid まで。" * 400, None, None, None, None, None), (2, "", None, None, None, None, None), (3, None, None, None, None, None, None), (4, " \n", None, None, None, None, None), (None,) * 7],
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("empty", "odd"):
        folder = tmp_path_factory.mktemp(kind)
        for name, schema in SCHEMAS.items():
            rows = ROWS[name] + ROWS[name][:1] if kind == "odd" else []
            spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))
        out[kind] = str(folder)
    return out


NAMES = ("p1_found", "p2_found", "p3_found", "p4_found", "p6_found", "p7_ids", "p8_packed", "p9_found", "p9_redacted")


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, folders, name):
    from orizuru.llm import queries

    assert queries.queries()[name](spark, folders["empty"]).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_do_not_disturb(spark, folders, name):
    from orizuru.llm import queries

    rows = queries.queries()[name](spark, folders["odd"]).collect()
    if name == "p1_found":
        assert {(r.board, r.entry_id) for r in rows} == {("a", 1), ("a", 2)}
    if name == "p4_found":
        assert {(r.page_id, r.anilist_id) for r in rows} <= {(7, 1)}
    if name == "p7_ids":
        assert {r.doc_id: len(r.ids) for r in rows if r.doc_id in (2, 3)} == {2: 0, 3: 0}
    if name == "p9_found":
        assert all(r.doc_id == 1 for r in rows) and len(rows) in (0, 400)
    if name in ("p7_ids", "p8_packed", "p9_redacted"):
        assert {r.doc_id for r in rows} >= {1, 2, 3, 4}
