"""The SQL of the core's queries, written independently of them for another engine."""

from __future__ import annotations

from orizuru.functions import text
from orizuru.operators import matching, nested
from orizuru.sources import store, wiki

MAIN = ("director", "series_comp", "char_design", "unit_director", "sakkan", "music", "art_dir")
STAFF = (*MAIN, "genga")
ROLES = "['director','series_comp','char_design','unit_director','sakkan','music','art_dir','genga','studio']"


def rnd(x: str, k: int) -> str:
    """Half up on the double."""
    return f"(floor(({x}) * 1e{k} + 0.5) / 1e{k})"


def xsum(x: str) -> str:
    """A sum in any order."""
    return f"CAST(sum(CAST({x} AS DECIMAL(20,9))) AS DOUBLE)"


def m_of(role: str) -> str:
    return f"(CASE {role} WHEN 'director' THEN 2.0 WHEN 'series_comp' THEN 2.0 WHEN 'char_design' THEN 2.0 WHEN 'music' THEN 2.0 WHEN 'unit_director' THEN 4.0 WHEN 'sakkan' THEN 4.0 WHEN 'art_dir' THEN 4.0 ELSE 6.0 END)"


WORKS = """works AS (SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS work_id, p_name AS title, p_brand || ' ' || p_type AS title_en,
  CAST(1970 + p_size AS INTEGER) AS year, p_retailprice - 900 AS raw_score, (p_retailprice - 950) / 25 AS z FROM part)"""
RATINGS = """ratings AS (SELECT o_custkey AS user_id, CAST(l_partkey AS VARCHAR) AS item_id, greatest(10.0, least(100.0, 2 * l_quantity)) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CREDITS = f"""credits AS (SELECT l_partkey AS work_ord, CAST(l_partkey AS VARCHAR) AS work_id, c_name AS name, role, CAST(l_linenumber AS DOUBLE) AS rank, 10 * l_discount AS ep_ratio,
  CAST(row_number() OVER (PARTITION BY l_partkey, role ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, c_name) AS INTEGER) AS pos
  FROM (SELECT *, {ROLES}[(l_orderkey + l_linenumber) % 9 + 1] AS role FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey))"""
RECORDS = f"""recs AS (SELECT trim(c.name) AS name, c.role, w.work_id, w.title, w.year, w.z, CASE WHEN role = 'genga' THEN rank ELSE 1.0 END AS rank,
  CASE WHEN role = 'genga' THEN ep_ratio ELSE 1.0 END AS ep_ratio,
  struct_pack(w := work_ord, r := list_position({list(STAFF)}, role), p := pos) AS ord
  FROM credits c JOIN works w ON c.work_id = w.work_id WHERE role <> 'studio')"""
RATED = f"""overall AS (SELECT name, count(*) AS n, {xsum('z')} AS z_sum, {xsum('z')} / (count(*) + 6.0) AS rating, min(ord) AS ord FROM recs GROUP BY name),
byrole AS (SELECT role, name, count(*) AS n, {xsum('z')} AS z_sum, {xsum('z')} / (count(*) + {m_of('role')}) AS rating, min(ord) AS ord FROM recs GROUP BY role, name),
oranks AS (SELECT *, CAST(row_number() OVER (ORDER BY rating DESC, ord) AS INTEGER) AS overall_rank,
  CAST(row_number() OVER (ORDER BY z_sum DESC, rating DESC, ord) AS INTEGER) AS cumulative_rank, count(*) OVER () AS total_staff FROM overall),
rranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY role ORDER BY rating DESC, ord) AS INTEGER) AS rating_rank,
  CAST(row_number() OVER (PARTITION BY role ORDER BY z_sum DESC, ord) AS INTEGER) AS cumulative_rank, count(*) OVER (PARTITION BY role) AS role_total FROM byrole)"""


def als(rounds: int, source: str = "ratings") -> str:
    """The alternating updates unrolled."""
    out = [f"mu AS (SELECT avg(score) AS mean FROM {source}), res AS (SELECT user_id, item_id, score - mean AS r FROM {source}, mu), bi0 AS (SELECT DISTINCT item_id, 0.0 AS b_i FROM res)"]
    for k in range(1, rounds + 1):
        out.append(f"bu{k} AS (SELECT user_id, sum(r - b_i) / (count(*) + 10.0) AS b_u FROM res JOIN bi{k - 1} USING (item_id) GROUP BY user_id)")
        out.append(f"bi{k} AS (SELECT item_id, sum(r - b_u) / (count(*) + 10.0) AS b_i FROM res JOIN bu{k} USING (user_id) GROUP BY item_id)")
    return ", ".join(out)


def years(source: str) -> str:
    """Adaptive windows over `source` (year, b)."""
    return f"""overall_b AS (SELECT avg(b) AS gm, stddev_pop(b) + 1e-6 AS gs FROM {source}),
ys AS (SELECT DISTINCT year AS y FROM {source}),
sized AS (SELECT y, w, count(*) AS n FROM ys, generate_series(3, 15) g(w), {source} WHERE abs(year - y) <= w GROUP BY y, w),
chosen AS (SELECT y, min(w) AS w FROM sized WHERE n >= 3 GROUP BY y),
inside AS (SELECT c.y, avg(b) AS m, stddev_pop(b) AS s, count(*) AS n FROM chosen c, {source} d WHERE abs(d.year - c.y) <= c.w GROUP BY c.y),
stats AS (SELECT ys.y AS year, coalesce(m, gm) AS mu, CASE WHEN s < 1e-6 THEN gs ELSE coalesce(s, gs) END AS sigma,
  coalesce(i.n, (SELECT n FROM sized z WHERE z.y = ys.y AND z.w = 15)) AS n, CAST(coalesce(c.w, -1) AS INTEGER) AS w
  FROM ys LEFT JOIN inside i ON ys.y = i.y LEFT JOIN chosen c ON ys.y = c.y, overall_b)"""


ERA = f"{WORKS}, {RATINGS}, {als(3)}, dated AS (SELECT work_id, year, b_i AS b FROM bi3 JOIN works ON item_id = work_id), {years('dated')}"
PAST = f"""pw AS (SELECT DISTINCT work_id, name FROM credits WHERE role <> 'studio'),
hist AS (SELECT name, year, z FROM pw JOIN works USING (work_id)),
spans AS (SELECT DISTINCT name, year FROM hist),
past AS (SELECT s.name, s.year, count(h.z) AS n, coalesce(CAST(sum(CAST(h.z AS DECIMAL(20,9))) AS DOUBLE), 0.0) AS sum_z, max(h.z) AS max_z FROM spans s LEFT JOIN hist h ON h.name = s.name AND h.year < s.year GROUP BY s.name, s.year),
cp AS (SELECT c.*, w.year, p.n, p.sum_z, p.max_z FROM credits c JOIN works w USING (work_id) JOIN past p ON p.name = c.name AND p.year = w.year)"""
GENGA = f"""gf AS (SELECT work_id, {xsum('w * s')} / {xsum('w')} AS genga_weighted_s, avg(CASE WHEN s > 0.4 THEN 1.0 ELSE 0.0 END) AS genga_top_density, max(s) AS genga_max_s,
  CAST(count(*) AS DOUBLE) AS genga_total_count, avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) AS genga_experienced_ratio, {xsum('w')} AS genga_sum_weights
  FROM (SELECT work_id, greatest(0.01, least(1.0, ep_ratio)) AS w, sum_z / (n + 6.0) AS s, n FROM cp WHERE role = 'genga') GROUP BY work_id)"""
ROLE = f"""rf AS (SELECT work_id, role, CASE WHEN sum(n) > 0 THEN {xsum('sum_z')} / (sum(n) + {m_of('role')}) ELSE 0.0 END AS bayesian_s, CASE WHEN sum(n) > 0 THEN {xsum('sum_z')} / sum(n) ELSE 0.0 END AS mean_z,
  coalesce(max(max_z), 0.0) AS max_z, CAST(sum(n) AS DOUBLE) AS past_count FROM cp WHERE role NOT IN ('genga', 'studio') GROUP BY work_id, role)"""
GENGA_COLUMNS = ("genga_weighted_s", "genga_top_density", "genga_max_s", "genga_total_count", "genga_experienced_ratio", "genga_sum_weights")
ROLE_COLUMNS = ("bayesian_s", "mean_z", "max_z", "past_count")
BASE = f"WITH {WORKS}, {CREDITS}, {RECORDS}"


def ladder(x: str, steps: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} {s.split()[0]} {s.split()[1]} THEN '{s.split()[2]}'" for s in steps.split(", ")) + " ELSE 'D' END"


SCORE = ">= 70 S+, >= 65 S, >= 60 A+, >= 55 A, >= 50 B+, >= 45 B, >= 40 C"
PERSON = "<= 2.3 S+, <= 6.7 S, <= 15.9 A+, <= 30.9 A, <= 50 B+, <= 70 B, <= 85 C"
SHARE = "<= 1 S+, <= 5 S, <= 15 A+, <= 30 A, <= 50 B, <= 75 C"
DEV = rnd("50 + 10 * z", 1)


def person_tier(rank: str, total: str) -> str:
    return ladder(f"({rank} / CAST({total} AS DOUBLE) * 100.0)", PERSON)


def board(role: str | None, sort: str = "bayesian_rating", least: int = 1, limit: int | None = 100, head: str = BASE, m: float | None = None) -> str:
    m = m or {"director": 2.0, "series_comp": 2.0, "char_design": 2.0, "music": 2.0, "unit_director": 4.0, "sakkan": 4.0, "art_dir": 4.0}.get(role or "", 6.0)
    where = f"WHERE role = '{role}'" if role else ""
    inner = f"""SELECT name, count(*) AS works_count, {rnd(f"{xsum('z')} / (count(*) + {m})", 3)} AS bayesian_rating, {rnd(xsum('z'), 2)} AS career_cumulative_z, {rnd(f"{xsum('z')} / count(*)", 3)} AS mean_z,
  {rnd('max(z)', 3)} AS peak_z, arg_min(struct_pack(t := title, y := year, z := z), struct_pack(z := -z, o := ord)) AS b, min(ord) AS ord FROM recs {where} GROUP BY name HAVING count(*) >= {least}"""
    ranked = f"SELECT *, CAST(row_number() OVER (ORDER BY {sort} DESC, ord) AS INTEGER) AS rank, count(*) OVER () AS total_count FROM ({inner})"
    cut = f"WHERE rank <= {limit}" if limit else ""
    return f"{head} SELECT name, works_count, bayesian_rating, career_cumulative_z, mean_z, peak_z, b.t AS best_work_title, b.y AS best_work_year, {rnd('b.z', 3)} AS best_work_z, rank, total_count FROM ({ranked}) {cut}"


BOARD_ROLES = (None, "director", "series_comp", "char_design", "sakkan", "genga", "unit_director", "music", "art_dir")
BOARDS = f"""{BASE}, {RATED}, cum AS (SELECT 'all' AS board, name, cumulative_rank FROM oranks UNION ALL SELECT role, name, cumulative_rank FROM rranks),
lb AS ({' UNION ALL '.join(f"SELECT '{r or 'all'}' AS board, * FROM ({board(r, limit=None, head='')})" for r in BOARD_ROLES)}),
boards AS (SELECT lb.board, lb.name AS n, works_count AS w, bayesian_rating AS r, career_cumulative_z AS z, rank AS rk, cumulative_rank AS ck, {person_tier('rank', 'total_count')} AS rt,
  {person_tier('cumulative_rank', 'total_count')} AS ct, best_work_title AS bt, best_work_year AS by, {rnd('best_work_z', 2)} AS bz FROM lb JOIN cum ON lb.board = cum.board AND lb.name = cum.name)"""

_WORK = ", ".join(f"'{r}'" for r in nested.WORK_ROLES)
_EPISODE = ", ".join(f"'{r}'" for r in nested.EPISODE_ROLES)
NESTED = f"""
WITH docs AS (SELECT DISTINCT work_id, CAST(staff AS JSON) AS doc FROM anime_metadata WHERE json_valid(staff) AND json_type(staff) = 'OBJECT'),
eps AS (SELECT work_id, CAST(e.key AS BIGINT) + 1 AS ep_pos, e.value AS ep FROM docs, json_each(CASE WHEN json_type(doc, '$.episodes') = 'ARRAY' THEN json_extract(doc, '$.episodes') ELSE '[]' END) e),
roles AS (
  SELECT work_id, CAST(0 AS BIGINT) AS ep_pos, CAST(0 AS BIGINT) AS ep_num, r.key AS role, r.value AS v, r.type AS t FROM docs, json_each(doc) r WHERE r.key IN ({_WORK})
  UNION ALL
  SELECT work_id, ep_pos, CAST(json_extract(ep, '$.ep_num') AS BIGINT), r.key, r.value, r.type FROM eps, json_each(ep) r WHERE r.key IN ({_EPISODE})),
named AS (
  SELECT work_id, ep_pos, ep_num, role, CAST(1 AS BIGINT) AS pos, json_extract_string(v, '$') AS name, NULL AS o FROM roles WHERE t = 'VARCHAR'
  UNION ALL
  SELECT work_id, ep_pos, ep_num, role, CAST(0 AS BIGINT), e.key, e.value FROM (SELECT * FROM roles WHERE t = 'OBJECT' AND role = 'genga') q, json_each(q.v) e
  UNION ALL
  SELECT work_id, ep_pos, ep_num, role, CAST(1 AS BIGINT), json_extract_string(v, '$.name'), v FROM roles WHERE t = 'OBJECT' AND role <> 'genga' AND json_type(v, '$.name') = 'VARCHAR'
  UNION ALL
  SELECT work_id, ep_pos, ep_num, role, CAST(x.key AS BIGINT) + 1,
    CASE WHEN x.type = 'VARCHAR' THEN json_extract_string(x.value, '$') WHEN x.type = 'OBJECT' AND json_type(x.value, '$.name') = 'VARCHAR' THEN json_extract_string(x.value, '$.name') END, x.value
  FROM roles, json_each(CASE WHEN t = 'ARRAY' THEN v ELSE '[]' END) x)
"""
NUMERIC = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT', 'INTEGER')"


def all_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["p5_found"] = NESTED + "SELECT DISTINCT work_id, ep_num, role, pos, trim(name, ' ') AS name FROM named WHERE trim(name, ' ') <> ''"
    sql["p5_credits"] = NESTED + f"""SELECT DISTINCT work_id, ep_pos, ep_num, role, pos, trim(name, ' ') AS name,
      CASE WHEN json_type(o, '$.rank') IN {NUMERIC} THEN CAST(json_extract(o, '$.rank') AS DOUBLE) END AS rank,
      CASE WHEN json_type(o, '$.ep_ratio') IN {NUMERIC} THEN CAST(json_extract(o, '$.ep_ratio') AS DOUBLE) WHEN pos = 0 AND json_type(o) IN {NUMERIC} THEN CAST(o AS DOUBLE) END AS ep_ratio,
      CASE WHEN json_type(o) = 'OBJECT' THEN json_extract_string(o, '$.relation') END AS relation FROM named WHERE trim(name, ' ') <> ''"""
    sql["global_mean"] = f"WITH {RATINGS} SELECT {rnd('avg(score)', 6)} AS mean, count(*) AS n FROM ratings"
    five = f"WITH {RATINGS}, {als(5)}"
    sql["user_bias_k5"] = f"{five} SELECT user_id, {rnd('b_u', 6)} AS b_u FROM bu5"
    sql["item_bias_k5"] = f"{five} SELECT item_id, {rnd('b_i', 6)} AS b_i FROM bi5"
    loss = "(SELECT sum((r - b_u - b_i) * (r - b_u - b_i)) FROM res JOIN bu5 USING (user_id) JOIN bi5 USING (item_id)) + 10.0 * (SELECT sum(b_u * b_u) FROM bu5) + 10.0 * (SELECT sum(b_i * b_i) FROM bi5)"
    sql["als_loss_k5"] = f"{five} SELECT {rnd(loss, 3)} AS loss"
    sql["predict_rating"] = f"{five} SELECT DISTINCT user_id, item_id, {rnd('mean + b_u + b_i', 5)} AS predicted FROM res JOIN bu5 USING (user_id) JOIN bi5 USING (item_id), mu"
    sql["year_stats"] = f"WITH {ERA} SELECT year, {rnd('mu', 6)} AS mu, {rnd('sigma', 6)} AS sigma, n FROM stats"
    sparse = "sparse AS (SELECT year, z AS b FROM works WHERE (year % 12 = 0 AND ord % 40 = 0) OR year = 2019)"
    sql["year_stats_sparse"] = f"WITH {WORKS}, {sparse}, {years('sparse')} SELECT year, {rnd('mu', 6)} AS mu, {rnd('sigma', 6)} AS sigma, n, w FROM stats"
    z = "(b - mu) / greatest(sigma, 1e-6)"
    sql["era_zscore"] = f"WITH {ERA} SELECT work_id, {rnd(z, 5)} AS z FROM dated JOIN stats USING (year)"
    sql["deviation_score"] = f"WITH {WORKS} SELECT work_id, {DEV} AS deviation_score FROM works"
    sql["inverse_z"] = f"WITH {ERA} SELECT work_id, {rnd('0.5 * coalesce(sigma, gs) + coalesce(mu, gm)', 5)} AS b FROM works LEFT JOIN stats USING (year), overall_b"
    chain = f"WITH {ERA}, zs AS (SELECT work_id, {rnd(z, 6)} AS zz FROM dated JOIN stats USING (year)), {CREDITS}, {RECORDS.replace('works w ON c.work_id = w.work_id', '(SELECT ord, works.work_id, title, year, zz AS z FROM works JOIN zs USING (work_id)) w ON c.work_id = w.work_id')}"
    sql["staff_leaderboard_all"] = f"SELECT name, works_count, bayesian_rating, career_cumulative_z, rank, total_count FROM ({board(None, limit=1000, head=chain)})"
    sql["credits_long"] = f"WITH {CREDITS} SELECT work_id, role, CAST(pos AS BIGINT) AS pos, name, rank, {rnd('ep_ratio', 6)} AS ep_ratio FROM credits"
    sql["work_people_distinct"] = f"WITH {CREDITS} SELECT DISTINCT work_id, name FROM credits WHERE role <> 'studio'"
    sql["staff_records"] = f"{BASE} SELECT name, role, work_id, year, {rnd('z', 6)} AS z, rank, {rnd('ep_ratio', 6)} AS ep_ratio FROM recs"
    hist = f"WITH {WORKS}, {CREDITS}, {PAST}"
    sql["history_past"] = f"{hist} SELECT name, year, n, {rnd('sum_z', 6)} AS sum_z, {rnd('coalesce(max_z, 0.0)', 6)} AS max_z FROM past"
    sql["genga_features"] = f"{hist}, {GENGA} SELECT work_id, {', '.join(f'{rnd(c, 6)} AS {c}' for c in GENGA_COLUMNS)} FROM gf"
    sql["role_features"] = f"{hist}, {ROLE} SELECT work_id, role, {', '.join(f'{rnd(c, 6)} AS {c}' for c in ROLE_COLUMNS)} FROM rf"
    wide = ", ".join(rnd(f"coalesce(max(CASE WHEN role = '{r}' THEN rf.{c} END), 0.0)", 6) + f" AS {r}_{c}" for r in MAIN for c in ROLE_COLUMNS)
    gg = ", ".join(rnd(f"coalesce(max(gf.{c}), 0.0)", 6) + f" AS {c}" for c in GENGA_COLUMNS)
    sql["feature_matrix"] = f"{hist}, {GENGA}, {ROLE} SELECT works.work_id, works.year, {gg}, {wide} FROM works LEFT JOIN gf ON gf.work_id = works.work_id LEFT JOIN rf ON rf.work_id = works.work_id GROUP BY works.work_id, works.year"
    ranked = f"{BASE}, {RATED}"
    sql["staff_overall_ranks"] = f"{ranked} SELECT name, n AS works, {rnd('rating', 6)} AS rating, {rnd('z_sum', 6)} AS z_sum, overall_rank, cumulative_rank, total_staff FROM oranks"
    sql["staff_role_ranks"] = f"{ranked} SELECT role, name, n AS works, {rnd('rating', 6)} AS rating, {rnd('z_sum', 6)} AS z_sum, rating_rank, cumulative_rank, role_total FROM rranks"
    sql["leaderboard_director"] = board("director")
    sql["leaderboard_genga"] = board("genga")
    sql["leaderboard_cumulative"] = board(None, "career_cumulative_z")
    sql["leaderboard_min_works"] = board("sakkan", least=3)
    counted = "(SELECT name, role, count(*) AS works, min(ord) AS o FROM recs GROUP BY name, role)"
    sql["primary_role"] = f"{BASE} SELECT name, role AS primary_role, works FROM {counted} QUALIFY row_number() OVER (PARTITION BY name ORDER BY works DESC, o) = 1"
    stats = f"SELECT name, count(*) AS total_works, {rnd(f"{xsum('z')} / (count(*) + 6.0)", 3)} AS bayesian_rating, {rnd(xsum('z'), 2)} AS career_cumulative_z, {rnd(f"{xsum('z')} / count(*)", 3)} AS raw_mean_z, {rnd('max(z)', 3)} AS peak_z, {rnd('stddev_pop(z)', 3)} AS std_z FROM recs GROUP BY name"
    sql["profile_stats"] = f"{BASE} {stats}"
    sql["best_works_top3"] = f"{BASE} SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY z DESC, year, ord) AS INTEGER) AS place, work_id, title, year, role, {rnd('z', 3)} AS z_score FROM recs QUALIFY place <= 3"
    sql["trajectory"] = f"{BASE} SELECT name, string_agg(year || ':' || work_id || ':' || role, ',' ORDER BY year, ord) AS career FROM recs GROUP BY name"
    sql["profile_role_stats"] = f"""{ranked} SELECT name, role, CAST(row_number() OVER (PARTITION BY name ORDER BY n DESC, f) AS INTEGER) AS place, n AS works_count, {rnd('z_sum', 2)} AS cumulative_z, {rnd('rating', 3)} AS bayesian_rating,
      rating_rank, cumulative_rank, role_total FROM rranks JOIN (SELECT name, role, min(struct_pack(y := year, o := ord)) AS f FROM recs GROUP BY name, role) USING (name, role)"""
    sql["search_staff"] = f"{BASE} SELECT name, rating, works_count FROM (SELECT name, count(*) AS works_count, {rnd(f"{xsum('z')} / (count(*) + 6.0)", 3)} AS rating, min(ord) AS o FROM recs WHERE contains(lower(name), '00012') GROUP BY name) ORDER BY rating DESC, o LIMIT 15"
    cols = ", ".join([f"max({rnd('o.rating', 3)}) AS r_all", *[f"max(CASE WHEN role = '{r}' THEN {rnd('b.rating', 3)} END) AS r_{r}" for r in STAFF]])
    sql["staff_index"] = f"{ranked} SELECT o.name, {cols} FROM overall o JOIN byrole b ON o.name = b.name GROUP BY o.name"
    sql["staff_head_counts"] = f"{BASE} SELECT role, count(DISTINCT name) AS persons FROM recs GROUP BY role UNION ALL SELECT 'all', count(DISTINCT name) FROM recs"
    zrank = f"row_number() OVER (ORDER BY {rnd('coalesce(z, 0.0)', 9)} DESC, ord)"
    sql["own_pseudo_counts"] = f"SELECT name, bayesian_rating, rank, total_count FROM ({board('director', m=5.0)})"
    sql["board_search"] = f"{BOARDS} SELECT n, w, r, z, rk, ck, CAST(row_number() OVER (ORDER BY ck, rk, n) AS INTEGER) AS shown FROM boards WHERE board = 'genga' AND contains(lower(replace(n, '#', '#')), '0001') ORDER BY ck LIMIT 20"
    sql["board_browse"] = f"{BOARDS} SELECT n, w, r, rk, ck, rk AS shown FROM boards WHERE board = 'all' ORDER BY rk LIMIT 25 OFFSET 25"
    sql["fallback_roles"] = f"{BOARDS} SELECT n, board AS primary_role FROM boards WHERE board <> 'all' QUALIFY row_number() OVER (PARTITION BY n ORDER BY w DESC, list_position({list(STAFF)}, board)) = 1"
    role_stats = f"""rs AS (SELECT name, string_agg(concat_ws(':', role, n, {rnd('z_sum', 2)}, {rnd('rating', 3)}, rating_rank, cumulative_rank, role_total, {person_tier('rating_rank', 'role_total')}, {person_tier('cumulative_rank', 'role_total')}), ',' ORDER BY n DESC, f) AS all_role_stats,
      arg_min(struct_pack(a := rating_rank, b := role_total), struct_pack(n := -n, f := f)) AS first FROM rranks JOIN (SELECT name, role, min(struct_pack(y := year, o := ord)) AS f FROM recs GROUP BY name, role) USING (name, role) GROUP BY name),
      bw AS (SELECT name, string_agg(concat_ws(':', work_id, year, role, {rnd('z', 3)}), ',' ORDER BY z DESC, year, ord) AS best_works FROM (SELECT * FROM recs QUALIFY row_number() OVER (PARTITION BY name ORDER BY z DESC, year, ord) <= 3) GROUP BY name),
      ct AS (SELECT name, string_agg(concat_ws(':', year, work_id, role, {rnd('z', 3)}), ',' ORDER BY year, ord) AS career_trajectory FROM recs GROUP BY name), st AS ({stats})"""
    chron = "SELECT name, role AS primary_role FROM (SELECT name, role, count(*) AS works, min(struct_pack(y := year, o := ord)) AS o FROM recs GROUP BY name, role) QUALIFY row_number() OVER (PARTITION BY name ORDER BY works DESC, o) = 1"
    sql["staff_profile"] = f"{ranked}, {role_stats} SELECT st.*, overall_rank, cumulative_rank, total_staff, primary_role, first.a AS role_rank, first.b AS role_total, all_role_stats, best_works, career_trajectory FROM st JOIN oranks USING (name) JOIN rs USING (name) JOIN bw USING (name) JOIN ct USING (name) JOIN ({chron}) USING (name) WHERE name = 'Customer#000000012'".replace("overall_rank, cumulative_rank, total_staff", "oranks.overall_rank, oranks.cumulative_rank, oranks.total_staff")
    found_works = f"SELECT 'work' AS kind, work_id AS id, title AS label, true_z AS score FROM (SELECT ord, work_id, title, {rnd('z', 2)} AS true_z FROM works WHERE contains(lower(title), '12') OR contains(lower(title_en), '12') OR contains(translate(lower(title), ' -', ''), '12') OR contains(translate(lower(title_en), ' -', ''), '12') ORDER BY true_z DESC, ord LIMIT 15)"
    found_staff = f"SELECT 'person', name, name, rating FROM (SELECT name, {rnd(xsum('z') + ' / (count(*) + 6.0)', 3)} AS rating, min(ord) AS o FROM recs WHERE contains(lower(name), '12') GROUP BY name ORDER BY rating DESC, o LIMIT 15)"
    sql["unified_search"] = f"{BASE} SELECT * FROM ({found_works}) UNION ALL SELECT * FROM ({found_staff})"
    sql["work_tiers"] = f"WITH {WORKS} SELECT work_id, {DEV} AS deviation_score, {ladder(DEV, SCORE)} AS tier, {rnd(f'{zrank} / CAST(count(*) OVER () AS DOUBLE) * 100.0', 2)} AS percentile FROM works"
    sql["staff_tiers"] = f"{ranked} SELECT role, name, {person_tier('rating_rank', 'role_total')} AS rt, {person_tier('cumulative_rank', 'role_total')} AS ct FROM rranks"
    sql["rank_tiers"] = f"{ranked} SELECT name, {ladder('(overall_rank / CAST(total_staff AS DOUBLE) * 100.0)', SHARE)} AS tier FROM oranks"
    x2 = "((abs(z) / sqrt(2.0)) * (abs(z) / sqrt(2.0)))"
    erf = f"(CASE WHEN z < 0 THEN -1.0 ELSE 1.0 END * sqrt(1 - exp(-{x2} * (4 / pi() + 0.147 * {x2}) / (1 + 0.147 * {x2}))))"
    top = f"greatest(0.01, least(99.99, (1 - 0.5 * (1 + {erf})) * 100))"
    sql["z_tiers"] = f"WITH {WORKS} SELECT work_id, {rnd('t', 6)} AS top_percent, {ladder('t', SHARE)} AS tier FROM (SELECT work_id, {top} AS t FROM works)"
    by = lambda x: f"CAST(row_number() OVER (ORDER BY {rnd(x, 9)} DESC, ord) AS INTEGER)"
    sql["work_ranks"] = f"WITH {WORKS} SELECT work_id, {by('z * 0.5')} AS pred_rank, {by('raw_score')} AS raw_rank, {by('z')} AS z_rank FROM works"
    verdict = "CASE WHEN z - p > 0.4 THEN 'surprise' WHEN z - p < -0.4 THEN 'disappointing' ELSE 'as expected' END"
    sql["comparison_core"] = f"""WITH {ERA}, pw AS (SELECT *, {rnd('z * 0.5 + raw_score / 200', 6)} AS p FROM works)
      SELECT work_id, title, year, {rnd('raw_score', 1)} AS raw_score, {rnd('coalesce(b_i, 0.0)', 2)} AS debiased, {rnd('z', 3)} AS true_z, {DEV} AS deviation_score, {rnd('p', 3)} AS predicted_z,
      {rnd('greatest(10.0, least(100.0, mean + p * coalesce(sigma, gs) + coalesce(stats.mu, gm)))', 1)} AS predicted_score,
      {by('z')} AS z_rank, {by('p')} AS pred_rank, {by('raw_score')} AS raw_rank, {rnd('z - p', 3)} AS residual, {verdict} AS verdict FROM pw LEFT JOIN bi3 ON work_id = item_id LEFT JOIN stats USING (year), overall_b, mu"""
    sql["comparison_filter"] = f"WITH {WORKS}, v AS (SELECT title, year, z AS true_z, CASE WHEN z * 0.5 > 0.4 THEN 'surprise' WHEN z * 0.5 < -0.4 THEN 'disappointing' ELSE 'as expected' END AS verdict FROM works) SELECT * FROM v WHERE contains(lower(title), 'cold') AND contains(verdict, 'expect')"
    sql["works_by_tier"] = f"SELECT work_id, title, year, deviation_score, tier FROM (WITH {WORKS} SELECT *, {DEV} AS deviation_score, {ladder(DEV, SCORE)} AS tier FROM works) WHERE year < 1990 AND tier = 'A+' ORDER BY deviation_score DESC, ord LIMIT 40"
    known_z = "(1.5 - coalesce(stats.mu, gm)) / greatest(coalesce(sigma, gs), 1e-6)"
    sql["standardise_known"] = f"WITH {ERA}, k AS (SELECT work_id, CASE WHEN ord % 3 = 0 THEN 1900 ELSE year END AS year FROM works) SELECT work_id, {rnd(known_z, 5)} AS z FROM k LEFT JOIN stats USING (year), overall_b"
    form = lambda c: f"translate(lower({c}), '・･ 　:：~～-—─!！?？☆★|｜│▌', '')"
    sql["search_works"] = f"""WITH {WORKS} SELECT work_id, title, title_en, year, true_z, deviation_score FROM (SELECT ord, work_id, title, title_en, year, {rnd('z', 2)} AS true_z, {DEV} AS deviation_score FROM works
      WHERE contains(lower(title), 'cold p') OR contains(lower(title_en), 'cold p') OR contains({form('title')}, 'coldp') OR contains({form('title_en')}, 'coldp')) ORDER BY true_z DESC, ord LIMIT 25"""
    client = lambda c: f"regexp_replace(lower({c}), '[\\s\\-_・:：,，.．!！?？/／★☆♪〜~]', '', 'g')"
    sql["browse_filter_sort_page"] = f"""WITH {WORKS}, {CREDITS} SELECT work_id, title, year, deviation_score, tier FROM (SELECT *, {DEV} AS deviation_score, {ladder(DEV, SCORE)} AS tier FROM works
      WHERE year BETWEEN 1990 AND 1999 AND (contains({client('title')}, '0001') OR contains({client('title_en')}, '0001') OR work_id IN (SELECT work_id FROM credits WHERE contains({client('name')}, '0001')))) ORDER BY deviation_score DESC, ord LIMIT 10 OFFSET 10"""
    sql["merge_works"] = f"""WITH {WORKS}, new AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN work_id ELSE 'n' || work_id END AS work_id, 'New ' || title AS title, year FROM works WHERE ord % 7 = 0)
      SELECT coalesce(o.ord, (SELECT max(ord) FROM works) + n.ord) AS ord, coalesce(o.work_id, n.work_id) AS work_id, coalesce(n.title, o.title) AS title, coalesce(n.year, o.year) AS year FROM works o FULL OUTER JOIN new n ON o.work_id = n.work_id"""
    sql["append_ratings"] = f"WITH {RATINGS}, both_ AS (SELECT * FROM ratings UNION ALL SELECT * FROM ratings WHERE score > 90) SELECT item_id, count(*) AS n, {rnd('sum(score)', 4)} AS total FROM both_ GROUP BY item_id"
    sql["first_wins_dedupe"] = f"WITH {CREDITS} SELECT name, work_ord, role FROM credits QUALIFY row_number() OVER (PARTITION BY name ORDER BY work_ord, role, pos) = 1"
    sql["uncollected_filter"] = "SELECT anilist_id FROM (SELECT DISTINCT anilist_id FROM anilist_client) WHERE anilist_id NOT IN (SELECT anilist_id FROM anime_metadata WHERE coalesce(bangumi_id, 0) <> 0 AND anilist_id IS NOT NULL) ORDER BY anilist_id LIMIT 50"
    sql["person_works"] = f"WITH {CREDITS} SELECT name, work_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM credits GROUP BY name, work_id"
    sql["regression_metrics"] = f"""WITH {WORKS}, d AS (SELECT z AS t, {rnd('z * 0.8 + year / 1000.0', 6)} AS p FROM works),
      r AS (SELECT t, p, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS rt, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM d)
      SELECT {rnd('sqrt(avg((t - p) * (t - p)))', 6)} AS rmse, {rnd(xsum('abs(t - p)') + ' / count(*)', 6)} AS mae, {rnd('1 - sum((t - p) * (t - p)) / (count(*) * var_pop(t))', 6)} AS r2, {rnd('corr(t, p)', 6)} AS pearson, {rnd('corr(rt, rp)', 6)} AS spearman FROM r"""
    team = f"team AS (SELECT role, min(name) AS name FROM credits GROUP BY role), known AS (SELECT name, count(*) AS n, CAST(sum(CAST(z AS DECIMAL(20,9))) AS DOUBLE) AS sum_z, max(z) AS max_z FROM (SELECT DISTINCT work_id, name FROM credits WHERE role <> 'studio') JOIN works USING (work_id) WHERE year < 2000 GROUP BY name), tk AS (SELECT role, coalesce(n, 0) AS n, coalesce(sum_z, 0.0) AS sum_z, max_z FROM team LEFT JOIN known USING (name))"
    one = {
        "genga_weighted_s": "max(CASE WHEN role = 'genga' THEN sum_z / (n + 6.0) END)", "genga_top_density": "max(CASE WHEN role = 'genga' AND sum_z / (n + 6.0) > 0.4 THEN 1.0 ELSE 0.0 END)",
        "genga_max_s": "max(CASE WHEN role = 'genga' THEN sum_z / (n + 6.0) END)", "genga_total_count": "1.0", "genga_experienced_ratio": "max(CASE WHEN role = 'genga' AND n > 0 THEN 1.0 ELSE 0.0 END)", "genga_sum_weights": "0.5",
    }
    for r in MAIN:
        m = 4.0 if r in ("unit_director", "sakkan", "art_dir") else 2.0
        one |= {f"{r}_bayesian_s": f"max(CASE WHEN role = '{r}' AND n > 0 THEN sum_z / (n + {m}) END)", f"{r}_mean_z": f"max(CASE WHEN role = '{r}' AND n > 0 THEN sum_z / n END)", f"{r}_max_z": f"max(CASE WHEN role = '{r}' THEN max_z END)", f"{r}_past_count": f"max(CASE WHEN role = '{r}' THEN CAST(n AS DOUBLE) END)"}
    sql["custom_features"] = f"WITH {WORKS}, {CREDITS}, {team} SELECT {', '.join(rnd(f'coalesce({x}, 0.0)', 6) + f' AS {k}' for k, x in one.items())} FROM tk"
    quality = sql["regression_metrics"]
    sql["status"] = f"WITH {WORKS}, {RATINGS}, q AS ({quality}) SELECT (SELECT count(*) FROM works) AS works_count, (SELECT count(*) FROM ratings) AS ratings_count, (SELECT {rnd(xsum('score') + ' / count(*)', 2)} FROM ratings) AS global_mean, q.*, 'ready' AS status FROM q"
    features = (*GENGA_COLUMNS, *[f"{r}_{c}" for r in MAIN for c in ROLE_COLUMNS])
    weights = ", ".join(f"('{f}', {k % 5}.0)" for k, f in enumerate(features))
    sql["fallback_attribution"] = f"WITH {WORKS}, w(feature, v) AS (VALUES {weights}) SELECT work_id, feature, {rnd(f'CAST(v AS DOUBLE) / ({float(sum(k % 5 for k in range(len(features))))} + 1e-6) * (z - 0.25)', 7)} AS shap FROM works, w"
    sql["shap_adds_up"] = "SELECT '' AS work_id WHERE false"
    shown = "((" + DEV + " - 50.0) / 10.0)"
    sql["client_tiers"] = f"WITH {WORKS}, c AS (SELECT work_id, {shown} AS z FROM works) SELECT work_id, CASE WHEN {top} < 0.1 THEN '< 0.1%' ELSE printf('%.1f', {top}) || '%' END AS top, {rnd('z', 2)} AS z FROM c"
    # the catalogue's own documents
    meta = """rw AS (SELECT DISTINCT coalesce(TRY_CAST(regexp_extract(work_id, '([0-9]+)$', 1) AS BIGINT), 0) AS ord, work_id, coalesce(title, work_id) AS title, coalesce(title_en, '') AS title_en, coalesce(year, 0) AS year,
      coalesce(year, 2020) AS listed_year, anilist_mean_score AS raw_score, format, episodes FROM anime_metadata)"""
    sql["real_works"] = f"WITH {meta} SELECT * FROM rw"
    flat = sql["p5_credits"]
    real = lambda where="": f"""rc AS (SELECT DISTINCT coalesce(TRY_CAST(regexp_extract(work_id, '([0-9]+)$', 1) AS BIGINT), 0) AS work_ord, work_id, role, CAST(pos AS INTEGER) AS pos, name,
      CASE WHEN role = 'genga' THEN coalesce(rank, CAST(greatest(pos, 1) AS DOUBLE)) ELSE 1.0 END AS rank, CASE WHEN role = 'genga' THEN coalesce(ep_ratio, 1.0) ELSE 1.0 END AS ep_ratio FROM ({flat}) WHERE ep_pos = 0 {where})"""  # noqa: E731
    sql["real_credits"] = f"WITH {real()} SELECT * FROM rc"
    zs = f"""{meta}, ok AS (SELECT * FROM rw WHERE raw_score IS NOT NULL AND NOT isnan(raw_score) AND year > 0), mean AS (SELECT {xsum('raw_score')} / count(*) AS m FROM ok),
      dated AS (SELECT work_id, year, raw_score - m AS b FROM ok, mean), {years('dated')}, rz AS (SELECT work_id, {rnd(z, 6)} AS z FROM dated JOIN stats USING (year))"""
    sql["real_z"] = f"WITH {zs} SELECT work_id, {rnd('z', 5)} AS z FROM rz"
    recs = f"""{real('AND pos > 0')}, recs AS (SELECT c.name, role, w.work_id, w.title, w.year, rz.z, rank, ep_ratio, struct_pack(w := work_ord, r := list_position({list(STAFF)}, role), p := pos) AS ord
      FROM rc c JOIN rw w ON w.work_id = c.work_id JOIN rz ON rz.work_id = w.work_id WHERE role <> 'studio')"""
    sql["real_staff_records"] = f"WITH {zs}, {recs} SELECT name, role, work_id, year, {rnd('z', 5)} AS z, rank, ep_ratio FROM recs"
    sql["real_leaderboard_all"] = f"SELECT name, works_count, rank, total_count FROM ({board(None, limit=1000, head=f'WITH {zs}, {recs}')})"
    as_credits = f"{real()}, credits AS (SELECT * FROM rc), works AS (SELECT rw.*, rz.z FROM rw JOIN rz USING (work_id))"
    wide4 = wide.replace("1e6", "1e4")
    sql["real_feature_matrix"] = f"WITH {zs}, {as_credits}, {PAST}, {GENGA}, {ROLE} SELECT works.work_id, works.year, {gg.replace('1e6', '1e4')}, {wide4} FROM works LEFT JOIN gf ON gf.work_id = works.work_id LEFT JOIN rf ON rf.work_id = works.work_id GROUP BY works.work_id, works.year"
    items = lambda r, is_map: f"CASE coalesce(json_type(ep, '$.{r}'), 'NULL') WHEN 'ARRAY' THEN json_array_length(ep, '$.{r}') WHEN 'OBJECT' THEN {f'len(json_keys(ep, {chr(39)}$.{r}{chr(39)}))' if is_map else '1'} WHEN 'VARCHAR' THEN 1 ELSE 0 END"
    sql["p5_episodes"] = NESTED + f"SELECT DISTINCT work_id, ep_pos, CAST(json_extract(ep, '$.ep_num') AS BIGINT) AS ep_num, CAST({items('genga', True)} AS BIGINT) AS n_genga, CAST({items('sakkan', False)} AS BIGINT) AS n_sakkan FROM eps"
    eras = ", ".join(f"({k}, {a}, {b}, {p * store.PER_PAGE})" for k, (a, b, p) in enumerate(store.ERAS))
    top = store.POPULAR_PAGES * store.PER_PAGE
    era_sql = f"""WITH e AS (SELECT DISTINCT anilist_id, year, coalesce(popularity, -1) AS popularity, mean_score, average_score, format, episodes, CASE WHEN year > 0 THEN year * 10000 + 701 END AS s FROM anilist_client WHERE anilist_id IS NOT NULL),
      x(era, a, b, m) AS (VALUES {eras}),
      o AS (SELECT e.*, era, row_number() OVER (PARTITION BY era ORDER BY popularity DESC, anilist_id) AS nth, m FROM e JOIN x ON s > a AND s < b),
      p AS (SELECT e.*, {len(store.ERAS)} AS era, row_number() OVER (ORDER BY popularity DESC, anilist_id) AS nth, {top} AS m FROM e),
      u AS (SELECT * FROM o WHERE nth <= m UNION ALL SELECT * FROM p WHERE nth <= m),
      r AS (SELECT CAST(era * 100000 + nth AS INTEGER) AS place, anilist_id, coalesce(nullif(year, 0), CASE WHEN era < {len(store.ERAS)} THEN 2000 ELSE 2020 END) AS year, coalesce(format, 'TV') AS format, coalesce(episodes, 12) AS episodes,
        coalesce(mean_score, average_score, 75.0) AS mean_score, coalesce(average_score, 75.0) AS average_score FROM u QUALIFY row_number() OVER (PARTITION BY anilist_id ORDER BY era, nth) = 1)"""
    sql["era_catalogue"] = f"{era_sql} SELECT * FROM r"
    sql["popular_entries"] = f"{era_sql} SELECT place, anilist_id, year FROM r ORDER BY place LIMIT 100"
    sql["title_aliases"] = """WITH t AS (SELECT DISTINCT work_id AS q_id, title AS query FROM anime_metadata WHERE title IS NOT NULL), a AS (SELECT DISTINCT canonical, alias FROM (SELECT title_native AS canonical, unnest(synonyms) AS alias FROM anilist_client WHERE title_native IS NOT NULL) WHERE trim(alias, ' ') <> ''),
      g AS (SELECT canonical, alias AS form FROM a UNION SELECT canonical, canonical FROM a) SELECT q_id, query FROM t UNION SELECT t.q_id, g2.form FROM t JOIN g g1 ON t.query = g1.form JOIN g g2 ON g2.canonical = g1.canonical"""
    sql["united_names"] = f"""WITH c AS ({flat}), f AS (SELECT work_id, name, min(struct_pack(e := ep_pos, p := pos)) AS o FROM c WHERE role = 'genga' GROUP BY work_id, name),
      w AS (SELECT DISTINCT work_id FROM c WHERE role = 'genga') SELECT w.work_id, coalesce(string_agg(name, '|' ORDER BY o, name), '') AS names FROM w LEFT JOIN f ON f.work_id = w.work_id AND length(name) >= 2 GROUP BY w.work_id"""
    # texts
    white = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    kana = (text.KATAKANA, text.HIRAGANA)
    client_ = lambda c: f"regexp_replace(translate(translate(translate(lower({c}), {quote(text.FULL_WIDTH)}, {quote(text.HALF_WIDTH)}), '{kana[0]}', '{kana[1]}'), 'ゑゐをゔ', 'えいおぶ'), '[{white}\\x{{feff}}\\-_・:：,，.．!！?？/／★☆♪〜~]', '', 'g')"
    no_media = lambda c: f"regexp_replace(regexp_replace({c}, '[\\(（\\[【].*?[\\)）\\]】]', ' ', 'g'), '^(劇場版|映画|アニメ|TVアニメ|OVA)[{white}]*', '')"
    candidate_ = lambda c: f"lower(trim(regexp_replace(translate({no_media(c)}, '／～☆★', '/~'), '[{white}:\\-_・]+', ' ', 'g'), ' '))"
    stop = "[" + ", ".join(quote(w) for w in text.SUBTITLE_STOP) + "]"
    words = lambda c: f"list_filter(regexp_extract_all({c}, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9faf}}0-9a-zA-Z]{{2,}}(?:篇|編|巻|期)?'), lambda w : NOT list_contains({stop}, lower(w)))"
    titles = "t AS (SELECT DISTINCT title FROM (SELECT title FROM anime_metadata UNION ALL SELECT title_native FROM anilist_client) WHERE title IS NOT NULL)"
    sql["text_forms"] = f"WITH {titles} SELECT title, {client_('title')} AS client, {candidate_('title')} AS candidate, array_to_string({words('title')}, ' ') AS subtitles FROM t"
    search_ = f"translate(translate(lower(title), '{text.ARCHAIC[0]}{text.IGNORED}', '{text.ARCHAIC[1]}'), '{kana[1]}', '{kana[0]}')"
    note = "[\\(（\\[【][^()（）\\[\\]【】]*?(?:\\d{4}|年|第\\d|期|TV|放送|版)[^()（）\\[\\]【】]*?[\\)）\\]】]"
    form_ = f"lower(regexp_replace(translate(regexp_replace(title, '{note}', '', 'g'), '{kana[0]}', '{kana[1]}'), '[・★☆◆◇♪!！?？:：\\-—_~～''\"`「」『』{white}]+', '', 'g'))"
    sql["search_forms"] = f"WITH {titles} SELECT title, {search_} AS search, {form_} AS form FROM t WHERE regexp_full_match(title, '[\\x20-\\x7e\\x{{3001}}-\\x{{3015}}\\x{{3041}}-\\x{{3094}}\\x{{30a1}}-\\x{{30fe}}\\x{{4e00}}-\\x{{9fff}}]*')"
    near = "(contains(n, q) OR contains(q, n) OR contains(cn, q) OR contains(q, cn))"
    short_ = "(coalesce(format IN ('MOVIE', 'OVA', 'SPECIAL'), false) OR eps = 1)"
    series_ = "(coalesce(format = 'TV', false) OR eps >= 10)"
    film_ = "(contains(c_name, '劇場版') OR contains(c_name, '映画'))"
    sql["candidate_scoring"] = f"""WITH qs AS (SELECT DISTINCT work_id AS q_id, title, year, episodes, format FROM anime_metadata WHERE title IS NOT NULL),
      cs AS (SELECT DISTINCT anilist_id AS c_id, title_native AS c_name, coalesce(title_english, '') AS c_name_cn, CASE WHEN year > 0 THEN year END AS cy, episodes AS c_eps FROM anilist_client WHERE title_native IS NOT NULL),
      held AS (SELECT DISTINCT *, lower(unnest({words('c_name')})) AS word FROM cs), often AS (SELECT word, count(*) AS df FROM held GROUP BY word),
      asked AS (SELECT DISTINCT *, lower(unnest({words('title')})) AS word FROM qs),
      rare AS (SELECT a.* FROM asked a JOIN often USING (word) QUALIFY row_number() OVER (PARTITION BY q_id, title, year, episodes, format ORDER BY df, word) = 1),
      pairs AS (SELECT *, {candidate_('title')} AS q, {candidate_('c_name')} AS n, {candidate_('c_name_cn')} AS cn, coalesce(episodes, 0) AS eps, coalesce(c_eps, 0) AS ce, lower(trim(title, ' ')) AS raw, {words('title')} AS subs FROM rare JOIN held USING (word)),
      scored AS (SELECT q_id, c_id, CASE WHEN q <> '' AND (q = n OR q = cn) THEN 70.0 WHEN q <> '' AND {near} THEN 40.0 WHEN contains(lower(c_name), raw) OR contains(raw, lower(c_name)) THEN 30.0 ELSE 0.0 END
        + coalesce(list_sum(list_transform(subs, lambda s : CASE WHEN contains(c_name, s) OR (c_name_cn <> '' AND contains(c_name_cn, s)) THEN 35.0 ELSE -20.0 END)), 0.0)
        + CASE WHEN coalesce(year, 0) = 0 THEN 0.0 WHEN cy IS NULL THEN -5.0 WHEN abs(cy - year) = 0 THEN 60.0 WHEN abs(cy - year) = 1 THEN 30.0 WHEN abs(cy - year) = 2 THEN 5.0 ELSE -50.0 * abs(cy - year) END
        + CASE WHEN {short_} THEN CASE WHEN ce > 4 THEN -60.0 WHEN ce = 1 THEN 20.0 ELSE 0.0 END + CASE WHEN {film_} OR contains(c_name, 'OVA') THEN 25.0 ELSE 0.0 END ELSE 0.0 END
        + CASE WHEN {series_} THEN CASE WHEN ce = 1 AND {film_} THEN -60.0 WHEN eps > 0 AND ce > 0 AND eps = ce THEN 30.0 WHEN eps > 0 AND ce > 0 AND abs(eps - ce) <= 2 THEN 15.0 ELSE 0.0 END ELSE 0.0 END AS score FROM pairs)
      SELECT q_id, c_id, CAST(score AS DOUBLE) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id) = 1 AND score >= 40"""
    clean = lambda c: f"(regexp_full_match({c}, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}} A-Za-z]{{2,10}}') AND NOT regexp_matches(lower({c}), '{'|'.join(wiki.NO_NAME)}') AND NOT regexp_matches({c}, '{'|'.join(wiki.NO_PERSON)}'))"
    sql["clean_names"] = f"SELECT DISTINCT trim(n, ' ') AS name FROM leaderboards WHERE trim(n, ' ') <> '' AND {clean('trim(n, chr(32))')}"
    quoted = "[*＊][0-9]+|\\[.*?\\]|（.*?）|\\(.*?\\)|「.*?」|『.*?』"
    sql["split_names"] = f"""SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS name FROM (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(title, '{quoted}', '', 'g'), '[\\s\\x{{0b}}\\x{{3000}}、,，/／・&＆]+'), lambda p : {clean('p')}) AS l
      FROM (SELECT DISTINCT page_id, title FROM seesaa_client WHERE title IS NOT NULL))"""
    relations = ", ".join(f"({k}, {quote(a)}, {quote(b)})" for k, (a, b) in enumerate(matching.RELATION_ROLES.items()))
    names_ = list(matching.RELATION_ROLES) + ["其他"]
    sql["relation_roles"] = f"""WITH {CREDITS}, m(k, relation, role) AS (VALUES {relations}), g AS (SELECT work_ord AS subject_id, name, (pos * 10 + length(role)) * 100 + ascii(role) % 100 AS ord,
      [{', '.join(quote(x) for x in names_)}][CAST((CAST(rank AS INTEGER) + work_ord + pos) % {len(names_)} + 1 AS INTEGER)] AS relation FROM credits),
      f AS (SELECT subject_id, name, ord, min(relation) AS relation FROM g GROUP BY subject_id, name, ord)
      SELECT subject_id, m.role, name, CASE WHEN relation = '第二原画' THEN 0.5 ELSE 1.0 END AS ep_ratio FROM f JOIN m USING (relation) WHERE trim(name) <> '' QUALIFY row_number() OVER (PARTITION BY subject_id, m.role, name ORDER BY ord) = 1"""
    sql["page_lines"] = r"SELECT doc_id, line_no, line FROM (SELECT doc_id, generate_subscripts(l, 1) AS line_no, trim(unnest(l), ' ') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE line <> ''"
    sql["animator_participation"] = f"""WITH {CREDITS}, g AS (SELECT work_ord AS page_id, CAST(rank AS INTEGER) AS ep, pos, name FROM credits WHERE role = 'genga'), e AS (SELECT page_id, count(DISTINCT ep) AS k FROM g GROUP BY page_id)
      SELECT g.page_id, name, floor(avg(pos) * 100 + 0.5) / 100 AS rank, floor(count(DISTINCT ep) / CAST(greatest(max(k), 12, 1) AS DOUBLE) * 1000 + 0.5) / 1000 AS ep_ratio FROM g JOIN e ON g.page_id = e.page_id GROUP BY g.page_id, name"""
    sql["export_leaderboards"] = f"{BOARDS} SELECT * FROM boards"
    tier_of = person_tier("rating_rank", "role_total")
    listed = lambda r: f"coalesce((SELECT string_agg(concat_ws('|', trim(c.name), " + ("NULL" if r == "studio" else "coalesce(t.rt, '-'), coalesce(t.ct, '-')") + f"), ',' ORDER BY pos) FROM credits c LEFT JOIN tiers t ON t.role = c.role AND t.name = c.name WHERE c.work_id = k.work_id AND c.role = '{r}'" + (" AND pos <= 15" if r == "genga" else "") + f"), '') AS {r}"
    sql["export_works"] = f"""{ranked}, tiers AS (SELECT role, name, {tier_of} AS rt, {person_tier('cumulative_rank', 'role_total')} AS ct FROM rranks), k AS (SELECT *, CAST(row_number() OVER (ORDER BY {rnd('z', 9)} DESC, ord) AS INTEGER) AS rank_, CAST(row_number() OVER (ORDER BY {rnd('raw_score', 9)} DESC, ord) AS INTEGER) AS raw_rank, count(*) OVER () AS total FROM works)
      SELECT work_id, title, title_en, year, {DEV} AS deviation_score, rank_ AS deviation_rank, {rnd('raw_score', 1)} AS raw_score, raw_rank, {ladder(DEV, SCORE)} AS tier, {rnd('rank_ / CAST(total AS DOUBLE) * 100.0', 2)} AS percentile,
      {', '.join(listed(r) for r in (*STAFF, 'studio'))} FROM k"""
    sql["export_profiles"] = f"""{BOARDS}, act AS (SELECT DISTINCT n AS name FROM boards WHERE rk <= 300 OR ck <= 300), {role_stats}
      SELECT st.name, st.total_works, st.bayesian_rating, st.career_cumulative_z, oranks.overall_rank, oranks.cumulative_rank, primary_role, {person_tier('oranks.overall_rank', 'oranks.total_staff')} AS overall_rating_tier, {person_tier('oranks.cumulative_rank', 'oranks.total_staff')} AS overall_cum_tier,
      all_role_stats, best_works, career_trajectory FROM act JOIN st USING (name) JOIN oranks USING (name) JOIN rs USING (name) JOIN bw USING (name) JOIN ct USING (name) JOIN ({chron}) USING (name)"""
    sql["export_summary"] = f"{BASE} SELECT (SELECT count(*) FROM works) AS total_works, (SELECT coalesce(min(year), 1960) FROM works WHERE year > 1900) AS year_min, (SELECT coalesce(max(year), 2026) FROM works WHERE year > 1900) AS year_max, (SELECT count(DISTINCT name) FROM recs) AS total_staff"
    return sql
