"""Flatten polymorphic nested staff documents into related flat tables.

The whole flattening is one projection: nested `transform` calls attach the ancestor keys (work, episode, role)
and the position, `flatten` joins the arrays of all roles, and one `inline` emits the rows. No shuffle is needed
before the final `distinct`.

Shapes of a role: a text; a list of texts, of objects with `name`, or both; an empty value; null; for `genga` also
a map from name to an object, a number or null.

Defined results: null documents and documents that are not valid JSON (or whose top level is no object) give no
rows; names are trimmed of U+0020 and blank names dropped, yet counted in positions; numbers, booleans and objects
without a text `name` are no names; a null key column stays null; repeated input rows give one output row; columns
of the input other than the key and the document are ignored, so they cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORK_ROLES = ("director", "series_comp", "char_design", "unit_director", "sakkan", "music", "art_dir", "studio", "genga")
EPISODE_ROLES = ("genga", "sakkan", "conte_enshutsu")
MAP_ROLES = ("genga",)

_ITEM = "struct<pos:bigint,name:string,rank:double,ep_ratio:double,relation:string>"


def _text(v: str) -> str:
    """The value of variant `v` if it is a text, else null."""
    return f"if(schema_of_variant({v}) = 'STRING', try_variant_get({v}, '$', 'string'), null)"


def _num(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'double')"


def _item(v: str, pos: str, name: str) -> str:
    return (
        f"named_struct('pos', cast({pos} as bigint), 'name', trim({name}), 'rank', {_num(v, '$.rank')}, "
        f"'ep_ratio', {_num(v, '$.ep_ratio')}, 'relation', try_variant_get({v}, '$.relation', 'string'))"
    )


def _items(v: str, is_map_role: str) -> str:
    """SQL for the items of one role value as an array of structs; null for an empty or unreadable value."""
    named = "coalesce(" + _text("variant_get(x, '$.name')") + ", " + _text("x") + ")"  # a whole object's type is costly to tell
    as_list = f"transform(try_variant_get({v}, '$', 'array<variant>'), (x, i) -> {_item('x', 'i + 1', named)})"
    as_text = f"transform(filter(array({_text(v)}), t -> t is not null), t -> {_item(v, '1', 't')})"
    entry = (
        "named_struct('pos', 0L, 'name', trim(e.key), 'rank', " + _num("e.value", "$.rank")
        + ", 'ep_ratio', coalesce(" + _num("e.value", "$.ep_ratio") + ", " + _num("e.value", "$")
        + "), 'relation', try_variant_get(e.value, '$.relation', 'string'))"
    )
    as_map = f"transform(map_entries(try_variant_get({v}, '$', 'map<string,variant>')), e -> {entry})"
    as_object = "array(" + _item(v, "1", _text(f"variant_get({v}, '$.name')")) + ")"
    return f"coalesce({as_list}, case when {v} is null or is_variant_null({v}) then null when schema_of_variant({v}) = 'STRING' then {as_text} when {is_map_role} then {as_map} else {as_object} end)"


def _roles(doc: str, roles: tuple[str, ...], ep_pos: str, ep_num: str) -> str:
    """SQL for the credits of all `roles` under variant `doc`, as one array."""
    pairs = ", ".join(f"named_struct('role', '{r}', 'is_map', {str(r in MAP_ROLES).lower()}, 'v', variant_get({doc}, '$.{r}'))" for r in roles)
    return (
        f"flatten(transform(array({pairs}), r -> transform(coalesce({_items('r.v', 'r.is_map')}, cast(array() as array<{_ITEM}>)), c -> "
        f"named_struct('ep_pos', cast({ep_pos} as bigint), 'ep_num', cast({ep_num} as bigint), 'role', r.role, 'pos', c.pos, "
        "'name', c.name, 'rank', c.rank, 'ep_ratio', c.ep_ratio, 'relation', c.relation))))"
    )


def _documents(df: DataFrame, key: str, doc: str) -> DataFrame:
    """The documents that are JSON objects: a valid text whose first sign is a brace is one."""
    objects = df.where(F.col(doc).rlike("^[ \\t\\n\\r]*\\{")).select(F.col(key).alias("work_id"), F.col(doc).alias("doc"))
    return objects.select("work_id", F.expr("try_parse_json(doc)").alias("doc")).where("doc is not null")


def flatten_credits(df: DataFrame, key: str = "work_id", doc: str = "staff") -> DataFrame:
    """Credits of all works and episodes: work_id, ep_pos, ep_num, role, pos, name, rank, ep_ratio, relation.

    `ep_pos` (place in the list of episodes, 0 outside) is the link to `flatten_episodes`.
    """
    episodes = "try_variant_get(doc, '$.episodes', 'array<variant>')"
    per_episode = (
        f"flatten(transform(coalesce({episodes}, cast(array() as array<variant>)), (ep, k) -> "
        + _roles("ep", EPISODE_ROLES, "k + 1", "try_variant_get(ep, '$.ep_num', 'bigint')")
        + "))"
    )
    all_credits = f"concat({_roles('doc', WORK_ROLES, '0', '0')}, {per_episode})"
    return (
        _documents(df, key, doc)
        .select("work_id", F.expr(f"filter({all_credits}, c -> c.name <> '')").alias("credits"))
        .selectExpr("work_id", "inline(credits)")
    )


def flatten_episodes(df: DataFrame, key: str = "work_id", doc: str = "staff") -> DataFrame:
    """Episodes of all works: work_id, ep_pos, ep_num, n_genga, n_sakkan (credited items, blank ones included)."""
    episodes = "try_variant_get(doc, '$.episodes', 'array<variant>')"
    count = lambda role: f"cast(coalesce(size({_items(f"variant_get(ep, '$.{role}')", str(role in MAP_ROLES).lower())}), 0) as bigint)"
    row = (
        "named_struct('ep_pos', cast(k + 1 as bigint), 'ep_num', try_variant_get(ep, '$.ep_num', 'bigint'), "
        f"'n_genga', greatest({count('genga')}, 0), 'n_sakkan', greatest({count('sakkan')}, 0))"
    )
    return (
        _documents(df, key, doc)
        .select("work_id", F.expr(f"transform({episodes}, (ep, k) -> {row})").alias("eps"))
        .selectExpr("work_id", "inline(eps)")
        .distinct()
    )


def found_credits(df: DataFrame, key: str = "work_id", doc: str = "staff") -> DataFrame:
    """The set of (work_id, ep_num, role, pos, name) over all documents."""
    return flatten_credits(df, key, doc).select("work_id", "ep_num", "role", "pos", "name").distinct()
