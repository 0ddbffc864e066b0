"""Fuzzy title similarity, candidate scoring and mapping of relations to roles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orizuru.functions import text
from orizuru.session import cut

#: Relations of the outer source and the role they stand for.
RELATION_ROLES = {
    "总导演": "director", "导演": "director", "系列构成": "series_comp", "脚本": "series_comp", "人物设定": "char_design", "人物原案": "char_design",
    "总作画监督": "sakkan", "作画监督": "sakkan", "动作作画监督": "sakkan", "机械作画监督": "sakkan", "角色作画监督": "sakkan",
    "原画": "genga", "第二原画": "genga", "分镜": "unit_director", "演出": "unit_director", "副导演": "unit_director",
    "音乐": "music", "美术监督": "art_dir", "美术设计": "art_dir", "背景美术": "art_dir", "动画制作": "studio",
}


def relation_roles(persons: DataFrame) -> DataFrame:
    """persons (subject_id, ord, name, relation) -> (subject_id, role, name, ep_ratio, ord): the first of each name in a
    role; second key animation counts half, and a name has one key animation entry whichever came first."""
    mapping = F.create_map(*[F.lit(x) for pair in RELATION_ROLES.items() for x in pair])
    rows = persons.withColumn("role", mapping[F.col("relation")]).where(F.col("role").isNotNull() & (F.trim("name") != ""))
    rows = rows.withColumn("ep_ratio", F.when(F.col("relation") == "第二原画", 0.5).otherwise(1.0))
    first = rows.groupBy("subject_id", "role", "name").agg(F.min_by(F.struct("ep_ratio", "ord"), "ord").alias("f"))
    return first.select("subject_id", "role", "name", "f.ep_ratio", "f.ord")


def _indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length), from the longest common subsequence (bit-parallel)."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    common = len(a) - bin(s).count("1")
    return 100.0 * 2 * common / (len(a) + len(b))


def similarity(a: str, b: str, least: float = 0.0) -> float:
    """Composite similarity of two titles in title form: equal, containment, or weighted ratio and best window. Where
    `least` can't be reached any more, the best window is left out."""
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    short, long_ = sorted((a, b), key=len)
    share = len(short) / len(long_)
    if short in long_ and share > 0.6:
        return 90.0 + 10.0 * share
    ratio = _indel_ratio(a, b)
    if 0.8 * ratio + 20.0 < least:
        return 0.8 * ratio
    partial = max(_indel_ratio(short, long_[i : i + len(short)]) for i in range(-len(short) + 1, len(long_)) if i >= 0) if short else 0.0
    return 0.5 * ratio + 0.3 * ratio + 0.2 * partial


BLOCK, BLOCK_TITLES = 4096, 8192  # forms that meet at once
BUCKETS = 256
ROWS = 256  # queries of a block scored at once


def _least_common(la: int, lb: np.ndarray, threshold: float) -> np.ndarray:
    """The fewest common letters in order with which titles of lengths `la` and `lb` can reach the threshold; beyond both
    lengths where they can't. A best window holds no more of them than the titles do."""
    short, long_ = np.minimum(la, lb), np.maximum(la, lb)
    m = np.arange(1, int(short.max(initial=0)) + 1)[:, None]
    enough = 160.0 * m / (la + lb) + 40.0 * m / (short + m) >= threshold - 1e-6
    enough |= (m == short) & (short > 0.6 * long_) & (90.0 + 10.0 * short / long_ >= threshold)  # one title within the other
    return np.where((enough & (m <= short)).any(axis=0), enough.argmax(axis=0) + 1, la + lb + 1)


class _Forms:
    """Title forms as code points, with how many letters of each fall into each bucket: a letter counts apart the second
    time, the third time and so on, so that two forms have at most as many letters in common as their products add up to."""

    def __init__(self, forms: list[str]):
        self.forms, self.size = forms, np.array([len(f) for f in forms])
        self.codes = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.row = np.repeat(np.arange(len(forms)), self.size)
        self.start = np.cumsum(self.size) - self.size
        order = np.argsort(self.row << 32 | self.codes, kind="stable")
        key = (self.row << 32 | self.codes)[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        turn = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        token = (self.codes[order] * 0x9E3779B1 + turn * 0x85EBCA77 >> 7) % BUCKETS
        self.counts = np.bincount(self.row[order] * BUCKETS + token, minlength=len(forms) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)


def _letters(q: _Forms, t: _Forms) -> tuple[np.ndarray, np.ndarray, int]:
    """The codes of both as numbers of their letters, one number more at the end of the second that stands for none."""
    alphabet, letter = np.unique(np.concatenate([q.codes, t.codes]), return_inverse=True)
    return letter[: len(q.codes)], np.append(letter[len(q.codes) :], len(alphabet)), len(alphabet) + 1


def _common(q: _Forms, at: np.ndarray, t: _Forms, to: np.ndarray, letters: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Lengths of the longest common subsequences of the pairs (at, to), bit-parallel; of queries of at most 64 letters."""
    mine, other, different = letters
    rows, at = np.unique(at, return_inverse=True)
    masks = np.zeros((len(rows), different), np.uint64)
    for k, r in enumerate(rows):
        place = np.arange(q.size[r], dtype=np.uint64)
        np.bitwise_or.at(masks[k], mine[q.start[r] : q.start[r] + q.size[r]], np.uint64(1) << place)
    out = np.zeros(len(at), np.int64)
    for lo in range(0, len(at), 1 << 16):
        k, j = at[lo : lo + (1 << 16)], to[lo : lo + (1 << 16)]
        full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - q.size[rows[k]]).astype(np.uint64)
        s = full.copy()
        for i in range(int(t.size[j].max())):
            u = s & masks[k, other[np.where(i < t.size[j], t.start[j] + i, len(other) - 1)]]
            s = (s + u | s - u) & full
        out[lo : lo + (1 << 16)] = q.size[rows[k]] - np.bitwise_count(s)
    return out


def best_of_block(queries: list[str], titles: list[str], ids: list[int], threshold: float) -> list[tuple[str, float, int]]:
    """(query, score, id) of the best title of each query that reaches the threshold, the smallest id among equals. No
    pair is left out that could: those whose letters, then those whose letters in order, are too few, can't."""
    q, t = _Forms(queries), _Forms(titles)
    order, least, letters = np.argsort(q.size, kind="stable"), {}, _letters(q, t)
    best: dict[int, tuple[float, int]] = {}
    lengths, of = np.unique(t.size, return_inverse=True)
    for size in np.unique(q.size).tolist():
        least[size] = _least_common(size, lengths, threshold)[of]
    for size in least:
        same = order[q.size[order] == size]
        able = np.flatnonzero(least[size] <= size)
        if not len(able):
            continue
        others = t.counts[able].T
        for lo in range(0, len(same), ROWS):
            some = same[lo : lo + ROWS]
            i, j = np.nonzero(q.counts[some] @ others >= least[size][able].astype(np.float32))
            i, j = some[i], able[j]
            common = _common(q, i, t, j, letters) if size <= 64 and len(i) else np.minimum(size, t.size[j])
            keep = common >= least[size][j]
            i, j, m = i[keep], j[keep], common[keep]
            short = np.minimum(size, t.size[j])
            bound = np.where(m == short, 100.0, 160.0 * m / (size + t.size[j]) + 40.0 * m / (short + m))
            for k in np.lexsort((-bound, i)).tolist():
                score, tid = best.get(int(i[k]), (threshold, None))
                if bound[k] < score - 1e-6:
                    continue
                new, nid = similarity(queries[i[k]], titles[j[k]], score), ids[j[k]]
                if new > score or new == score and (tid is None or nid < tid):
                    best[int(i[k])] = new, nid
    return [(queries[i], score, tid) for i, (score, tid) in best.items()]


def _blocks(forms: DataFrame, n: int, name: str, *columns: str) -> DataFrame:
    return forms.withColumn(name, F.pmod(F.xxhash64(columns[0]), F.lit(n)).cast("int")).groupBy(name).agg(F.collect_list(F.struct(*columns)).alias(f"{name}s"))


def best_titles(queries: DataFrame, titles: DataFrame, threshold: float = 70.0) -> DataFrame:
    """queries (q_id, query) x titles (t_id, title) -> (q_id, t_id, score): the best title of each query, if it
    reaches the threshold. Equal forms meet as such; what has no equal meets all titles, block by block, in arrays. Every
    pair that can reach the threshold by its letters is scored, so nothing is lost; forms meet once, however often they occur."""
    q = queries.select("q_id", text.title_form(F.col("query")).alias("a")).where("a <> ''")
    t = titles.select("t_id", text.title_form(F.col("title")).alias("b")).where("b <> ''")
    q, forms = cut(q), cut(t.groupBy("b").agg(F.min("t_id").alias("t_id")))  # equal forms score alike; the smallest id stands for them
    equal = q.join(forms, F.col("a") == F.col("b")).select("q_id", "t_id", F.lit(100.0).alias("score"))
    asked = cut(q.select("a").distinct().join(forms, F.col("a") == F.col("b"), "left_anti"))
    n, m, cores = asked.count(), forms.count(), q.sparkSession.sparkContext.defaultParallelism
    parts = -(-m // BLOCK_TITLES) or 1
    own = max(-(-n // BLOCK), min(n, -(-3 * cores // parts))) or 1
    tid = forms.schema["t_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, others in zip(batch.column("qs"), batch.column("ts")):
                mine, others = mine.values, others.values
                found = best_of_block(mine.field("a").to_pylist(), others.field("b").to_pylist(), others.field("t_id").to_pylist(), threshold)
                ids = others.field("t_id").type
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in ((0, pa.string()), (1, pa.float64()), (2, ids))], names=["a", "score", "t_id"])

    left = _blocks(asked, own, "q", "a").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = left.join(_blocks(forms, parts, "t", "b", "t_id"), "t").repartition(max(1, min(own * parts, max(3 * cores, own * parts // 8))), "q", "t")
    near = met.select("qs", "ts").mapInArrow(run, f"a string, score double, t_id {tid}")
    near = near.groupBy("a").agg(F.max_by(F.struct("t_id", "score"), F.struct("score", -F.col("t_id"))).alias("m"))
    best = equal.unionByName(q.join(near, "a").select("q_id", "m.t_id", "m.score"))
    best = best.groupBy("q_id").agg(F.max_by(F.struct("t_id", "score"), F.struct("score", -F.col("t_id"))).alias("m"))
    return best.select("q_id", "m.t_id", F.floor(F.col("m.score") * 100 + 0.5).alias("score_pct"))


def search_candidates(queries: DataFrame, entries: DataFrame, query: str = "title", name: str = "c_name") -> DataFrame:
    """All pairs of a query with the entries that hold its rarest word (of those that occur among the entries; the first
    by code point among equally rare ones), as a search by title finds them. A query without such a word has none."""
    words = lambda c: F.explode(F.array_distinct(F.transform(text.subtitles(F.col(c)), F.lower)))
    held = entries.select("*", words(name).alias("word"))
    often = held.groupBy("word").agg(F.count("*").alias("df"))
    asked = queries.select("*", words(query).alias("word")).join(often, "word")
    rarest = asked.groupBy(*queries.columns).agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    return rarest.join(held, "word").drop("word")


def score_candidates(pairs: DataFrame, strict_empty: bool = False, accept: float = 40.0) -> DataFrame:
    """pairs (q_id, title, year, episodes, format, c_ord, c_id, c_name, c_name_cn, c_date, c_eps) -> the best candidate
    of each query with its score, the first among equals; none below `accept`.

    An empty Chinese name is contained in every query, as in the source this restates, unless `strict_empty`.
    """
    q, n, cn = text.candidate_form(F.col("title")), text.candidate_form(F.col("c_name")), text.candidate_form(F.col("c_name_cn"))
    rows = pairs.select("*", q.alias("q"), n.alias("n"), cn.alias("cn"), text.subtitles(F.col("title")).alias("subs"), text.year_of_date(F.col("c_date")).alias("cy"))
    has = F.col("q") != ""
    near = F.contains("n", "q") | F.contains("q", "n") | F.contains("cn", "q") | F.contains("q", "cn")
    if strict_empty:
        near = F.contains("n", "q") | ((F.col("n") != "") & F.contains("q", "n")) | F.contains("cn", "q") | ((F.col("cn") != "") & F.contains("q", "cn"))
    raw, low = F.lower(F.trim("title")), F.lower("c_name")
    title = F.when(has & ((F.col("q") == F.col("n")) | (F.col("q") == F.col("cn"))), 70.0).when(has & near, 40.0).when(F.contains(low, raw) | F.contains(raw, low), 30.0).otherwise(0.0)
    sub = F.aggregate("subs", F.lit(0.0), lambda acc, s: acc + F.when(F.contains(F.col("c_name"), s) | ((F.col("c_name_cn") != "") & F.contains(F.col("c_name_cn"), s)), 35.0).otherwise(-20.0))
    diff = F.abs(F.col("cy") - F.col("year"))
    year = F.when(F.coalesce("year", F.lit(0)) == 0, 0.0).when(F.col("cy").isNull(), -5.0).when(diff == 0, 60.0).when(diff == 1, 30.0).when(diff == 2, 5.0).otherwise(-50.0 * diff)
    eps, ceps = F.coalesce("episodes", F.lit(0)), F.coalesce("c_eps", F.lit(0))
    short = F.coalesce(F.col("format").isin("MOVIE", "OVA", "SPECIAL"), F.lit(False)) | (eps == 1)
    series = F.coalesce(F.col("format") == "TV", F.lit(False)) | (eps >= 10)
    film = F.contains("c_name", F.lit("劇場版")) | F.contains("c_name", F.lit("映画"))
    kind = F.when(short, F.when(ceps > 4, -60.0).when(ceps == 1, 20.0).otherwise(0.0) + F.when(film | F.contains("c_name", F.lit("OVA")), 25.0).otherwise(0.0)).otherwise(0.0)
    length = F.when(series, F.when((ceps == 1) & film, -60.0).when((eps > 0) & (ceps > 0) & (eps == ceps), 30.0).when((eps > 0) & (ceps > 0) & (F.abs(eps - ceps) <= 2), 15.0).otherwise(0.0)).otherwise(0.0)
    scored = rows.withColumn("score", title + sub + year + kind + length)
    best = scored.groupBy("q_id").agg(F.max_by(F.struct("c_id", "score"), F.struct("score", -F.col("c_ord"))).alias("b"))
    return best.where(F.col("b.score") >= accept).select("q_id", "b.c_id", "b.score")


def with_aliases(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """titles (q_id, query) with further rows for each alias of the same work; aliases (canonical, alias)."""
    group = aliases.select("canonical", F.col("alias").alias("form")).unionByName(aliases.select("canonical", F.col("canonical").alias("form"))).distinct()
    known = titles.join(group, titles["query"] == group["form"]).select("q_id", "canonical")
    more = known.join(group, "canonical").select("q_id", F.col("form").alias("query"))
    return titles.select("q_id", "query").unionByName(more).distinct()
