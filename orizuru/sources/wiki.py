"""Staff and episode credits of wiki pages.

A page's lines are scanned once, in Python, since the meaning of a line depends on the headers before it; everything
after the scan (ranks, participation, order-preserving unions) is built in.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role headers of pages and the roles they feed.
HEADERS = {
    "監督": "director", "総監督": "director", "シリーズ構成": "series_comp", "脚本": "series_comp", "キャラクターデザイン": "char_design", "総作画監督": "sakkan", "作画監督": "sakkan",
    "絵コンテ": "conte_enshutsu", "演出": "conte_enshutsu", "音楽": "music", "美術監督": "art_dir", "原画": "genga", "アニメーション制作": "studio", "制作": "studio",
}
#: Headers that end a role without feeding one.
RESET = ("第二原画", "動画", "仕上", "背景", "撮影", "編集", "動画検査", "色彩設計")
#: How an episode begins.
EPISODE = re.compile(r"^(?:第\s*(\d+)\s*話|#\s*(\d+)|(\d+)\s*話|(?:EPISODE|Episode|episode)\s*(\d+)|第\s*(\d+)\s*回|(?:ep|EP)\.?\s*(\d+))")
FOOTNOTE = re.compile(r"[*＊]\d+|\[[^\]]*\]")
QUOTED = re.compile(r"[*＊]\d+|\[.*?\]|（.*?）|\(.*?\)|「.*?」|『.*?』")
NAME_BREAK = re.compile(r"[\s\u3000、,，/／・&＆]+")
GOOD_NAME = re.compile(r"[぀-ヿ一-鿿 A-Za-z]{2,10}")
#: What no name of a person holds (in lower case) - works' terms, roles and departments, companies.
NO_NAME = (
    "話 放送 放映 サブタイトル タイトル クール パート op ed mission stage act episode ノンクレジット ほか 他 連載 原作 製作 制作進行 プロデューサー 委員会 アバン アイキャッチ 予告 提供 "
    "絵コンテ コンテ 演出 脚本 作画 原画 動画 美術 撮影 音響 効果 色彩 仕上 編集 制作 宣伝 進行 設定 デザイン デザイナー プロデュース 監督 作監 総作監 キャラデザ シリーズ構成 構成 シナリオ "
    "キャスト cast 文芸 選曲 録音 整音 特効 アクション コンセプト アート ビジュアル エフェクト メカニック メカ プロップ サブキャラクター チーフ メイン エピソード シリーズ スーパーバイザー "
    "ディレクター アニメーション アニメーター ピクセル vfx 3dcg cg モデリング リギング 色指定 検査 series director composition producer designer design chief assistant concept action art visual "
    "effect supervisor animation animator character staff credit original story screenplay script music sound editing editor"
).split()
NO_PERSON = (
    "スタジオ プロダクション フィルム じゃんぐるじむ わあぷ アニメアール コア 背景 ピクチャーズ コミックス 小学館 集英社 講談社 キティ オフィス 工房 グループ アトリエ メカマン ヤマト "
    "エンタテインメント ピエロ ぴえろ サンライズ 東映 マッドハウス ボンズ シャフト ガイナックス トリガー ユーフォーテーブル"
).split()
#: Headers that a page gives to the roles.
PAGE_HEADERS = {"director": "監督", "series_comp": "シリーズ構成", "char_design": "キャラクターデザイン", "unit_director": "演出", "sakkan": "作画監督", "music": "音楽", "art_dir": "美術監督", "genga": "原画", "conte_enshutsu": "絵コンテ"}
LOOK_AHEAD = 5  # a header without a value looks for names in so many lines after it
_NO_NAME = re.compile("|".join(map(re.escape, sorted(NO_NAME, key=len, reverse=True))))
_NO_PERSON = re.compile("|".join(map(re.escape, NO_PERSON)))


def is_clean_name(name: Column) -> Column:
    """Whether a text passes as the name of a person: two to ten letters, no digit or sign, no word of NO_NAME or NO_PERSON."""
    return name.rlike(f"^{GOOD_NAME.pattern}$") & ~F.lower(name).rlike(_NO_NAME.pattern) & ~name.rlike(_NO_PERSON.pattern)


def split_value(value: Column) -> Column:
    """Clean names of a credit value in order: notes and quotes off, split at spaces, commas, slashes and dots."""
    parts = F.split(F.regexp_replace(value, QUOTED.pattern, ""), NAME_BREAK.pattern)
    return F.filter(parts, is_clean_name)


class _Area(HTMLParser):
    """Text of the page title and of the user area."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.in_title, self.title, self.parts, self.seen = 0, False, "", [], False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag == "div":
            if self.depth:
                self.depth += 1
            elif "user-area" in (dict(attrs).get("class") or "").split():
                self.depth, self.seen = 1, True
        if self.depth and tag in ("br", "p", "li", "tr", "div", "h2", "h3", "h4"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag == "div" and self.depth:
            self.depth -= 1
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif self.depth:
            self.parts.append(data)


def split_names(value: str) -> list[str]:
    """`split_value` of one text."""
    parts = NAME_BREAK.split(QUOTED.sub("", value))
    return [p for p in parts if GOOD_NAME.fullmatch(p) and not _NO_NAME.search(p.lower()) and not _NO_PERSON.search(p)]


def _header(line: str) -> tuple[list[str], str] | None:
    """(roles, value) of a line that begins with role headers; a header that feeds no role gives no roles."""
    left, sep, right = line.partition("：") if "：" in line else line.partition(":")
    heads = re.split(r"[・/、&＆]", left.strip()) if sep else [line.split()[0]] if line.split() else []
    value = right if sep else line[len(heads[0]) :] if heads else ""
    roles = list(dict.fromkeys(HEADERS[h.strip()] for h in heads if h.strip() in HEADERS))
    if roles:
        return roles, value.strip()
    return ([], "") if heads and heads[0].strip() in RESET else None


def scan(page: str) -> dict:
    """title, year, total_episodes, and credits as (ep_num, role, pos, name); ep_num 0 for the whole work."""
    area = _Area()
    area.feed(page or "")
    title = html.unescape(area.title).split("-")[0].strip()
    if not area.seen:
        return {"title": title, "year": 0, "total_episodes": 0, "credits": []}
    lines = [x.strip() for x in "".join(area.parts).split("\n") if x.strip()]
    head = lines[:35]
    year = next((int(m[1]) for x in head for m in [re.search(r"((?:19|20)\d{2})\s*年", x) or re.search(r"((?:19|20)\d{2})[/.-]\d{1,2}", x)] if m), 0)
    total = next((int(m[1]) for x in head for m in [re.search(r"全\s*(\d+)\s*話", x)] if m), 12)
    out, episode, roles, count, ahead = [], 0, [], {}, 0
    single = not any(EPISODE.match(x) for x in lines)
    for raw in lines:
        line = FOOTNOTE.sub("", raw).strip()
        m = EPISODE.match(line)
        if m:
            episode, roles = int(next((g for g in m.groups() if g), 1)), []
            continue
        found = _header(line)
        if found:
            roles, value = found
            ahead = LOOK_AHEAD if not value else 0
        elif roles and (ahead or episode):
            value, ahead = line, ahead - 1
        else:
            continue
        names = split_names(value)
        if names and not episode and not found:
            ahead = 0  # the names of a header stand in one of the lines after it
        for name in names:
            for role in roles:
                key = episode, role
                count[key] = count.get(key, 0) + 1
                out.append((episode, role, count[key], name))
    if single:  # one part: what is credited there is credited in its only episode, too
        out += [(1, r, p, n) for e, r, p, n in out if r in ("genga", "sakkan", "conte_enshutsu")]
    return {"title": title, "year": year, "total_episodes": 1 if single else total, "credits": out}


def credits(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> (page_id, title, year, total_episodes, ep_num, role, pos, name); pages without credits
    give one row with null role. Null pages count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                read = scan(page or "")
                for c in read["credits"] or [(0, None, 0, None)]:
                    rows.append((key, read["title"], read["year"], read["total_episodes"], *c))
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
            names = ["page_id", "title", "year", "total_episodes", "ep_num", "role", "pos", "name"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, title string, year int, total_episodes int, ep_num int, role string, pos int, name string")


def participation(rows: DataFrame) -> DataFrame:
    """rows (page_id, total_episodes, ep_num, pos, name) -> mean rank and share of episodes of each animator."""
    each = rows.groupBy("page_id").agg(F.countDistinct("ep_num").alias("episodes"), F.max("total_episodes").alias("total"))
    mine = rows.groupBy("page_id", "name").agg(F.avg("pos").alias("r"), F.countDistinct("ep_num").alias("k"))
    out = mine.join(each, "page_id").select(
        "page_id", "name", (F.floor(F.col("r") * 100 + 0.5) / 100).alias("rank"),
        (F.floor(F.col("k") / F.greatest("episodes", "total", F.lit(1)) * 1000 + 0.5) / 1000).alias("ep_ratio"),
    )
    return out


def union_names(first, second):
    """Names of two arrays in order, the first of each kept, two letters at least."""
    return F.filter(F.array_distinct(F.concat(first, second)), lambda n: F.length(n) >= 2)
