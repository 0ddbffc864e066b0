"""Parsing of typed names into comparable parts, and kana, romaji and kanji readings."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np

#: Romanisation of the basic kana; the voiced rows follow from the consonants, see `romaji`.
_ROWS = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
_IRREGULAR = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "o", "ん": "n", "ゔ": "vu", "ゐ": "i", "ゑ": "e"}
_SMALL_Y = {"ゃ": "a", "ゅ": "u", "ょ": "o"}
_SMALL_V = dict(zip("ぁぃぅぇぉ", "aiueo"))

OPTIONS = 1 << 20  # readings of kana weighed at once

NOTE = re.compile(r"\s*[(（\[][^)）\]]*[)）\]]\s*$")
COMPANY_MARK = re.compile(r"^\s*[(（]株[)）]\s*|^\s*㈱\s*|^\s*株式会社\s*|\s*[(（]株[)）]\s*$|[,\s]+(?:inc|co|ltd)\.?\s*$", re.I)
STUDIO = re.compile(r"^(?:スタ[ジヂ]オ|studio\b|st\.(?=\s))[\s・]*|[\s・]*(?:スタ[ジヂ]オ|\bstudio)$", re.I)
KANJI = re.compile(r"[㐀-䶿一-鿿々豈-﫿]+")
KANA = re.compile(r"[ぁ-ゖァ-ヺー]+")
LATIN = re.compile(r"[A-Za-zÀ-ɏ.'’-]+")


@lru_cache(maxsize=1)
def _kana() -> dict[str, str]:
    table = {k: c + v for c, row in _ROWS.items() for k, v in zip(row, "aiueo")}
    return table | _IRREGULAR


def hiragana(text: str) -> str:
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)


def romaji(kana: str) -> str:
    out: list[str] = []
    table = _kana()
    for c in hiragana(kana):
        if c in _SMALL_Y and out and out[-1].endswith("i"):
            stem = out[-1][:-1]
            out[-1] = stem + ("" if stem in ("sh", "ch", "j") else "y") + _SMALL_Y[c]
        elif c in _SMALL_V and out:
            out[-1] = out[-1][:-1] + _SMALL_V[c] if len(out[-1]) > 1 else out[-1] + _SMALL_V[c]
        elif c not in "ーっ":
            out.append(table.get(c, c))
    return "".join(out)


@lru_cache(maxsize=1)
def _syllables() -> dict[str, str]:
    table = {v: k for k, v in reversed(list(_kana().items())) if k not in "をゐゑぢづ"}
    for k in "きぎしじちにひびぴみり":
        table |= {romaji(k + y): k + y for y in _SMALL_Y}
    return table


def kana_of(word: str) -> str | None:
    """Hiragana of a romanised word, or None where it doesn't parse."""
    table, out, i = _syllables(), [], 0
    while i < len(word):
        for n in (3, 2, 1):
            if word[i : i + n] in table:
                out.append(table[word[i : i + n]])
                i += n
                break
        else:
            return None
    return "".join(out)


def parse(text: str) -> tuple[str, str, str | None, str | None, str | None]:
    """(kind, a, b, kana of a, kana of b) of a name in its consistent form.

    kinds: K kanji in one piece; KK two kanji parts; M kanji family name and kana; R two romanised parts (from kana or
    Latin letters); S studio; O anything else. A comma puts the family name first; it is swapped here.
    """
    s = unicodedata.normalize("NFKC", text).strip().translate(old_forms())
    for _ in range(2):
        s = NOTE.sub("", COMPANY_MARK.sub("", s)).strip() or s
    core = STUDIO.sub("", s).strip()
    if core != s and core:
        flat = re.sub(r"[\s・,.]", "", core)
        return "S", romaji(flat) if KANA.fullmatch(flat) else flat.lower(), None, None, None
    if "," in s:
        family, _, given = s.partition(",")
        s = f"{given.strip()} {family.strip()}"
    parts = [p for p in re.split(r"[\s・]+", s) if p]
    if len(parts) == 1:
        one = parts[0]
        if KANJI.fullmatch(one):
            return "K", one, None, None, None
        m = re.fullmatch(rf"({KANJI.pattern})({KANA.pattern})", one)
        if m:
            return "M", m[1], romaji(m[2]), None, hiragana(m[2])
    elif len(parts) == 2:
        a, b = parts
        if KANJI.fullmatch(a) and KANJI.fullmatch(b):
            return "KK", a, b, None, None
        if KANJI.fullmatch(a) and KANA.fullmatch(b):
            return "M", a, romaji(b), None, hiragana(b)
        if KANJI.fullmatch(b) and KANA.fullmatch(a):
            return "M", b, romaji(a), None, hiragana(a)
        if KANA.fullmatch(a) and KANA.fullmatch(b):
            return "R", romaji(a), romaji(b), hiragana(a), hiragana(b)
        if LATIN.fullmatch(a) and LATIN.fullmatch(b):
            a, b = a.lower().strip("."), b.lower().strip(".")
            return "R", a, b, kana_of(a), kana_of(b)
    return "O", s.lower(), None, None, None


#: Old and variant forms of ideographs in names, each followed by the form in common use.
OLD_FORMS = "髙高 﨑崎 嵜崎 嶋島 嶌島 廣広 關関 鹽塩 邊辺 邉辺 薗園 冨富 澤沢 惠恵 龍竜 黑黒 瀨瀬 濱浜 櫻桜 齋斎 齊斉 國国 眞真 條条 藏蔵 榮栄 實実 壽寿 應応 德徳 增増 淺浅 瀧滝 萬万 豐豊 鐵鉄 圓円 凛凜 禮礼 彌弥 來来 亞亜 學学 寶宝 淸清 靑青 橫横 曉暁 靜静 峯峰 埜野 舘館 濵浜 渡渡 會会 佛仏 澁渋 槇槙 莊荘 總総 聰聡 譽誉 郞郎 朗朗 綠緑 緖緒 絲糸 繪絵 螢蛍 衞衛 與与 藝芸 蘆芦 薰薫 劍剣 勳勲 卷巻 吳呉 喜喜 圖図 堯尭 壯壮 將将 嚴厳 從従 惟惟 戀恋 敎教 晝昼 晉晋 每毎 氣気 海海 燈灯 獨独 瑤瑶 當当 發発 盡尽 祐祐 福福 神神 祥祥 穗穂 竝並 點点"


@lru_cache(maxsize=1)
def old_forms() -> dict[int, str]:
    return {ord(x[0]): x[1] for x in OLD_FORMS.split() if x[0] != x[1]}


class Readings:
    """Reading of each kanji, at the beginning of a part and after it, fitted by expectation maximisation over (kana,
    kanji of the part); a part may have any number of kanji."""

    def __init__(self):
        self.share: list[dict[str, dict[str, float]]] = [{}, {}]
        self.length: list[dict[int, float]] = [{}, {}]

    @staticmethod
    def _splits(kana: str, n: int) -> list[tuple[str, ...]]:
        """All ways to cut `kana` into n readings."""
        if n == 1:
            return [(kana,)] if 0 < len(kana) <= 4 else []
        bad = "んゃゅょっー"
        return [(kana[:i], *rest) for i in range(1, min(4, len(kana) - 1) + 1) if kana[i] not in bad for rest in Readings._splits(kana[i:], n - 1)]

    def fit(self, data: list[tuple[str, list[tuple[str, float]]]], rounds: int = 7) -> None:
        """data: kana of a part and the kanji that it may belong to, with weights."""
        groups = [([(kana, 1.0)], parts) for kana, parts in data]
        for n in range(rounds):
            self.maximise(self.expected(groups, n == 0))

    def model(self) -> tuple[dict[str, int], list[tuple[np.ndarray, np.ndarray]], list[dict[int, float]]]:
        """Numbers of the readings known, and of each side the keys of its pairs in order with their shares."""
        numbers: dict[str, int] = {}
        tables = []
        for side in self.share:
            keys = np.array([ord(k) << 32 | numbers.setdefault(x, len(numbers)) for k, d in side.items() for x in d], np.int64)
            order = np.argsort(keys)
            tables.append((keys[order], np.array([v for d in side.values() for v in d.values()])[order]))
        return numbers, tables, self.length

    def expected(self, groups: list[tuple[list[tuple[str, float]], list[tuple[str, float]]]], first: bool = False, model: tuple | None = None) -> list[dict[tuple[str, str], float]]:
        """How often each kanji is expected to be read as what, at the beginning and after it, over groups of kana with
        their counts and of the parts with their weights that each of these may belong to; `first`: any reading alike."""
        numbers, tables, length = model or self.model()
        texts: dict[str, int] = {}
        cuts: dict[tuple[str, int], list[list[int]]] = {}
        sides: list[dict[int, float]] = [{}, {}]
        parts: dict[int, list[tuple[int, str, float]]] = {}
        for g, (_, options) in enumerate(groups):
            for part, weight in options:
                if part:
                    parts.setdefault(len(part), []).append((g, part, weight))
        counts = np.array([c for kanas, _ in groups for _, c in kanas])
        of = np.repeat(np.arange(len(groups)), [len(kanas) for kanas, _ in groups])
        names = [kana for kanas, _ in groups for kana, _ in kanas]
        held = {}
        for n, rows in parts.items():
            codes = np.frombuffer("".join(r[1] for r in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.int64)
            at = np.array([r[0] for r in rows])
            held[n] = codes, np.array([r[2] for r in rows]), np.searchsorted(at, np.arange(len(groups))), np.bincount(at, minlength=len(groups))
        load = sum((h[3] for h in held.values()), np.zeros(len(groups), np.int64))[of] * 8
        chunk = np.cumsum(load) // OPTIONS
        for lo, hi in zip(*(np.searchsorted(chunk, np.unique(chunk), side) for side in ("left", "right"))):
            made = []
            for n, (codes, weights, start, many) in held.items():
                unit, read = [], []
                for u in range(lo, hi):
                    if many[of[u]]:
                        key = names[u], n
                        if key not in cuts:
                            cuts[key] = [[texts.setdefault(x, len(texts)) for x in split] for split in self._splits(*key)]
                        unit += [u] * len(cuts[key])
                        read += cuts[key]
                if unit:
                    unit, read = np.array(unit), np.array(read)
                    again = many[of[unit]]
                    rep = np.repeat(np.arange(len(unit)), again)
                    to = start[of[unit]][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(again) - again, again)
                    made.append((unit[rep], read[rep], codes[to], weights[to].copy()))
            known = np.array([numbers.get(x, -1) for x in texts], np.int64)
            sizes = [np.array([le.get(len(x), 1e-3) for x in texts]) for le in length]
            total = np.zeros(hi - lo)
            for unit, read, codes, p in made:
                for k in range(0 if first else codes.shape[1]):
                    (keys, shares), x = tables[min(k, 1)], read[:, k]
                    if len(keys):
                        want = codes[:, k] << 32 | np.maximum(known[x], 0)
                        found = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                        p *= (np.where((keys[found] == want) & (known[x] >= 0), shares[found], 0.0) + 1e-4) * sizes[min(k, 1)][x]
                    else:
                        p *= 1e-4 * sizes[min(k, 1)][x]
                total += np.bincount(unit - lo, p, hi - lo)
            for unit, read, codes, p in made:
                p *= (counts[unit] / np.where(total > 0, total, 1.0)[unit - lo]) * (total > 0)[unit - lo]
                for k in range(codes.shape[1]):
                    keys, place = np.unique(codes[:, k] << 32 | read[:, k], return_inverse=True)
                    for key, v in zip(keys.tolist(), np.bincount(place, p, len(keys)).tolist()):
                        sides[min(k, 1)][key] = sides[min(k, 1)].get(key, 0.0) + v
        words = list(texts)
        return [{(chr(key >> 32), words[key & 0xFFFFFFFF]): v for key, v in side.items()} for side in sides]

    def maximise(self, expected: list[dict[tuple[str, str], float]]) -> None:
        """Take the shares that the expected readings have; rounded, as their sums hang on the order of rows."""
        self.share = []
        for side, rows in enumerate(expected):
            lengths, kanji = defaultdict(list), defaultdict(dict)
            for (k, x), v in sorted(rows.items()):
                kanji[k][x] = v
                lengths[len(x)].append(v)
            whole = math.fsum(rows.values())
            self.length[side] = {n: round(math.fsum(v) / whole, 12) for n, v in lengths.items()} if whole else {}
            self.share.append({k: {x: round(v / (math.fsum(d.values()) + 0.1), 12) for x, v in d.items()} for k, d in kanji.items()})

    def _p(self, side: int, kanji: str, kana: str) -> float:
        return (self.share[side].get(kanji, {}).get(kana, 0.0) + 1e-4) * self.length[side].get(len(kana), 1e-3)

    def read(self, part: str) -> str | None:
        """The likeliest reading of a part in kana; None where one of its kanji was never heard."""
        out = []
        for k, c in enumerate(part or ""):
            options = self.share[min(k, 1)].get(c)
            if not options:
                return None
            out.append(max(options, key=lambda x: (options[x], x)))
        return "".join(out) or None


def osa(a: str, b: str, most: int = 1) -> int:
    """Edit distance with swaps of neighbours in a band of width 2 * most + 1; most + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before2: dict[int, int] = {}
    before = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                row[j] = i
                continue
            d = min(before.get(j, math.inf) + 1, row.get(j - 1, math.inf) + 1, before.get(j - 1, math.inf) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before2.get(j - 2, math.inf) + 1)
            row[j] = d
        before2, before = before, row
        if min(row.values()) > most:
            return most + 1
    return int(min(before.get(len(b), most + 1), most + 1))
