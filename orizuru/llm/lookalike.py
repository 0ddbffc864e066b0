"""One consistent form for texts that look the same.

1. Union-find over code points and strings joins what looks alike, transitively: full and half width, radicals and
   their ideographs, composed letters and their sequences, spaces, invisible characters (joined with the empty
   string), look-alike letters of different scripts. Sequences are closed over the classes of their parts, so that a
   half-width letter with a half-width mark joins the composed full-width letter.
2. Of each class and script the most frequent ordinary member in the corpus is the representative.
3. An Aho-Corasick automaton over all members that may have to change rewrites a text greedily, longest match first.
   Members of several scripts follow their word: for Latin, Greek and Cyrillic the script of the letters that no
   other script has, else the most frequent one; for kana, ideographs and dashes the neighbours, and between the
   remaining options the character model of the corpus.

Characters with a look of their own (circled digits, fractions, compatibility ideographs of old forms) are in no
class. Defined results: null texts stay null, empty and white-space texts get plain spaces; texts of any length are
rewritten whole; the rewriting of a rewritten text changes nothing.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orizuru.llm import charlm, encoding_repair
from orizuru.session import cut, table

#: Letters that look like a Latin letter, by script.
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "κ": "k", "υ": "u", "χ": "x"}
CYRILLIC = {"А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W", "в": "ʙ", "к": "ĸ"}
LATIN_SMALL = {"ɡ": "g", "ı": "i", "ɑ": "a"}
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n"}
#: Katakana and the hiragana or ideographs that look like them.
KANA = {"カ": "力", "ロ": "口", "エ": "工", "タ": "夕", "ニ": "二", "ハ": "八", "ト": "卜", "ー": "一", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ"}
#: Dashes that look like the hyphen, and lines that look like the long vowel mark.
HYPHENS = "‐‑−˗⁃"
LINES = "―─"

WORDS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN")
SCRIPTS = (*WORDS, "KATAKANA", "HIRAGANA", "CJK")


@lru_cache(maxsize=65536)
def script(c: str) -> str:
    """Script of a code point; empty for what belongs to none. Width doesn't matter."""
    if c == "ー" or c == "ｰ":
        return "KATAKANA"
    if c in "・･゠":
        return ""
    name = unicodedata.name(c, "").removeprefix("FULLWIDTH ").removeprefix("HALFWIDTH ").removeprefix("KANGXI RADICAL ")
    if 0x2F00 <= ord(c) <= 0x2FDF or 0x2E80 <= ord(c) <= 0x2EFF or c in "々〆":
        return "CJK"
    first = name.split(" ", 1)[0].split("-")[0]
    return first if first in SCRIPTS and unicodedata.category(c)[0] in "LM" else ""


@lru_cache(maxsize=65536)
def invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or c in "͏ᅟᅠㅤﾠ"


class Classes:
    """Union-find over strings."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


@lru_cache(maxsize=1)
def look_alikes() -> dict[str, list[str]]:
    """All members of each class, by its root."""
    classes = Classes()
    sequences: list[tuple[str, str]] = []
    for o in range(0x80, 0x30000):
        c = chr(o)
        if 0xAC00 <= o <= 0xD7FF or 0xD800 <= o <= 0xDFFF or 0xF900 <= o <= 0xFAFF or 0x2F800 <= o:
            continue  # syllables compose by rule of their own; compatibility ideographs look different
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            classes.union(c, chr(int(rest, 16)))
        elif kind == "<compat>" and 0x2E80 <= o <= 0x2FDF:
            classes.union(c, chr(int(rest, 16)))
        elif unicodedata.category(c) == "Zs":
            classes.union(c, " ")
        elif invisible(c):
            classes.union(c, "")
        elif kind and not kind.startswith("<") and unicodedata.normalize("NFC", c) == c:
            sequences.append((unicodedata.normalize("NFD", c), c))
    for table_ in (GREEK, CYRILLIC, LATIN_SMALL, ARMENIAN, KANA):
        for a, b in table_.items():
            classes.union(a, b)
    for c in HYPHENS:
        classes.union(c, "-")
    for c in LINES:
        classes.union(c, "ー")
    alike = classes.members()
    root = {m: r for r, ms in alike.items() for m in ms}
    for parts, whole in sequences:  # closed over the classes of the base and of the marks
        options = [[m for m in alike.get(root.get(p, p), [p]) if m == p or unicodedata.combining(p) or script(m) == script(p)] for p in parts]
        for made in itertools.product(*options):
            classes.union("".join(made), whole)
        for k in range(1, len(parts) - 1):  # partly composed
            classes.union(unicodedata.normalize("NFC", parts[: k + 1]) + parts[k + 1 :], whole)
    return classes.members()


def ordinary(m: str) -> bool:
    """Whether a member is composed, of normal width and visible."""
    return len(m) == 1 and unicodedata.normalize("NFKC", m) == m and not invisible(m) and m not in HYPHENS + LINES


class Former:
    """Rewrites texts to their consistent form; holds counts of fixed size and is small enough to broadcast."""

    def __init__(self, model: charlm.CharModel):
        self.model = model
        self._ready = None
        self._known: dict[str, str] = {}

    def __getstate__(self):
        return {"model": self.model, "_ready": None, "_known": {}}

    def _build(self):
        model = self.model
        often = lambda m: float(model.points[ord(m)]) if len(m) == 1 and ord(m) < charlm.POINTS else 0.0
        automaton = ahocorasick.Automaton()
        fixed: dict[str, str] = {}
        choice: dict[str, dict[str, str]] = {}
        for root, members in look_alikes().items():
            if "" in members:
                fixed |= dict.fromkeys((m for m in members if m), "")
                continue
            reps: dict[str, str] = {}
            for m in sorted((m for m in members if ordinary(m)), key=lambda m: (often(m), -ord(m))):
                reps[script(m)] = m
            if len(reps) == 1:
                rep = next(iter(reps.values()))
                fixed |= {m: rep for m in members if m != rep}
            elif reps:
                choice |= dict.fromkeys(members, reps)
        for m in (*fixed, *choice):
            automaton.add_word(m, m)
        automaton.make_automaton()
        self._ready = model, automaton, fixed, choice
        return self._ready

    def form(self, text: str | None) -> str | None:
        if not text or text.isascii():
            return text
        known = self._known.get(text)
        if known is None:
            if len(self._known) > 200_000:
                self._known.clear()
            known = self._known[text] = self._form(text)
        return known

    def _form(self, text: str) -> str:
        model, automaton, fixed, choice = self._ready or self._build()
        out: list[str] = []
        open_: list[int] = []  # places in `out` that still have a choice
        at = 0
        for end, m in automaton.iter_long(text):
            start = end - len(m) + 1
            out += text[at:start]
            at = end + 1
            if m in fixed:
                if fixed[m]:
                    out.append(fixed[m])
            else:
                open_.append(len(out))
                out.append(m)
        out += text[at:]
        words = [i for i in open_ if any(s in WORDS for s in choice[out[i]])]
        self._settle_words(out, words, choice, model)
        rest = [i for i in open_ if not any(s in WORDS for s in choice[out[i]])] if len(words) < len(open_) else []
        for i in rest:
            out[i] = self._by_neighbours(out, i, choice, model)
        return "".join(out)

    @staticmethod
    def _settle_words(out: list[str], places: list[int], choice: dict, model: charlm.CharModel) -> None:
        done = -1
        for i in places:
            if i <= done or i not in range(len(out)):
                continue
            lo = hi = i
            while lo > 0 and script(out[lo - 1][0]) in WORDS:
                lo -= 1
            while hi + 1 < len(out) and script(out[hi + 1][0]) in WORDS:
                hi += 1
            done = hi
            span = range(lo, hi + 1)
            sure = [script(out[k]) for k in span if out[k] not in choice]
            if sure:
                best = max(WORDS, key=lambda s: (sure.count(s), -WORDS.index(s)))
            else:
                able = [s for s in WORDS if all(s in choice[out[k]] for k in span)]
                weight = {s: sum(np.log(model.points[ord(choice[out[k]][s])] + 0.05) for k in span) for s in able}
                best = max(able, key=lambda s: (weight[s], -WORDS.index(s))) if able else ""
            for k in span:
                reps = choice.get(out[k])
                if reps:
                    out[k] = reps.get(best) or reps.get(script(out[k][0])) or out[k]

    @staticmethod
    def _by_neighbours(out: list[str], i: int, choice: dict, model: charlm.CharModel) -> str:
        now, reps = out[i], choice[out[i]]
        before = out[i - 1][-1] if i else ""
        after = out[i + 1][0] if i + 1 < len(out) else ""
        sides = [script(c) for c in (before, after) if c]
        current = now if ordinary(now) else None
        own = script(now[0]) or ("CJK" if now == "一" else "")
        options = {m for s, m in reps.items() if not s or s in sides or m == current}
        if current and own and current != "ー":
            kana_side = "KATAKANA" in sides
            if own == "CJK" and ("CJK" in sides or not kana_side):
                return current
            if own == "HIRAGANA" and not kana_side:
                return current
            if own == "KATAKANA" and (kana_side or own not in ("KATAKANA",)):
                return current
        if current == "-" and sides.count("KATAKANA") < 2:
            return current
        if current == "ー" and any(s in ("KATAKANA", "HIRAGANA") for s in sides[:1]):
            return current
        if not options:
            options = set(reps.values())
        if now[0] in LINES and "KATAKANA" in sides[:1] and "ー" in options:
            return "ー"
        codes = {m: np.array([ord(before) if before else charlm.EDGE, ord(m), ord(after) if after else charlm.EDGE], np.uint32) for m in options}
        gain = {m: float(model.logs(c).sum()) for m, c in codes.items()}
        best = max(gain, key=lambda m: (gain[m], m))
        return best if not current or gain[best] > gain[current] else current


def train(texts: DataFrame) -> Former:
    """Frequencies over all different texts."""
    return Former(charlm.CharModel(charlm.count(texts)))


def rewrite(df: DataFrame, keys: list[str], column: str, former: Former) -> DataFrame:
    """The rows whose text has to change: keys, text, form. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(former)
    schema = df.select(*keys, F.col(column).alias("text")).schema.add("form", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            forms = [former.form(t) for t in texts]
            keep = [i for i, (t, f) in enumerate(zip(texts, forms)) if t != f]
            if keep:
                rows = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([forms[i] for i in keep], pa.string())], names=[*rows.schema.names, "form"])

    return df.select(*keys, F.col(column).alias("text")).mapInArrow(run, schema)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of the problem as (tab, rec_id, field, text); a staff cell once for each name."""
    works = table(spark, sf_dir, "anime_metadata").select(F.lit("anime_metadata").alias("tab"), F.col("work_id").alias("rec_id"), F.lit("title").alias("field"), F.col("title").alias("text"))
    native = table(spark, sf_dir, "anilist_client").select(F.lit("anilist_client").alias("tab"), F.col("anilist_id").cast("string").alias("rec_id"), F.lit("title_native").alias("field"), F.col("title_native").alias("text"))
    return works.unionByName(native).where(F.col("text").isNotNull())


def changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, rec_id, field, text, form) of every text that looks ordinary but isn't, without garbled staff."""
    credited = encoding_repair.sources(spark, sf_dir)
    names = credited.where("tab = 'anime_metadata'").select("tab", "rec_id", F.lit("staff").alias("field"), "text")
    everything = cells(spark, sf_dir).unionByName(names)
    former = train(everything.select("text").distinct())
    found = rewrite(everything, ["tab", "rec_id", "field"], "text", former).distinct()
    bad = encoding_repair.garbled(credited).where("tab = 'anime_metadata'").select("rec_id", F.lit("staff").alias("field")).distinct()
    return found.join(bad, ["rec_id", "field"], "left_anti").select("tab", "rec_id", "field", "text", "form")
