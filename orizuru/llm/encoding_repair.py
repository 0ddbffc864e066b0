"""Find and repair texts that were read with a wrong character encoding.

A character model is trained on the texts of the corpus, first on all that hold no impossible character, then again
without those the first model rejects. Every candidate chain (encode with the wrong encoding, decode with the right
one), over the whole text and over each of its tails, is scored against the text as it stands; the likeliest is
accepted if it gains more than a margin. The margin is validated on all clean texts, each once disturbed and once
garbled on purpose, in the tasks: the value with the best F1 is taken.

All tails of a text are scored at once: a chain turns the text into one string of bytes, each byte is decoded as if a
character began there and points to the byte after it, and sums along the pointers (by doubling) give the score of
every tail. The cost is n log n in the length of a text, so there is no limit to it, and the whole runs over the
arrays of many texts at a time.

Characters that only a failed decoding leaves (U+FFFD, C1 controls, private use) have lost their bytes for good. For
these the text without them is one more candidate: where it is the likeliest beyond the margin, the text is affected
and its original null.

Defined results: null and empty texts are clean; pure ASCII texts are clean; a text of any length is scored whole;
records with several garbled names come once; staff that isn't valid JSON gives no names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orizuru.llm import charlm
from orizuru.operators.nested import flatten_credits
from orizuru.session import cut, table

#: Encodings that Japanese texts are written in, and those they are wrongly read with.
RIGHT = ("utf-8", "cp932", "euc_jp")
WRONG = ("windows-1252", "mac_roman", "koi8_r", "cp850", "cp437", "cp1251", "cp866", "cp932", "euc_jp", "gb18030", "big5", "euc_kr")
#: Those of them whose wrong readings may give ideographs or kana.
WIDE = ("cp932", "euc_jp", "gb18030", "big5", "euc_kr")
TWICE = ("windows-1252", "utf-8")  # a text may be read wrongly twice by this chain
SURE = 20.0  # a gain beyond which a text is no clean one
TAIL_COST = 3.0  # a wrong reading that begins inside a text is the rarer case
FIRST_MARGIN = 5.0  # of the first model: a clean text that it leaves out does no harm
MARGINS = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 15.0, 20.0, 25.0)
LOST = 0xFFFD

_IMPOSSIBLE = re.compile("[\ufffd\x80-\x9f\ue000-\uf8ff]")
_NOT_ASCII = re.compile("[^\x00-\x7f]")


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """windows-1252 as browsers read it: bytes without a character stand for themselves."""
    known = {chr(b): b for b in range(256)}
    for b in range(0x80, 0xA0):
        try:
            known[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            pass
    return known


def to_bytes(text: str, wrong: str) -> bytes | None:
    """The bytes that give `text` when read with `wrong`; lost characters become question marks."""
    text = text.replace("\ufffd", "?")
    if wrong == "windows-1252":
        known = _byte_of()
        try:
            return bytes([known[c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(wrong)
    except UnicodeEncodeError:
        return None


CHAINS = tuple((w, r) for r in RIGHT for w in WRONG if w != r)


@lru_cache(maxsize=None)
def _writer(wrong: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of bytes (0: none) and the bytes as one number, for each code point of the basic plane."""
    size, packed = np.zeros(0x10000, np.int64), np.zeros(0x10000, np.int64)
    if wrong == "windows-1252":
        pool = _byte_of()
    elif wrong == "gb18030":
        pool = (chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    else:
        high = bytes(range(0x80, 0x100))
        pool = set(bytes(range(0x80)).decode("ascii")) | set(high.decode(wrong, "ignore"))
        if wrong in WIDE:
            pool |= {c for a in high for b in range(0x40, 0xFF) for c in bytes([a, b]).decode(wrong, "ignore")}
            pool |= {c for a in range(0xA1, 0xFF) for b in range(0xA1, 0xFF) for c in bytes([0x8F, a, b]).decode(wrong, "ignore")} if wrong == "euc_jp" else set()
    for c in pool:
        raw = to_bytes(c, wrong)
        if raw:
            size[ord(c)], packed[ord(c)] = len(raw), int.from_bytes(raw)
    size[LOST], packed[LOST] = 1, ord("?")
    return size, packed


@lru_cache(maxsize=None)
def _reader(right: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of single bytes, of two bytes, and of two bytes after 0x8F; -1 where there is none."""
    tables = []
    for lead in (b"", None, b"\x8f" if right == "euc_jp" else None):
        out = np.full(256 if lead == b"" else 0x10000, -1, np.int64)
        if lead == b"":
            options = [(b, bytes([b])) for b in range(256)]
        else:
            options = [(a << 8 | b, (lead or b"") + bytes([a, b])) for a in range(0x81, 0xFF) for b in range(0x40, 0xFF)] if lead or not tables[1:] else []
        for k, raw in options:
            made = raw.decode(right, "ignore")
            if len(made) == 1 and (len(raw) == 1 or ord(made) > 0x7F or raw[0] < 0x80):
                out[k] = ord(made)
        tables.append(out)
    return tuple(tables)


def _decode_each(raw: np.ndarray, right: str) -> tuple[np.ndarray, np.ndarray]:
    """For each place of `raw` the character that would begin there (`LOST` where none does) and its bytes."""
    b0 = raw.astype(np.int64)
    b1, b2, b3 = (np.concatenate([b0[k:], np.zeros(k, np.int64)]) for k in (1, 2, 3))
    code, size = np.full(len(b0), LOST, np.int64), np.ones(len(b0), np.int64)
    if right == "utf-8":
        more1, more2, more3 = ((b & 0xC0) == 0x80 for b in (b1, b2, b3))
        code = np.where(b0 < 0x80, b0, code)
        two = (b0 >= 0xC2) & (b0 <= 0xDF) & more1
        lead3 = (b0 >= 0xE0) & (b0 <= 0xEF) & more1 & ~((b0 == 0xE0) & (b1 < 0xA0)) & ~((b0 == 0xED) & (b1 >= 0xA0))
        lead4 = (b0 >= 0xF0) & (b0 <= 0xF4) & more1 & ~((b0 == 0xF0) & (b1 < 0x90)) & ~((b0 == 0xF4) & (b1 >= 0x90))
        three, four = lead3 & more2, lead4 & more2 & more3
        size[two | (lead3 & ~more2) | (lead4 & ~more2)] = 2
        size[three | (lead4 & more2 & ~more3)] = 3
        size[four] = 4
        code = np.where(two, (b0 & 0x1F) << 6 | (b1 & 0x3F), code)
        code = np.where(three, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | (b2 & 0x3F), code)
        return np.where(four, (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | (b3 & 0x3F), code), size
    ones, twos, threes = _reader(right)
    one, two = ones[b0], twos[b0 << 8 | b1]
    three = np.where(b0 == 0x8F, threes[b1 << 8 | b2], -1) if right == "euc_jp" else np.full(len(b0), -1, np.int64)
    code = np.where(one >= 0, one, np.where(two >= 0, two, np.where(three >= 0, three, code)))
    size[(one < 0) & (two >= 0)] = 2
    size[(one < 0) & (two < 0) & (three >= 0)] = 3
    return code, size


class _Texts:
    """Code points of many texts with the scores of all their tails as they stand."""

    def __init__(self, texts: list[str], model: charlm.CharModel):
        self.model = model
        self.codes = charlm.join(texts).astype(np.int64)
        edges = np.flatnonzero(self.codes == charlm.EDGE)
        self.starts, self.ends = edges[:-1] + 1, edges[1:]
        self.text = np.zeros(len(self.codes), np.int64)
        self.text[self.ends] = 1
        self.text = np.cumsum(self.text) - self.text  # number of the text of each place, its edge included
        self.text[0] = -1
        self.total = np.concatenate([[0.0], np.cumsum(model.logs(self.codes).astype(np.float64))])
        self.edge = self.codes == charlm.EDGE
        self.wide = (self.codes > 0x7F) & (self.codes != LOST)
        self.first = np.zeros(len(self.codes), bool)
        self.first[self.starts] = True
        self.last: tuple = (None, None)

    def tails(self, mask: np.ndarray) -> np.ndarray:
        """How many places from each one to the end of its text are in `mask`."""
        before = np.concatenate([[0], np.cumsum(mask)])
        return before[self.ends[np.maximum(self.text, 0)]] - before[:-1]

    def prepared(self, wrong: str) -> tuple | None:
        """What all chains from `wrong` share; None where no text can be explained by it."""
        if wrong == self.last[0]:
            return self.last[1]
        self.last = wrong, self._prepare(wrong)
        return self.last[1]

    def _prepare(self, wrong: str) -> tuple | None:
        size, packed = self.written(wrong)
        able = (self.tails((size == 0) & ~self.edge) == 0) & ~self.edge
        able[0] = False
        begin = self.wide.copy()
        if wrong not in WIDE:  # letters and signs: a run of them begins where the wrong reading does
            before = np.concatenate([[0], self.codes[:-1]])
            begin &= (before < 0x80) | (np.concatenate([[1], size[:-1]]) == 0)
        begin = (begin | self.first) & able & (self.tails(self.wide) > 0)
        has = np.zeros(len(self.starts), bool)
        has[self.text[begin]] = True
        if not has.any():
            return None
        kept = np.flatnonzero((able | self.edge) & has[np.maximum(self.text, 0)] & (self.text >= 0))
        last = self.edge[kept]
        length = np.where(last, 4, size[kept])  # an edge ends the bytes of its text
        offset = np.cumsum(length) - length
        raw = np.zeros(int(length.sum()), np.uint8)
        for k in range(4):
            at = np.flatnonzero((length > k) & ~last)
            raw[offset[at] + k] = packed[kept[at]] >> 8 * (length[at] - 1 - k) & 255
        return begin, kept, last, offset, raw

    def best(self, wrong: str, right: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, gain, start) of the best tail of each text that this chain can explain."""
        made = self.prepared(wrong)
        if made is None:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        begin, kept, last, offset, raw = made
        code, step = _decode_each(raw, right)
        end = np.zeros(len(raw), bool)
        for k in range(4):
            end[offset[last] + k] = True
        code[end], step[end] = charlm.EDGE, 0
        to = np.arange(len(raw)) + step
        sums = np.zeros((len(raw), 3))
        inside = np.flatnonzero(~end)
        sums[inside, 0] = self.model.steps(code[inside], code[to[inside]])
        sums[inside, 1] = 1
        sums[inside, 2] = code[inside] == LOST
        while True:
            further = to[to]
            sums += sums[to]
            if np.array_equal(further, to):
                break
            to = further
        place = np.full(len(self.codes), -1, np.int64)
        place[kept] = offset
        at = np.flatnonzero(begin)
        o = place[at]
        gain = sums[o, 0] + self.model.steps(self.codes[at - 1], code[o]) - (self.total[self.ends[self.text[at]]] - self.total[at - 1])
        gain -= np.where(self.first[at], 0.0, TAIL_COST)
        gain[sums[o, 2] * 4 > sums[o, 1]] = -np.inf
        order = np.lexsort((at, -gain, self.text[at]))
        texts, top = np.unique(self.text[at][order], return_index=True)
        top = order[top]
        good = gain[top] > -np.inf
        return texts[good], gain[top][good], (at[top] - self.starts[texts])[good]

    def written(self, wrong: str) -> tuple[np.ndarray, np.ndarray]:
        table_size, table_packed = _writer(wrong)
        low = np.minimum(self.codes, 0xFFFF)
        size, packed = table_size[low], table_packed[low]
        for c in np.unique(self.codes[self.codes > 0xFFFF]).tolist():
            raw = to_bytes(chr(c), wrong) or b""
            size[self.codes == c], packed[self.codes == c] = len(raw), int.from_bytes(raw)
        size[self.edge] = 0
        return size, packed


def made_by(text: str, start: int, chain: tuple[str, ...]) -> str:
    """`text` with its tail from `start` on brought back through the encodings of `chain`."""
    tail = text[start:]
    for wrong, right in zip(chain[::2], chain[1::2]):
        tail = to_bytes(tail, wrong).decode(right, "replace")
    return text[:start] + tail


def best_repairs(texts: list[str], model: charlm.CharModel, costs: dict[tuple[str, str], float]) -> list[tuple[float, int, tuple[str, ...]]]:
    """(gain in log probability, start of the tail, chain) of the likeliest candidate of each text; (0, 0, ()) without
    one. `costs`: minus the log of each chain's share of wrong readings."""
    out: list[tuple[float, int, tuple[str, ...]]] = [(0.0, 0, ())] * len(texts)
    by_size: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        if t and not t.isascii():
            by_size.setdefault(len(t).bit_length(), []).append(i)
    for group in by_size.values():  # the rounds of doubling follow the longest text
        held = _Texts([texts[i] for i in group], model)
        again: list[tuple[int, int]] = []
        place = dict.fromkeys(group, len(CHAINS))
        for n, chain in sorted(enumerate(CHAINS), key=lambda c: c[1][0]):
            for k, gain, start in zip(*(a.tolist() for a in held.best(*chain))):
                gain -= costs.get(chain, 0.0)
                if gain > out[group[k]][0] or gain == out[group[k]][0] > 0 and n < place[group[k]]:  # the first of equal ones
                    out[group[k]], place[group[k]] = (gain, start, chain), n
                if chain == TWICE:
                    again.append((group[k], start))
        once = [(i, start, made_by(texts[i], start, TWICE)) for i, start in again]
        once = [x for x in once if not x[2].isascii()]
        if once:
            second = _Texts([made for *_, made in once], model)
            found = [(once[k], start) for k, _, start in zip(*(a.tolist() for a in second.best(*TWICE)))]
            found = [(i, start, made_by(made[:start] + made[start:], start, TWICE)) for (i, first, made), start in found if start <= first]
            if found:
                now, then = model.scores([texts[i] for i, *_ in found]), model.scores([m for *_, m in found])
                for (i, start, _), gain in zip(found, (then - now).tolist()):
                    gain -= (TAIL_COST if start else 0.0) + 2 * costs.get(TWICE, 0.0)
                    if gain > out[i][0]:
                        out[i] = gain, start, TWICE * 2
    return out


def judge(texts: list[str | None], model: charlm.CharModel, margin: float, costs: dict[tuple[str, str], float]) -> list[tuple[bool, str | None, str | None]]:
    """Of each text whether it is garbled, its original where a chain gives it, and the chain."""
    some = [t if t and not t.isascii() else "" for t in texts]
    out: list[tuple[bool, str | None, str | None]] = []
    broken = [i for i, t in enumerate(some) if _IMPOSSIBLE.search(t)]
    lost = dict(zip(broken, (model.scores([_IMPOSSIBLE.sub("", some[i]) for i in broken]) - model.scores([some[i] for i in broken])).tolist())) if broken else {}
    for i, (text, (gain, start, chain)) in enumerate(zip(some, best_repairs(some, model, costs))):
        if gain > margin:
            restored = made_by(text, start, chain)
            out.append((True, None if _IMPOSSIBLE.search(restored) else restored, ">".join(chain)))
        else:
            out.append((lost.get(i, 0.0) > margin, None, None))
    return out


def _garble(text: str, chain: tuple[str, str]) -> str | None:
    """A clean text read wrongly on purpose; None if it stays the same or can't be."""
    wrong, right = chain
    try:
        raw = text.encode(right)
    except UnicodeEncodeError:
        return None
    if wrong == "windows-1252":
        made = raw.decode("latin-1")
    else:
        made = raw.decode(wrong, "replace")
    return made if made != text else None


def _disturb(text: str, k: int) -> str:
    """A clean text with noise that is no wrong encoding: a look-alike letter, an invisible character."""
    alike = {"a": "\u0430", "e": "\u0435", "o": "\u03bf", "p": "\u0440", "K": "\u039a", "A": "\u0391", "T": "\u03a4", "M": "\u039c"}
    at = [i for i, c in enumerate(text) if c in alike]
    if at and k % 3:
        i = at[k % len(at)]
        return text[:i] + alike[text[i]] + text[i + 1 :]
    i = k % len(text)
    return text[:i] + ("\u00ad", "\u200b", "\u2060")[k % 3] + text[i:]


class Repairer:
    """The trained model with its validated margin; small enough to broadcast."""

    def __init__(self, model: charlm.CharModel, margin: float = 12.0, costs: dict[tuple[str, str], float] | None = None):
        self.model, self.margin, self.costs = model, margin, costs or {}

    def judge(self, texts: list[str | None]) -> list[tuple[bool, str | None, str | None]]:
        """(garbled, original, chain) of each text; repeated texts are judged once."""
        different = list(dict.fromkeys(texts))
        known = dict(zip(different, judge(different, self.model, self.margin, self.costs)))
        return [known[t] for t in texts]

    def __call__(self, text: str | None) -> tuple[bool, str | None, str | None]:
        return self.judge([text])[0]

    def trial(self, texts: list[str]) -> np.ndarray:
        """Clean ones of `texts` with their disturbed copies, and garbled copies of them: the numbers of both, then for
        each margin of `MARGINS` how many of both gain more. Texts count as clean unless the gain is beyond doubt; a text
        is disturbed and garbled by its own checksum, each chain as often as it occurs."""
        clean = [(t, gain) for t, (gain, *_) in zip(texts, best_repairs(texts, self.model, self.costs)) if gain <= SURE]
        sums = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t, _ in clean]
        likely = np.cumsum([np.exp(-self.costs.get(c, np.log(len(CHAINS)))) for c in CHAINS])
        drawn = np.minimum(np.searchsorted(likely, np.array(sums, float) / 2**32 * likely[-1]), len(CHAINS) - 1)
        bad = [b for (t, _), k in zip(clean, drawn) if (b := _garble(t, CHAINS[k])) and not _IMPOSSIBLE.search(b)]
        good = [_disturb(t, k) for (t, _), k in zip(clean, sums)]
        gains = [g for g, *_ in best_repairs([*good, *bad], self.model, self.costs)]
        right, hits = np.array([*(g for _, g in clean), *gains[: len(good)]]), np.array(gains[len(good) :])
        return np.array([len(right), len(hits), *(int((right > m).sum()) for m in MARGINS), *(int((hits > m).sum()) for m in MARGINS)])

    def choose(self, said: np.ndarray, ratio: float) -> None:
        """Choose the margin with the best F1 from the sum of all trials; `ratio`: clean texts of the corpus for each
        garbled one."""
        right, hits = int(said[0]), int(said[1])
        wrong, hit = said[2 : 2 + len(MARGINS)], said[2 + len(MARGINS) :]
        weight = ratio * hits / max(1, right)
        f1 = [2 * h / max(1.0, h + w * weight + hits) for h, w in zip(hit.tolist(), wrong.tolist())]
        self.curve = [(m, round(f, 4)) for m, f in zip(MARGINS, f1)]
        level = [m for m, f in zip(MARGINS, f1) if f >= max(f1) - 1e-9]
        self.margin = level[len(level) // 2]


def train(texts: DataFrame, column: str = "text") -> Repairer:
    """Train on all `texts`, again without those the first model rejects, whose chains give the share of each, and
    validate the margin."""
    spark = texts.sparkSession
    possible = texts.select(F.col(column).alias("text")).where(F.col("text").isNotNull() & ~F.col("text").rlike("[\\x{fffd}\\x80-\\x9f\\x{e000}-\\x{f8ff}]"))
    counts = charlm.count(possible)
    shared = spark.sparkContext.broadcast(charlm.CharModel(counts))

    def rejected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, off, seen = shared.value, charlm.Counts(), [0] * (len(CHAINS) + 1)
        for batch in batches:
            read = batch.column(0).to_pylist()
            best = best_repairs(read, model, {})
            off.add([t for t, (gain, *_) in zip(read, best) if gain > FIRST_MARGIN])
            for gain, _, chain in best:
                if gain > SURE and len(chain) == 2:
                    seen[CHAINS.index(chain)] += 1
            seen[-1] += len(read)
        rows = off.rows()
        more = [pa.array(a, f.type) for a, f in zip(([-1 - k for k in range(len(seen))], [0] * len(seen), seen), rows.schema)]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(rows.columns, more)], names=rows.schema.names)

    gone = cut(possible.mapInArrow(rejected, "bucket bigint, begin int, n bigint"))
    said = {-1 - r.bucket: r.n for r in gone.where("bucket < 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    by_chain = [said.get(k, 0) + 0.5 for k in range(len(CHAINS))]
    costs = {c: -float(np.log(n / sum(by_chain))) for c, n in zip(CHAINS, by_chain)}
    ratio = max(1.0, said.get(len(CHAINS), 0) / sum(by_chain))
    repairer = Repairer(charlm.CharModel(counts.less(charlm.collect(gone.where("bucket >= 0")))), costs=costs)
    tried = spark.sparkContext.broadcast(repairer)

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = np.zeros(2 + 2 * len(MARGINS), np.int64)
        for batch in batches:
            said += tried.value.trial(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(said)), pa.int32()), pa.array(said)], names=["k", "n"])

    said = possible.where("text rlike '[^\\x00-\\x7f]'").mapInArrow(trial, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    repairer.choose(np.array([r.n for r in sorted(said, key=lambda r: r.k)] or [0] * (2 + 2 * len(MARGINS))), ratio)
    return repairer


def repair(df: DataFrame, keys: list[str], column: str, repairer: Repairer) -> DataFrame:
    """The garbled rows of a table: keys, text, restored, chain. Every different text is judged once; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(repairer)
    schema = df.select(*keys, F.col(column).alias("text")).schema.add("restored", "string").add("chain", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = shared.value
        for batch in batches:
            said = repairer.judge(batch.column(batch.num_columns - 1).to_pylist())
            keep = [i for i, s in enumerate(said) if s[0]]
            if keep:
                rows = batch.take(pa.array(keep))
                extra = [pa.array([said[i][k] for i in keep], pa.string()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *extra], names=[*rows.schema.names, "restored", "chain"])

    return df.select(*keys, F.col(column).alias("text")).mapInArrow(run, schema)


def sources(spark: SparkSession, sf_dir: str, roles: bool = False) -> DataFrame:
    """Page titles and credited names as (tab, rec_id, text), flattened once and written to the shared folder; with the
    role of each name where asked for (null for titles)."""
    pages = table(spark, sf_dir, "seesaa_client").select(F.lit("seesaa_client").alias("tab"), F.col("page_id").cast("string").alias("rec_id"), F.col("title").alias("text"), F.lit(None).cast("string").alias("role"))
    names = flatten_credits(table(spark, sf_dir, "anime_metadata")).select(F.lit("anime_metadata").alias("tab"), F.col("work_id").alias("rec_id"), F.col("name").alias("text"), "role")
    both = pages.unionByName(names)
    return cut((both if roles else both.drop("role")).distinct())


def garbled(texts: DataFrame) -> DataFrame:
    """(tab, rec_id, text, restored, chain) of all garbled ones of (tab, rec_id, text), each once."""
    different = cut(texts.select("text").distinct())
    found = cut(repair(different, [], "text", train(different)))
    return texts.join(found, "text").select("tab", "rec_id", "text", "restored", "chain")
