"""Personal data in free text by a skip-chain conditional random field.

Nodes are candidate spans that patterns of form propose (mail addresses, number groups, street addresses, capitalised
or ideographic names); their labels are the kinds of personal data or none. Neighbouring candidates share chain
potentials; repeated or similar candidates of a document, however far apart, share skip potentials (a name and the
mail address made of it, the same number twice). Labels come from the beliefs of loopy message passing over all
candidates of all documents of a batch.

There are no labelled rows and no list of phrases: the silver labels come from the corpus. Mail addresses, and numbers
whose form leaves no doubt, are sure; personal data comes in company, so a context (the characters before a candidate)
whose documents hold further sure items far more often than others announces personal data, and one whose documents
don't announces none; contexts end with the sentence, and one that is
followed by the same few strings announces no names but is a phrase with them. A word that often stands before numbers is their label and no name. A number that could be either kind takes the kind of the sure numbers in the same context; a
candidate that stands alone is labelled by its words, learned where contexts tell. All this is counted over a sample
of at most `TRAIN_DOCS` documents, chosen by hash. The unary weights are fitted by stochastic gradient descent on
hashed features of form, context and words, the chain and skip potentials by piecewise training.

Defined results: null, empty and white-space texts have no items; texts of any length are read whole; places count
code points; repeated rows give their items once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orizuru.session import hashed_sample, spread

LABELS = ("none", "email", "phone", "id_number", "address", "name")
FORMS = ("email", "number", "address", "name")
#: Labels a form may have; the first is none.
SLOTS = ((0, 1), (0, 2, 3), (0, 4), (0, 5))
TRAIN_DOCS = 12_000
BUCKETS = 1 << 17
EPOCHS = 4
NEAR = 60  # characters between neighbours that share a chain potential
ROUNDS = 6
LEAST = 8  # candidates that a context needs to tell anything
#: How far between the share of all documents with sure items and all of them a context's share has to lie.
TELLS, DENIES = 0.25, 0.15
DOMINANT = 0.4  # largest share of one string in a context that announces names

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|．|\s?[\[(（]\s?(?:dot|DOT)\s?[\])）]\s?|\s(?:dot|DOT)\s)"
_AT = r"(?:[@＠]|\s?[\[(（]\s?(?:at|AT)\s?[\])）]\s?|\s(?:at|AT)\s)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._+@＠/-])[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}")
_K = "㐀-䶿一-鿿々〆ヶケ"
ADDRESS = re.compile(
    rf"(?:〒\s?\d{{3}}[-－‐–]?\d{{4}}\s*)?[{_K}]{{1,4}}?[都道府県][{_K}ァ-ヴーぁ-ん]{{1,8}}?[市郡区町村][{_K}ァ-ヴー ぁ-ん　]{{0,60}}?(?:[0-9０-９]+|[一二三四五六七八九十]+丁目)"
    rf"(?:[-－‐–]|丁目|番地の?|番|号|[0-9０-９]+|[一二三四五六七八九十]+(?=丁目))*(?:[ 　]?(?:第[0-9]+)?[{_K}ァ-ヴー]{{2,12}}[0-9０-９]{{1,4}}(?:号室|号)?)?"
    rf"|〒\s?\d{{3}}[-－‐–]?\d{{4}}[^\n。、]{{4,}}"
    r"|(?<![A-Za-z0-9])(?:(?:Flat|Apt|Unit|Suite)\.? \d+[A-Z]?, )?\d{1,5}[A-Za-z]? (?:[A-Z][a-z']+ ){1,3}(?:Street|Lane|Road|Avenue|Row|Close|Way|Terrace|Drive|Hill|Court|Place|Square|Gardens|Crescent|Boulevard|St|Rd|Ave|Ln)\b\.?(?:, (?:(?:Apt|Flat|Unit|Suite)\.? ?\w+|[A-Z][a-z]+(?: [A-Z][a-z]+)*(?: \d{4,5})?))*"
    rf"|[{_K}]{{2,4}}?市[{_K}]{{1,4}}?[区县][{_K}]{{1,8}}?[路街道巷]\d+号(?:\d+(?:单元|栋|楼|室|号))*"
)
NUMBER = re.compile(r"(?<![0-9０-９A-Za-z.,/+＋-])(?<!\d:)(?:[A-Z]{2} ?)?(?:[+＋]?[(（]?)\d(?:[ .．\-－‐‑–−ー()（）]{0,2}\d){6,}(?: ?[A-DXx](?![A-Za-z]))?(?!\d)")
#: Identity numbers that begin with two letters; their form is evidence enough with six or seven digits.
LETTERED = re.compile(r"(?<![0-9０-９A-Za-z.,/+＋-])(?<!\d:)(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![0-9０-９A-Za-z])|[A-Z]{2}\d{7}(?![0-9０-９A-Za-z]))")
_WORD = r"[A-Z][a-zà-ÿ]+|[A-Z]{2,}(?![a-z])"
NAME = re.compile(
    rf"(?:{_WORD})(?:,? (?:[A-Z]\. )?|, )(?:{_WORD})(?: [A-Z]\.)?"
    rf"|[{_K}]{{1,3}}[ 　][{_K}]{{1,4}}(?![{_K}])|[{_K}]{{3,}}|[ァ-ヴー]{{2,6}}[ 　][ァ-ヴー]{{2,6}}(?![ァ-ヴー])|[ァ-ヴー]{{5,}}|[ぁ-ん]{{3,6}}[ 　][ぁ-ん]{{2,6}}(?![ぁ-ん])"
)
#: Words before a name that would read as a part of it.
BEFORE_NAME = re.compile(r"^(?:お?名前|氏名|担当|我叫|联系人|姓名|我是|Best|Dear|Please|By|From|Write|Call|Phone|The|My|Ms|Mr|Mrs|Dr|Posted|Name|Address|Flat|Apt)[ 　:：,.]*(?=\S)")
BEFORE_ADDRESS = re.compile(r"^(?:寄到|寄往|送到|地址|住址|住在|现住|住所|送り先|現在)+[ :：]?")
_AFTER_NAME = re.compile(r"[ 　](?:様|さん|氏|殿|先生)$")

#: Forms of numbers that leave no doubt: of identity numbers (fixed values of their issuers) and of phones.
ID_FORM = re.compile(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{2}\d{7}|\d{17}[\dXx]|9\d{2}[- ]\d{2}[- ]\d{4}")
PHONE_FORM = re.compile(r"[+＋]\d.*|1?[-. ]?[(（]?\d{3}[)）]?[-. ]\d{3}[-. ]\d{4}")
PHONE_DIGITS = (10, 11)  # of a number that begins with 0

Span = tuple[int, int, str]  # start, end, form


def candidates(text: str) -> list[Span]:
    """Candidate spans in order; none overlaps another."""
    found: list[Span] = []
    taken = np.zeros(len(text) + 1, bool)

    def take(start: int, end: int, form: str) -> None:
        if end > start and not taken[start:end].any():
            taken[start:end] = True
            found.append((start, end, form))

    if "@" in text or "＠" in text or "at" in text or "AT" in text:
        for m in EMAIL.finditer(text):
            take(m.start(), m.end(), "email")
    for m in ADDRESS.finditer(text):
        lead = BEFORE_ADDRESS.match(m.group())
        take(m.start() + (lead.end() if lead else 0), m.end(), "address")
    for m in NUMBER.finditer(text):
        start, body = m.start(), m.group()
        for left, right in ("()", "（）"):
            if body.startswith(left) and right not in body:
                start, body = start + 1, body[1:]
        take(start, m.end(), "number")
    for m in LETTERED.finditer(text):
        take(m.start(), m.end(), "number")
    for m in NAME.finditer(text):
        start, end = m.span()
        cut = BEFORE_NAME.match(text[start:end])
        if cut:  # the words before are no part of it; look again behind them
            again = NAME.match(text, start + cut.end())
            if not again:
                continue
            start, end = again.span()
        tail = _AFTER_NAME.search(text[start:end])
        take(start, end - len(tail.group()) if tail else end, "name")
    found.sort()
    return found


def sure(text: str, span: Span) -> int:
    """The label that the form of a candidate alone tells, or -1."""
    body = text[span[0] : span[1]]
    if span[2] == "email":
        return 1
    if span[2] == "number":
        digits = [c for c in body if c.isdecimal()]
        local = int(digits[0]) == 0 and len(digits) in PHONE_DIGITS
        return 3 if ID_FORM.fullmatch(body) else 2 if local or PHONE_FORM.fullmatch(body) else -1
    return -1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point of the basic plane: itself with digits as 9 and white space as two signs, in lower case, and
    as a shape. Others stand for themselves in one place."""
    flat, low, shape = (np.arange(0x10001, dtype=np.uint64) for _ in range(3))
    for c in range(0x10000):
        ch = chr(c)
        if ch.isdecimal():
            flat[c] = ord("9")
        small = ch.lower()
        if len(small) == 1:
            low[c] = ord(small)
    for chars, to in (("\n\r", "\\"), ("\t　", " ")):
        for ch in chars:
            flat[ord(ch)] = ord(to)
    shape[:] = flat
    shape[ord("A") : ord("Z") + 1], shape[ord("a") : ord("z") + 1] = ord("A"), ord("a")
    return flat, low, shape


_P = np.uint64(0x100000001B3)
_INV = np.uint64(pow(0x100000001B3, -1, 1 << 64))


class _Hashes:
    """Hashes of any stretch of a text: prefix sums of its codes times powers of an odd number, modulo 2**64."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _P, np.uint64))])
        self.back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _INV, np.uint64))])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * power[:-1], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        end = np.maximum(start, end)
        return (self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64)


def _mixed(h: np.ndarray, tag: int) -> np.ndarray:
    h = (h ^ np.uint64(tag * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h * np.uint64(0xC4CEB9FE1A85EC53)


WORDS = 5  # the last columns of `Batch.features`


class Batch:
    """The candidates of many texts with their features, contexts and edges."""

    def __init__(self, texts: list[str]):
        self.spans = [candidates(t) for t in texts]
        self.doc = np.repeat(np.arange(len(texts)), [len(x) for x in self.spans])
        n = len(self.doc)
        self.form = np.array([FORMS.index(f) for x in self.spans for *_, f in x], np.int64)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        at = begins[self.doc]
        self.start = np.array([a for x in self.spans for a, *_ in x], np.int64) + at
        self.end = np.array([b for x in self.spans for _, b, _ in x], np.int64) + at
        self.texts = texts
        if not n:
            return
        codes = np.minimum(np.frombuffer(("\x00".join(texts) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32), 0x10000)
        flat, low, shape = (t[codes] for t in _tables())
        first, last = at, begins[self.doc + 1] - 1  # bounds of the text
        place = np.arange(len(codes))
        solid = np.maximum.accumulate(np.where(flat != ord(" "), place, -1))
        trimmed = np.maximum(first, np.where(self.start > 0, solid[np.maximum(self.start - 1, 0)] + 1, 0))
        word_break = np.isin(codes, [ord(c) for c in " 　,."])
        after = np.minimum.accumulate(np.where(word_break, place, len(codes))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(word_break, place, -1))
        flat_of, low_of = _Hashes(flat), _Hashes(low)
        kept = ~((shape == ord("a")) & np.concatenate([[False], shape[:-1] == ord("a")]))  # runs of small letters are one
        rank = np.concatenate([[0], np.cumsum(kept)])
        shape_of = _Hashes(shape[kept])
        left = lambda end, k: flat_of(np.maximum(first, end - k), end)
        right = lambda k: flat_of(self.end, np.minimum(last, self.end + k))
        # a context lies in the sentence of its candidate
        mark = np.isin(codes, [ord(c) for c in "。！？!?\n\r\t　…"])
        letter = (flat == ord("9")) | (shape == ord("a")) | (shape == ord("A")) | np.isin(codes, [ord(c) for c in ")]>）"])
        long_word = np.concatenate([[False] * 4, letter[3:-1] & letter[2:-2] & letter[1:-3] & letter[:-4]])
        mark |= (codes == ord(".")) & long_word  # no abbreviation
        mark |= (flat == ord(" ")) & np.concatenate([[False], flat[:-1] == ord(" ")])
        since = np.maximum(first, np.maximum.accumulate(np.where(mark, place + 1, 0))[np.maximum(self.start - 1, 0)])
        until = np.minimum(last, np.minimum.accumulate(np.where(mark, place + 1, len(codes))[::-1])[::-1][self.end])
        self.alone = (trimmed - since <= 1) & (until - self.end <= 2)  # a bracket at most
        self.leads = np.concatenate([(self.start[1:] - self.end[:-1] <= 5) & (self.form[1:] < 2) & (self.doc[1:] == self.doc[:-1]), [False]])
        word = lambda a, b: np.where(self.form == 3, low_of(a, b), np.uint64(0))
        whole, begin, tail = low_of(self.start, self.end), low_of(self.start, np.minimum(self.end, after[self.start])), low_of(np.maximum(self.start, before[self.end - 1] + 1), self.end)
        columns = [
            np.zeros(n, np.uint64), shape_of(rank[self.start], rank[self.end]), (self.end - self.start).astype(np.uint64), low_of(self.start, self.start + 1), flat_of(self.start, self.start + 2),
            *[left(self.start, k) for k in (1, 2, 3, 5, 8)], *[left(trimmed, k) for k in (1, 2, 4, 6, 10)], *[right(k) for k in (1, 2, 3, 5, 8)], self.alone.astype(np.uint64),
            whole, begin, tail, word(self.start, np.minimum(self.end, self.start + 2)), word(np.maximum(self.start, self.end - 2), self.end),
        ]
        same = (len(columns) - 3, len(columns) - 4)  # a family or given name counts alike in either place
        tags = [min(same) if k in same else k for k in range(len(columns))]
        form = self.form.astype(np.uint64)
        self.features = np.stack([(_mixed(h * np.uint64(4) + form, t + 1) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1) for h, t in zip(columns, tags)], 1).astype(np.int32)
        own = [np.where(trimmed - since > 1, _mixed(flat_of(np.maximum(since, trimmed - k), np.maximum(since, trimmed)) * np.uint64(4) + form, k), np.uint64(0)) for k in (3, 5, 8)]
        own += [np.where(until - self.end > 1, _mixed(flat_of(self.end, np.minimum(until, self.end + k)) * np.uint64(4) + form, 20 + k), np.uint64(0)) for k in (4, 8)]
        self.contexts = np.stack([*own, _mixed(whole * np.uint64(4) + form, 30)], 1).view(np.int64)
        self._keys = whole, begin, tail

    def sure(self) -> np.ndarray:
        return np.array([sure(t, x) for t, spans in zip(self.texts, self.spans) for x in spans], np.int64)

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, kind): neighbours (0), and each candidate with the last one before it that repeats it or shares a word
        with it (1)."""
        n = len(self.doc)
        i = np.arange(n - 1) if n else np.zeros(0, np.int64)
        chain = i[(self.doc[i] == self.doc[i + 1]) & (self.start[i + 1] - self.end[i] < NEAR)]
        whole, begin, tail = self._keys
        names = np.flatnonzero(self.form == 3)
        many = names[(begin != whole)[names]]
        keys = [(names, whole[names]), (many, begin[many]), (many, tail[many])]
        more: list[tuple[int, int]] = []
        for k in np.flatnonzero(self.form != 3).tolist():
            text, base = self.texts[self.doc[k]], self.start[k]
            body = text[(a := int(base - self._begin(k))) : a + int(self.end[k] - base)]
            parts = {re.sub(r"[\s\-.()]", "", body)}
            if self.form[k] == 0:
                parts |= {w for w in re.split(r"[^a-z]+", re.split(r"[@＠\s\[(]", body)[0].lower()) if len(w) > 3}
            for w in parts:
                c = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                more.append((k, int(_Hashes(_tables()[1][np.minimum(c, 0x10000)])(np.array([0]), np.array([len(c)]))[0])))
        if more:
            keys.append((np.array([k for k, _ in more]), np.array([h for _, h in more], np.uint64)))
        node, key = np.concatenate([k for k, _ in keys]), np.concatenate([h for _, h in keys])
        order = np.lexsort((node, key, self.doc[node]))
        node, key = node[order], key[order]
        pair = (key[1:] == key[:-1]) & (self.doc[node[1:]] == self.doc[node[:-1]]) & (node[1:] != node[:-1])
        skip = np.unique(np.stack([node[:-1][pair], node[1:][pair]], 1), axis=0)
        return np.concatenate([chain, skip[:, 0]]), np.concatenate([chain + 1, skip[:, 1]]), np.concatenate([np.zeros(len(chain), np.int64), np.ones(len(skip), np.int64)])

    def _begin(self, k: int) -> int:
        """Where the text of a candidate begins among all."""
        return int(self.start[k]) - self.spans[self.doc[k]][k - int(np.searchsorted(self.doc, self.doc[k]))][0]


class Field:
    """The trained field: unary weights and potentials of chain and skip edges; of fixed size."""

    def __init__(self):
        self.w = np.zeros((BUCKETS, len(LABELS)), np.float32)
        self.chain = np.zeros((len(LABELS), len(LABELS)), np.float32)
        self.skip = np.zeros((len(LABELS), len(LABELS)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, forms: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        """x: feature numbers; forms: 0 for allowed labels; chain, skip: counts of label pairs."""
        n, k = len(x), len(LABELS)
        rng = np.random.default_rng(7)
        square = np.full_like(self.w, 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for at in range(0, n, 512):
                b = order[at : at + 512]
                score = self.w[x[b]].sum(1) + forms[b]
                p = np.exp(score - score.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(b)), y[b]] -= 1
                flat = x[b].reshape(-1)
                order_ = np.argsort(flat, kind="stable")
                idx, first = np.unique(flat[order_], return_index=True)
                total = np.add.reduceat((p / 8).astype(np.float32)[order_ // x.shape[1]], first)
                square[idx] += total**2
                self.w[idx] -= 0.3 * total / np.sqrt(square[idx]) + 1e-5 * self.w[idx]
        for name, counts in (("chain", chain), ("skip", skip)):
            both = counts + counts.T + 1.0
            p = both / both.sum()
            m = p.sum(1)
            setattr(self, name, np.clip(np.log(p / np.outer(m, m)), -2, 2).astype(np.float32) * (0.25 if name == "chain" else 0.75))

    def label(self, batch: Batch) -> np.ndarray:
        """Labels of all candidates of a batch by loopy sum-product, over the few labels that each form may have."""
        slots = np.array([(*s, *[s[-1]] * (3 - len(s))) for s in SLOTS])
        room = np.array([[k < len(s) for k in range(3)] for s in SLOTS])
        own = slots[batch.form]
        score = np.zeros((len(batch.form), len(LABELS)), np.float32)
        for column in range(batch.features.shape[1]):
            score += self.w[batch.features[:, column]]
        unary = np.where(room[batch.form], np.take_along_axis(score, own, 1), -1e9)
        belief = unary
        a, b, kind = batch.edges()
        if len(a):
            tables = np.stack([self.chain, self.skip])
            table = tables[:, slots[:, None, :, None], slots[None, :, None, :]]  # kind, form, form, slot, slot
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            both = np.concatenate([kind, kind])
            edge = table[both, batch.form[source], batch.form[target]]
            back = np.concatenate([np.arange(len(a), 2 * len(a)), np.arange(len(a))])
            order = np.argsort(target, kind="stable")
            heads, first = np.unique(target[order], return_index=True)
            message = np.zeros((2 * len(a), 3), np.float32)
            for _ in range(ROUNDS + 1):
                belief = unary.copy()
                belief[heads] += np.add.reduceat(message[order], first)
                out = (belief[source] - message[back])[:, :, None] + edge
                top = out.max(1)
                new = np.log(np.exp(out - top[:, None]).sum(1)) + top
                message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True)).astype(np.float32)
        return np.take_along_axis(own, belief.argmax(1)[:, None], 1)[:, 0]

    def items_of(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the items of each text."""
        batch = Batch([t if t and not t.isspace() else "" for t in texts])
        if not len(batch.doc):
            return [[] for _ in texts]
        said = iter(self.label(batch).tolist())
        return [[(a, b, LABELS[y]) for (a, b, _), y in [(x, next(said)) for x in spans] if y] for spans in batch.spans]

    def items(self, text: str | None) -> list[tuple[int, int, str]]:
        return self.items_of([text])[0]


_PARTS = 512  # texts of a part of a batch


def _parts(column: pa.Array) -> Iterator[list[str | None]]:
    for at in range(0, len(column), _PARTS):
        yield column.slice(at, _PARTS).to_pylist()


def evidence(doc: np.ndarray, form: np.ndarray, known: np.ndarray, contexts: np.ndarray, alone: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Silver labels of candidates, -1 where the corpus tells nothing: see the module's docstring."""
    seeds = np.bincount(doc, known > 0, int(doc.max()) + 1)
    base = float((seeds > 0).sum()) / max(1, len(np.unique(doc)))
    company = (seeds[doc] - (known > 0)) > 0
    share, seen, kinds = (np.zeros((len(doc), contexts.shape[1] - 1, *more)) for more in ((), (), (2,)))
    contexts, word = contexts[:, :-1], np.unique(contexts[:, -1], return_inverse=True)[1]
    varied = np.zeros(contexts.shape, bool)
    for k in range(contexts.shape[1]):
        _, key = np.unique(contexts[:, k], return_inverse=True)
        n = np.bincount(key) * (contexts[:, k] != 0)[np.unique(key, return_index=True)[1]]  # 0: no context
        pairs, many = np.unique(np.stack([key, word], 1), axis=0, return_counts=True)  # strings in the context
        top = np.zeros(len(n))
        np.maximum.at(top, pairs[:, 0], many)
        varied[:, k] = ((np.bincount(pairs[:, 0], minlength=len(n)) >= 4) & (top <= DOMINANT * n))[key]
        share[:, k] = ((np.bincount(key, company) + 2 * base) / (n + 2))[key]
        seen[:, k] = n[key]
        for j, label in enumerate((2, 3)):
            kinds[:, k, j] = np.bincount(key, known == label)[key]
    floor, ceiling = base + TELLS * (1 - base), base + DENIES * (1 - base)
    slack = np.sqrt(np.maximum(share * (1 - share), 0.02) / np.maximum(seen, 1))
    says = np.where(seen >= LEAST, np.where((share - slack > floor) & (varied | (form != 3)[:, None]), 1, np.where(share + slack < ceiling, -1, 0)), 0)
    verdict = np.zeros(len(doc), np.int64)
    for k in (2, 4, 1, 3, 0):  # the longest context that tells or denies decides
        verdict = np.where(verdict == 0, says[:, k], verdict)
    tells, denies = verdict > 0, verdict < 0
    # a word that stands before numbers or addresses is their label, no name
    ahead = np.bincount(word, leads & (form == 3))
    title = (form == 3) & ((ahead >= 3) & (ahead > 0.4 * np.bincount(word)))[word]
    n = np.bincount(word)
    held = (np.bincount(word, company) + 2 * base) / (n + 2)
    usual = (n >= LEAST) & (held + np.sqrt(np.maximum(held * (1 - held), 0.02) / n) < ceiling)
    denies |= (form == 3) & usual[word] & ~tells  # a string of all sorts of documents
    tells, denies = tells & ~denies & ~title, (denies & ~tells) | title
    out = np.where(denies, 0, -1)
    number, phone, open_ = form == 1, np.zeros(len(doc), bool), np.ones(len(doc), bool)
    for k in (2, 1, 0, 4, 3):  # the longest context with sure numbers, first those on the left
        some = open_ & (kinds[:, k].sum(1) > 0) & (contexts[:, k] != 0)
        phone[some], open_[some] = (kinds[:, k, 0] >= kinds[:, k, 1])[some], False
    told = np.where(number, np.where(open_, -1, np.where(phone, 2, 3)), np.array([1, 2, 4, 5])[form])
    out[tells] = told[tells]
    out = np.where(number & (known > 0) & ~denies, known, out)
    out[form == 0] = 1
    return np.where(alone & (form == 3) & ~tells, -1, out)


def train(documents: DataFrame) -> Field:
    """Fit the field on a bounded sample of the different texts."""
    sample = hashed_sample(documents.where("length(text) > 20").select("text"), TRAIN_DOCS).repartition(24, F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for texts in _parts(whole.column(0)):
                batch = Batch(texts)
                if not len(batch.doc):
                    continue
                known = batch.sure()
                a, b, kind = batch.edges()
                first = np.searchsorted(batch.doc, np.arange(len(texts) + 1))
                rows = []
                for d in range(len(texts)):
                    lo, hi = first[d], first[d + 1]
                    if hi > lo:
                        mine = (a >= lo) & (a < hi)
                        rows.append((batch.form[lo:hi], known[lo:hi], batch.features[lo:hi].ravel(), batch.contexts[lo:hi].ravel(), batch.alone[lo:hi] + 2 * batch.leads[lo:hi].astype(np.int64), np.stack([a[mine] - lo, b[mine] - lo, kind[mine]], 1).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["form", "known", "x", "contexts", "alone", "edges"])

    rows = sample.mapInArrow(run, "form array<bigint>, known array<bigint>, x array<int>, contexts array<bigint>, alone array<bigint>, edges array<bigint>").toArrow().combine_chunks()
    field = Field()
    if not rows.num_rows:
        return field
    get = lambda c: rows.column(c).combine_chunks().values.to_numpy()
    size = np.diff(rows.column("form").combine_chunks().offsets.to_numpy())
    doc, form = np.repeat(np.arange(len(size)), size), get("form")
    x = get("x").reshape(len(form), -1)
    y = evidence(doc, form, get("known"), get("contexts").reshape(len(form), -1), get("alone") % 2 > 0, get("alone") > 1)
    edges = get("edges").reshape(-1, 3)
    many = np.diff(rows.column("edges").combine_chunks().offsets.to_numpy()) // 3
    ends = edges[:, :2] + np.repeat(np.cumsum(size) - size, many)[:, None]
    allowed = np.full((len(FORMS), len(LABELS)), -30.0, np.float32)
    for i, labels in enumerate(SLOTS):
        allowed[i, list(labels)] = 0

    def potentials(y: np.ndarray) -> list[np.ndarray]:
        both = (y[ends] >= 0).all(1)
        return [np.bincount(y[ends[m, 0]] * 6 + y[ends[m, 1]], minlength=36).reshape(6, 6).astype(float) for m in (both & (edges[:, 2] == 0), both & (edges[:, 2] == 1))]

    keep = y >= 0
    if not keep.any():
        return field
    field.fit(x[keep], y[keep], allowed[form[keep]], *potentials(y))
    # candidates that stand alone have no context; their words, learned where contexts tell, do
    words = field.w[x[:, -WORDS:]].sum(1) + allowed[form]
    guess = np.where(words[:, 1:].max(1) > words[:, 0] + 0.5, words[:, 1:].argmax(1) + 1, 0)
    y = np.where((y < 0) & (get("alone") % 2 > 0), guess, y)
    keep = y >= 0
    again = Field()
    again.fit(x[keep], y[keep], allowed[form[keep]], *potentials(y))
    return again


def find(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, kind, start_at, end_at) of all items; only the training shuffles."""
    shared = documents.sparkSession.sparkContext.broadcast(field or train(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            ids, kinds, starts, ends = [], [], [], []
            docs = iter(batch.column(0).to_pylist())
            for texts in _parts(batch.column(1)):
                for found in field.items_of(texts):
                    doc = next(docs)
                    for start, end, kind in found:
                        ids.append(doc), kinds.append(kind), starts.append(start), ends.append(end)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "kind", "start_at", "end_at"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, kind string, start_at bigint, end_at bigint").distinct()


def redact(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, text) with a placeholder such as [EMAIL] for each item; texts without items stay as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(field or train(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            out = []
            for texts in _parts(batch.column(1)):
                for text, found in zip(texts, field.items_of(texts)):
                    for start, end, kind in reversed(found):
                        text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
                    out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, text string")
