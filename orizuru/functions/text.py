"""Search and title forms of texts. All but NFKC are built-in expressions; NFKC runs as one Arrow UDF on titles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
#: Archaic kana and their modern forms, and the signs a search ignores.
ARCHAIC = ("ヱゑヲをヰゐヴゔ", "エえオおイいブぶ")
IGNORED = "・･ 　:：~～-—─!！?？☆★|｜│▌"
#: Notes in brackets that name no title.
BRACKETED_NOTE = r"[\(（\[【][^()（）\[\]【】]*?(?:\d{4}|年|第\d|期|TV|放送|版)[^()（）\[\]【】]*?[\)）\]】]"
#: All white space; the regular expressions of the JVM count only that of ASCII.
SPACES = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Signs that titles and searches ignore.
TITLE_SIGNS = rf"[・★☆◆◇♪!！?？:：\-—_~～'\"`「」『』{SPACES}]+"
CLIENT_SIGNS = rf"[{SPACES}\x{{feff}}\-_・:：,，.．!！?？/／★☆♪〜~]"
#: Brackets, media prefixes and separators that candidates are compared without.
ANY_BRACKET = r"[\(（\[【].*?[\)）\]】]"
MEDIA_PREFIX = rf"^(劇場版|映画|アニメ|TVアニメ|OVA)[{SPACES}]*"
CANDIDATE_BREAK = rf"[{SPACES}:\-_・]+"
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(ord(c) - 0xFEE0) for c in FULL_WIDTH)


@F.udf(T.StringType(), useArrow=True)
def nfkc(text):
    return None if text is None else unicodedata.normalize("NFKC", text)


def search_form(text: Column) -> Column:
    """NFKC, lower case, modern kana, no punctuation, hiragana as katakana; empty for null."""
    t = F.translate(F.lower(nfkc(F.coalesce(text, F.lit("")))), ARCHAIC[0] + IGNORED, ARCHAIC[1])
    return F.translate(t, HIRAGANA, KATAKANA)


def title_form(text: Column) -> Column:
    """NFKC, bracketed notes off, katakana as hiragana, signs and white space off, lower case."""
    t = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), BRACKETED_NOTE, "")
    return F.lower(F.regexp_replace(F.translate(t, KATAKANA, HIRAGANA), TITLE_SIGNS, ""))


def client_form(text: Column) -> Column:
    """The browser's search form: lower case, half width, hiragana, modern kana, no signs."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), FULL_WIDTH, HALF_WIDTH)
    t = F.translate(F.translate(t, KATAKANA, HIRAGANA), "ゑゐをゔ", "えいおぶ")
    return F.regexp_replace(t, CLIENT_SIGNS, "")


def search_form_of(text: str) -> str:
    """`search_form` of a given text, without a job."""
    t = unicodedata.normalize("NFKC", text).lower().translate(str.maketrans(ARCHAIC[0], ARCHAIC[1], IGNORED))
    return t.translate(str.maketrans(HIRAGANA, KATAKANA))


def client_form_of(text: str) -> str:
    """`client_form` of a given text, without a job."""
    t = text.lower().translate(str.maketrans(FULL_WIDTH, HALF_WIDTH))
    t = t.translate(str.maketrans(KATAKANA, HIRAGANA)).translate(str.maketrans("ゑゐをゔ", "えいおぶ"))
    return "".join(c for c in t if not c.isspace() and c not in "\ufeff-_・:：,，.．!！?？/／★☆♪〜~")


def candidate_form(text: Column) -> Column:
    """The form candidates are compared in: brackets and media prefix off, signs unified, white space collapsed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), ANY_BRACKET, " ")
    t = F.regexp_replace(t, MEDIA_PREFIX, "")
    t = F.translate(t, "／～☆★", "/~")
    return F.lower(F.trim(F.regexp_replace(t, CANDIDATE_BREAK, " ")))


#: Words that distinguish no subtitle.
SUBTITLE_STOP = ("劇場版", "映画", "アニメ", "シリーズ", "テレビ", "スペシャル", "第", "期", "the", "movie", "ova", "tv")
#: Fixed value: what a subtitle is made of.
SUBTITLE_WORD = r"[\u3040-\u30ff\u4e00-\u9faf0-9a-zA-Z]{2,}(?:篇|編|巻|期)?"


def subtitles(text: Column) -> Column:
    """Words of a title that may distinguish it from others of its series."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SUBTITLE_WORD), F.lit(0))
    return F.filter(found, lambda w: ~F.lower(w).isin(*SUBTITLE_STOP) & (F.length(w) >= 2))


def year_of_date(date: Column) -> Column:
    """Year of a date text, null where it doesn't begin with four digits."""
    return F.when(date.rlike("^[0-9]{4}"), F.substring(date, 1, 4).cast("int"))
