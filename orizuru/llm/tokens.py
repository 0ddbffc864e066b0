"""Encode texts with a public byte-level BPE by reuse of content-defined chunks.

A rolling hash over the code points cuts every text at places that depend only on the characters before them, so that
copied passages fall into equal chunks wherever they stand. Each different chunk of a task is encoded once. Where two
chunks meet, the words on both sides of the cut are encoded again as one piece, from the last place of the left chunk
to the first of the right chunk at which both scans agree: a place between a letter and a character that is none is a
word boundary of the tokenizer whatever stands around it, as no word of its pattern goes over it and none looks
across it. The result is exactly the encoding of the whole text; a text without such places is one piece.

Reuse is kept within a task on purpose: sharing chunks between executors would shuffle the corpus, which costs more
than encoding a chunk again. The cache only saves work; it is emptied when it exceeds `CACHE_CHARS`.

Defined results: null and empty texts give an empty list; white-space texts are encoded as they are; special tokens
are ordinary text; lone surrogates are replaced as the tokenizer does.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orizuru.session import spread

WINDOW = 6  # code points that decide a cut
MASK = 127  # a cut every 128 code points on average
CACHE_CHARS = 32_000_000


@lru_cache(maxsize=2)
def encoding(path: str | None = None):
    """The public tokenizer byte_bpe_50k; `path` is its rank file."""
    import public_tokenizers as public
    import tiktoken

    with open(path or public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points of the basic plane are letters, and which are assigned and none; all others are neither."""
    kinds = [unicodedata.category(chr(c)) for c in range(0x10000)]
    return np.array([k[0] == "L" for k in kinds] + [False]), np.array([k[0] in "ZPSN" or k == "Cc" for k in kinds] + [False])


def pieces(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one, the bounds of their pieces in it, and how many pieces each text has.

    The pieces of a text are its chunks, without the words next to a cut, and between them those words."""
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    n = len(codes)
    if n <= WINDOW:
        return whole, np.unique(np.concatenate([[0], ends])), (ends > starts).astype(np.int64)
    points = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):  # the hash of a window as a polynomial; wraps modulo 2**64
        mixed = mixed * np.uint64(0x100000001B3) + points[k : n - WINDOW + 1 + k]
    cut_at = np.flatnonzero(((mixed >> np.uint64(29)) & np.uint64(MASK)) == 0) + WINDOW
    begin = starts[np.searchsorted(ends, cut_at - 1, side="right")]
    cut_at = cut_at[cut_at - WINDOW >= begin]  # the window lies inside one text
    letter, none = (a[np.minimum(codes, 0x10000)] for a in _letters())
    edges = np.unique(np.concatenate([[0], ends]))
    agreed = np.union1d(np.flatnonzero(letter[:-1] & none[1:]) + 1, edges)
    left = agreed[np.searchsorted(agreed, cut_at, side="right") - 1]
    right = agreed[np.minimum(np.searchsorted(agreed, cut_at, side="left"), len(agreed) - 1)]
    bounds = np.unique(np.concatenate([edges, left, right]))
    return whole, bounds, np.searchsorted(bounds, ends) - np.searchsorted(bounds, starts)


class ChunkEncoder:
    """Encodes texts, each different piece once while it is cached."""

    def __init__(self, path: str | None = None):
        self.enc = encoding(path)
        self.known: dict[str, list[int]] = {}
        self.size = self.encoded = self.reused = 0  # in characters

    def encode_all(self, texts: list[str | None]) -> tuple[list[list[int]], list[int]]:
        """The ids of all pieces in order, and the number of pieces of each text."""
        if self.size > CACHE_CHARS:
            self.known.clear()
            self.size = 0
        whole, bounds, many = pieces([t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if t else "" for t in texts])
        known, encode, out = self.known, self.enc.encode_ordinary, []
        places, fresh = bounds.tolist(), 0
        for a, b in zip(places, places[1:]):
            piece = whole[a:b]
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = encode(piece)
                fresh += b - a
            out.append(ids)
        self.size += fresh
        self.encoded += fresh
        self.reused += len(whole) - fresh
        return out, many.tolist()

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.encode_all([text])[0] for i in ids]

    def columns(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        """The ids of each text, and their number."""
        ids, many = self.encode_all(texts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        before = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(many, dtype=np.int64)])]
        values = np.fromiter((i for part in ids for i in part), np.int32, int(sizes.sum()))
        return pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(values)), pa.array(np.diff(before), pa.int32())

    def counts(self, texts: list[str | None]) -> pa.Array:
        ids, many = self.encode_all(texts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return pa.array(np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(many, dtype=np.int64)])]), pa.int32())


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>) of each row; no shuffle."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.columns(batch.column(1).to_pylist())[0]], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, schema)


def count_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens int) of each row; no shuffle."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.counts(batch.column(1).to_pylist())], names=[key, "n_tokens"])

    return spread(df.select(key, text)).mapInArrow(run, schema)
