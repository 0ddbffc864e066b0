"""Smoothed character bigram models over all texts of a corpus, in hashed tables sized by the data.

Counting is distributed: each task counts into hashed buckets, the buckets are summed by one aggregation, and at most
`MOST_PAIRS + POINTS` rows reach the driver, whatever the corpus. The table of pairs is then folded to the smallest
power of two of which at most `LOAD` is used, so that collisions stay rare while a small corpus has a small model;
the largest, of 24 MB, is the bound of what is broadcast. A bucket knows
by which code its pair begins, so that an unseen pair isn't taken for the one in its bucket. `CharModel.load` tells how full it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_PAIRS, MOST_PAIRS = 1 << 16, 1 << 22
LOAD = 0.05
POINTS = 1 << 16
EDGE = 2  # stands before and after each text


def points(text: str) -> np.ndarray:
    """Code points of a text between two edges."""
    body = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(body) + 2, EDGE, np.uint32)
    out[1:-1] = body
    return out


def join(texts: list[str]) -> np.ndarray:
    """Code points of many texts, an edge before, between and after them."""
    return points("\x02".join(t.replace("\x02", "\x03") if "\x02" in t else t for t in texts))


def _pair(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(16)
    return ((mixed >> np.uint64(31)) & np.uint64(size - 1)).astype(np.int64)


class Counts:
    """How often each code point and each hashed pair of code points occurs, and by which code each pair begins: the
    used buckets in order, those of the points after those of the pairs."""

    def __init__(self, at: np.ndarray = (), n: np.ndarray = (), begin: np.ndarray = ()):
        self.at, self.n, self.begin = np.array(at, np.int64), np.array(n, np.int64), np.array(begin, np.int32)

    def _merge(self, at: np.ndarray, n: np.ndarray, begin: np.ndarray) -> None:
        both, place, to = np.unique(np.concatenate([self.at, at]), return_index=True, return_inverse=True)
        self.n = np.bincount(to, np.concatenate([self.n, n]), len(both)).astype(np.int64)
        self.at, self.begin = both, np.concatenate([self.begin, begin])[place]

    def add(self, texts: list[str]) -> None:
        if not texts:
            return
        codes = np.minimum(join(texts), POINTS - 1)
        at, place, n = np.unique(_pair(codes[:-1], codes[1:], MOST_PAIRS), return_index=True, return_counts=True)
        single, often = np.unique(codes, return_counts=True)
        self._merge(np.concatenate([at, single.astype(np.int64) + MOST_PAIRS]), np.concatenate([n, often]), np.concatenate([codes[place], np.zeros(len(single))]).astype(np.int32))

    def rows(self) -> pa.RecordBatch:
        """What is counted, as (bucket, begin, n)."""
        return pa.RecordBatch.from_arrays([pa.array(self.at), pa.array(self.begin), pa.array(self.n)], names=["bucket", "begin", "n"])

    def less(self, other: Counts) -> Counts:
        out = Counts(self.at, self.n, self.begin)
        out._merge(other.at, -other.n, other.begin)
        used = out.n > 0
        return Counts(out.at[used], out.n[used], out.begin[used])


class CharModel:
    """Log probability of texts under bigram counts, interpolated with unigrams by the number of different followers."""

    def __init__(self, counts: Counts):
        # one off each count: what a scored text itself brought to the training must not speak for it
        pair = counts.at < MOST_PAIRS
        at, n = counts.at[pair], np.maximum(counts.n[pair] - 1, 0)
        kinds = np.bincount(counts.begin[pair], minlength=POINTS)
        size, some = MOST_PAIRS, at[n > 0]
        while size > LEAST_PAIRS and len(np.unique(some & (size // 2 - 1))) <= LOAD * size / 2:
            size //= 2  # a bucket of the half table holds two of the whole one
        order = np.argsort(n, kind="stable")  # where pairs share a bucket, the most frequent one has it
        self.pairs, self.begin = np.zeros(size, np.float32), np.zeros(size, np.uint16)
        self.pairs[at[order] & (size - 1)], self.begin[at[order] & (size - 1)] = n[order], counts.begin[pair][order]
        self.load = np.count_nonzero(self.pairs) / size
        self.points = np.zeros(POINTS, np.float32)
        self.points[counts.at[~pair] - MOST_PAIRS] = np.maximum(counts.n[~pair] - 1, 0)
        self.total = float(self.points.sum(dtype=np.float64)) + POINTS * 0.05
        self.own = (np.maximum(kinds, 1) + 3).astype(np.float32)
        self._low = ((self.points + 0.05) / self.total).astype(np.float32)
        self._before = np.log(self.points + self.own).astype(np.float32)

    def steps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Log probability of each code of `b` after that of `a`; all codes from POINTS on share one place."""
        a, b = np.minimum(a, POINTS - 1), np.minimum(b, POINTS - 1)
        at = _pair(a, b, len(self.pairs))
        seen = np.where(self.begin[at] == a, self.pairs[at], np.float32(0))  # an unseen pair may fall into a used bucket
        return np.log(seen + self.own[a] * self._low[b]) - self._before[a]

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each code after the first, given the one before."""
        return self.steps(codes[:-1], codes[1:])

    def score(self, text: str) -> float:
        return float(self.logs(points(text)).sum())

    def scores(self, texts: list[str]) -> np.ndarray:
        """`score` of each text, all at once."""
        codes = join(texts)
        logs = self.logs(codes)
        ends = np.flatnonzero(codes[1:] == EDGE)
        return np.add.reduceat(logs, np.concatenate([[0], ends[:-1] + 1]))


def collect(parts: DataFrame) -> Counts:
    """The sums of (bucket, begin, n); where pairs share a bucket one of their begins stands for all."""
    table = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("begin").alias("begin")).toArrow()
    order = np.argsort(table.column("bucket").to_numpy())
    return Counts(*(table.column(c).to_numpy()[order] for c in ("bucket", "n", "begin")))


def count(df: DataFrame, text: str = "text") -> Counts:
    """Counts of all texts of a column, each row once; null and empty texts count nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            counts.add([t for t in batch.column(0).to_pylist() if t])
        yield counts.rows()

    return collect(df.select(text).mapInArrow(run, "bucket bigint, begin int, n bigint"))
