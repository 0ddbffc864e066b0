"""The N first items of every group by a secondary sort.

1. Each input partition is sorted by group and order and streamed once, keeping N rows of each group (map-side
   combine): a group that holds a third of all rows leaves at most N rows per input partition.
2. The survivors are hash-partitioned by group, sorted within partitions and streamed once more.

Arrow batches are streamed with only the last key and its count carried over, so no group is ever buffered; sorting
is the JVM's external sort and spills.

Defined results: rows whose group is null form a group of their own; rows with a null or NaN score don't count;
repeated rows (equal in group, order columns and outputs) count once; a group of fewer than N rows gives them all;
an empty table gives none; other columns of the input are dropped before anything moves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _differs(column: pa.Array, before) -> np.ndarray:
    """True where a value differs from the one above; `before` is a 1-element array, or None at the start."""
    n = len(column)
    out = np.ones(n, bool)
    above = column.slice(0, n - 1)
    here = column.slice(1)
    if n > 1:
        unequal = pc.fill_null(pc.not_equal(here, above), False).to_numpy(zero_copy_only=False)
        nulls = pc.xor(pc.is_null(here), pc.is_null(above)).to_numpy(zero_copy_only=False)
        out[1:] = unequal | nulls
    if before is not None and n:
        out[0] = column[0].as_py() != before[0].as_py()
    return out


def _first_n(n: int, groups: Sequence[str]):
    """A function over sorted Arrow batches that passes the first n different rows of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, pa.Array] = {}
        seen = 0  # different rows of the current group so far
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            new_row = np.zeros(batch.num_rows, bool)
            new_group = np.zeros(batch.num_rows, bool)
            for name, column in columns.items():
                change = _differs(column, last.get(name))
                new_row |= change
                if name in groups:
                    new_group |= change
            rank = np.cumsum(new_row)
            starts = np.flatnonzero(new_group)
            base = np.full(batch.num_rows, -seen, np.int64)  # rank within group = rank - base
            if len(starts):
                run_of = np.cumsum(new_group) - 1
                inside = run_of >= 0
                base[inside] = (rank[starts] - 1)[run_of[inside]]
            within = rank - base
            keep = new_row & (within <= n)
            seen = int(within[-1])
            last = {f: c.slice(len(c) - 1) for f, c in columns.items()}
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def top_n_per_group(df: DataFrame, groups: Sequence[str], score: str, ties: Sequence[Column], outputs: Sequence[str], n: int = 5, partitions: int | None = None) -> DataFrame:
    """The n rows of each group first by `score` descending, then by `ties`; see the module's docstring."""
    columns = list(dict.fromkeys([*groups, score, *outputs]))
    rows = df.select(*columns).where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    order = [*[F.col(g).asc_nulls_first() for g in groups], F.col(score).desc(), *ties]
    keep = _first_n(n, tuple(groups))
    partial = rows.sortWithinPartitions(*order).mapInArrow(keep, rows.schema)
    moved = partial.repartition(partitions, *groups) if partitions else partial.repartition(*groups)
    return moved.sortWithinPartitions(*order).mapInArrow(keep, rows.schema)


def board_leaders(boards: DataFrame, n: int = 5) -> DataFrame:
    """(board, entry_id) of the n first entries of each board: r desc, rk, n (nulls last), entry_id."""
    ties = [F.col("rk").asc_nulls_last(), F.col("n").asc_nulls_last(), F.col("entry_id").asc_nulls_last()]
    top = top_n_per_group(boards, ["board"], "r", ties, ["rk", "n", "entry_id"], n)
    return top.select("board", "entry_id")
