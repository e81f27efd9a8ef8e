"""Nearest values before and after each row, and running sums, for many columns in one pass.

Rows are range-partitioned on (group, order) once and sorted, so a group of any
size is spread over many tasks. A first pass over the sorted partitions returns
one bounded summary a partition (per column: the first and last value of the
groups that touch its ends); the driver chains these summaries, as many as there
are partitions, and a second pass over the same partitions fills both directions
of all columns at once. The rows are exchanged once, whatever the number of
columns, and the plan grows by nothing but their names.

The sorted partitions are checkpointed in the shared folder, since range bounds
come from a random sample: both passes and every retry must see the same ones.
A task takes its partition in pieces of ``PIECE`` rows and holds one at a time, so
its memory does not grow with the partition; every piece has its own summary.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.exprs import q
from bizlens.session import cut_lineage

_PID = "__part"

#: Rows that a task holds at once.
PIECE = 200_000


def _starts(batch: pa.Table, group: Sequence[str]) -> np.ndarray:
    """Rows that begin a group (NULL is a group of its own)."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in group:
        a, b = batch.column(c).slice(1), batch.column(c).slice(0, max(0, n - 1))
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False)
        new[1:] |= differ | nulls
    return new


def _column(batch: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(valid, values) of a numeric column."""
    col = pc.cast(batch.column(name).combine_chunks(), pa.float64())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks else pa.array([], pa.float64())
    return pc.is_valid(col).to_numpy(zero_copy_only=False), pc.fill_null(col, 0.0).to_numpy(zero_copy_only=False)


def _key(batch: pa.Table, group: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(c)[row].as_py() for c in group)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """((partition, number), rows) of each ``size`` rows of a sorted partition, in order; where
    batches end does not matter."""
    held, n, number = [], 0, 0

    def piece() -> tuple[tuple[int, int], pa.Table]:
        t = pa.Table.from_batches(held)
        return (t.column(_PID)[0].as_py(), number), t

    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, size - n))
            b = b.slice(held[-1].num_rows)
            n += held[-1].num_rows
            if n == size:
                yield piece()
                held, n, number = [], 0, number + 1
    if held:
        yield piece()


def _summaries(rows: DataFrame, group: Sequence[str], columns: Sequence[str]) -> list[dict]:
    """One summary a piece, in order."""
    size = PIECE

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _pieces(batches, size):
            begin = np.flatnonzero(_starts(t, group))
            ends = (0, int(begin[1]) if len(begin) > 1 else t.num_rows), (int(begin[-1]), t.num_rows)
            out = {"part": part, "first": _key(t, group, 0), "last": _key(t, group, t.num_rows - 1),
                   "one": len(begin) == 1, "rows": ends[0][1], "head": [], "tail": []}
            for c in columns:
                valid, v = _column(t, c)
                at = np.flatnonzero(valid[:ends[0][1]])
                out["head"].append((float(v[at[0]]), int(at[0])) if len(at) else None)  # value, rows before it
                at = np.flatnonzero(valid[ends[1][0]:]) + ends[1][0]
                out["tail"].append((float(v[at[-1]]), int(t.num_rows - at[-1])) if len(at) else None)  # value, rows to the end
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)])], ["s"])

    got = rows.select(*[F.col(q(c)) for c in dict.fromkeys([*group, *columns, _PID])]).mapInArrow(summarise, "s binary").collect()
    return sorted((pickle.loads(r.s) for r in got), key=lambda s: s["part"])


def _chain(parts: list[dict], k: int) -> dict[tuple[int, int], tuple[list, list]]:
    """For each piece and column the value carried into its first group from
    before, and into its last group from after, each with its distance in rows."""
    before, after = {}, {}
    carried: list = [None] * k
    for i, p in enumerate(parts):
        if i and parts[i - 1]["last"] != p["first"]:
            carried = [None] * k
        before[p["part"]] = carried
        through = [(c[0], c[1] + p["rows"]) if c else None for c in carried] if p["one"] else [None] * k
        carried = [t or c for t, c in zip(p["tail"], through)]
    carried = [None] * k
    for i in reversed(range(len(parts))):
        p = parts[i]
        if i + 1 < len(parts) and parts[i + 1]["first"] != p["last"]:
            carried = [None] * k
        after[p["part"]] = carried
        through = [(c[0], c[1] + p["rows"]) if c else None for c in carried] if p["one"] else [None] * k
        carried = [h or c for h, c in zip(p["head"], through)]
    return {p["part"]: (before[p["part"]], after[p["part"]]) for p in parts}


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], *,
               inclusive: bool = True) -> DataFrame:
    """``df`` with, for the k-th of the numeric ``columns``, ``__pv{k}`` and ``__nv{k}``: the
    nearest value that is not NULL before and after the row in its group, and ``__pg{k}``,
    ``__ng{k}``: how many rows away it is. With ``inclusive`` a row's own value counts (0 rows
    away). Both are NULL where there is none. Row order among equal (group, order) is arbitrary."""
    rows = sorted_ranges(df, group, order)
    carried = df.sparkSession.sparkContext.broadcast(_chain(_summaries(rows, group, columns), len(columns)))
    group, columns, own = list(group), list(columns), 0 if inclusive else 1

    size = PIECE

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _pieces(batches, size):
            n = t.num_rows
            at = np.arange(n)
            new = _starts(t, group)
            start = np.maximum.accumulate(np.where(new, at, 0))
            stop = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
            out = t.drop_columns([_PID])
            for k, c in enumerate(columns):
                valid, v = _column(t, c)
                for name, (value, rows_away) in (("p", _before(valid, v, at, start, own, carried.value[part][0][k])),
                                                 ("n", _after(valid, v, at, stop, own, n, carried.value[part][1][k]))):
                    none = rows_away < 0
                    out = out.append_column(f"__{name}v{k}", pa.array(value, pa.float64(), mask=none))
                    out = out.append_column(f"__{name}g{k}", pa.array(rows_away, pa.int64(), mask=none))
            yield from out.to_batches(max_chunksize=50_000)

    extra = [T.StructField(f"__{d}{x}{k}", T.DoubleType() if x == "v" else T.LongType())
             for k in range(len(columns)) for d in "pn" for x in "vg"]
    return rows.mapInArrow(fill, T.StructType([*df.schema.fields, *extra]))


def _before(valid, v, at, start, own, carried):
    """(values, rows away; -1 for none) of the nearest valid row before each row."""
    last = np.maximum.accumulate(np.where(valid, at, -1))
    if own:
        last = np.append(-1, last[:-1])
    found = last >= start
    value, away = v[last], np.where(found, at - last, -1)
    if carried:  # the first group goes on from the partition before
        open_ = ~found & (start == 0)
        value = np.where(open_, carried[0], value)
        away = np.where(open_, at + carried[1], away)
    return value, away


def _after(valid, v, at, stop, own, n, carried):
    first = np.minimum.accumulate(np.where(valid, at, n)[::-1])[::-1]
    if own:
        first = np.append(first[1:], n)
    found = first < stop
    value, away = v[np.minimum(first, n - 1)], np.where(found, first - at, -1)
    if carried:  # the last group goes on in the partition after
        open_ = ~found & (stop == n)
        value = np.where(open_, carried[0], value)
        away = np.where(open_, n - at + carried[1], away)
    return value, away


def sorted_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned and sorted on (group, order) and checkpointed, with its partition's number."""
    keys = [F.col(q(c)) for c in [*group, *order]]
    return cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_PID, F.spark_partition_id()))


def running_sums(rows: DataFrame, group: Sequence[str], sums: Sequence[str], *, next_of: str | None = None) -> DataFrame:
    """``rows`` of :func:`sorted_ranges` with, for every column of ``sums`` (whole or floating
    numbers without NULL), ``cum_<column>``: its sum over the group up to and with this row; and
    ``next_<next_of>``, the next row's value in the group. Adds exactly for whole numbers."""
    spark, group, sums = rows.sparkSession, list(group), list(sums)
    whole = {c: isinstance(rows.schema[c].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) for c in sums}

    def values(t: pa.Table, c: str) -> np.ndarray:
        return t.column(c).to_numpy().astype(np.int64 if whole[c] else np.float64)

    size = PIECE

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _pieces(batches, size):
            begin = np.flatnonzero(_starts(t, group))
            out = {"part": part, "first": _key(t, group, 0), "last": _key(t, group, t.num_rows - 1),
                   "one": len(begin) == 1, "tail": [values(t, c)[begin[-1]:].sum().item() for c in sums],
                   "head": t.column(next_of)[0].as_py() if next_of else None}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)])], ["s"])

    needed = [F.col(q(c)) for c in dict.fromkeys([*group, *sums, *([next_of] if next_of else []), _PID])]
    parts = sorted((pickle.loads(r.s) for r in rows.select(*needed).mapInArrow(summarise, "s binary").collect()),
                   key=lambda s: s["part"])  # one row a piece
    before, following, carried = {}, {}, [0] * len(sums)
    for i, p in enumerate(parts):
        if i and parts[i - 1]["last"] != p["first"]:
            carried = [0] * len(sums)
        before[p["part"]] = carried
        carried = [t + (c if p["one"] else 0) for t, c in zip(p["tail"], carried)]
        if i + 1 < len(parts) and parts[i + 1]["first"] == p["last"]:
            following[p["part"]] = parts[i + 1]["head"]
    shared = spark.sparkContext.broadcast((before, following))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _pieces(batches, size):
            new = _starts(t, group)
            begin = np.flatnonzero(new)
            mine = np.cumsum(new) - 1
            out = t.drop_columns([_PID])
            for k, c in enumerate(sums):
                total = np.cumsum(values(t, c))
                base = np.append(0, total)[begin]  # what came before each group in this piece
                cum = total - base[mine]
                cum[mine == 0] += shared.value[0][part][k]
                out = out.append_column(f"cum_{c}", pa.array(cum))
            if next_of:
                col = t.column(next_of)
                after = pa.array([shared.value[1].get(part)], col.type)
                shifted = pa.concat_arrays([*(ch for ch in col.slice(1).chunks), after])
                last = np.append(new[1:], part not in shared.value[1])
                out = out.append_column(f"next_{next_of}", pc.if_else(pa.array(last), pa.scalar(None, col.type), shifted))
            yield from out.to_batches(max_chunksize=50_000)

    fields = [f for f in rows.schema.fields if f.name != _PID]
    fields += [T.StructField(f"cum_{c}", T.LongType() if whole[c] else T.DoubleType()) for c in sums]
    fields += [T.StructField(f"next_{next_of}", rows.schema[next_of].dataType)] if next_of else []
    return rows.mapInArrow(add_up, T.StructType(fields))
