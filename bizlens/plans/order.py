"""Global row numbers without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task.
Instead: range-partition on the order key, sort inside partitions, read the
position inside each partition from ``monotonically_increasing_id`` (its low
33 bits are the record number within the partition), count rows per
partition (one number per partition), and add the preceding partitions'
total. The range sample is random, so the sorted frame is checkpointed into
the shared checkpoint folder first: a recomputed task must see the same
partition boundaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.exprs import null_safe_join, q
from bizlens.session import cut_lineage

_LOW33 = (1 << 33) - 1


def global_row_number(df: DataFrame, order_by: Sequence[str], *, name: str = "rn",
                      partitions: int | None = None, keep_partition: bool = False) -> DataFrame:
    """Add ``name`` = 1..N in ``order_by`` order (ties broken by the listed columns only).

    With ``keep_partition`` the range-partition id stays as ``__pid`` (rows of
    one partition are contiguous in the numbering)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(q(c)) for c in order_by]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    tagged = ranged.select("*", F.spark_partition_id().alias("__pid"),
                           (F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))).alias("__pos"))
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    # One row per partition: the running total is over at most a few
    # thousand rows, so its single-partition window is bounded.
    offsets = counts.select("__pid", (F.sum("__cnt").over(Window.orderBy("__pid")) - F.col("__cnt"))
                            .alias("__off"))
    out = (tagged.join(F.broadcast(offsets), "__pid")  # one row per partition
           .withColumn(name, F.col("__off") + F.col("__pos") + 1).drop("__pos", "__off"))
    return out if keep_partition else out.drop("__pid")


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str], *,
                   next_of: str | None = None, partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` inside each ``group`` in ``order`` order,
    plus (optionally) the next row's ``next_of`` value in the same group.

    Exact and skew-proof: rows are range-partitioned on (group, order), so a
    huge group spans many partitions; each partition-slice of a group is
    summed by a window over (group, partition) - bounded by the partition
    size - and the totals of the preceding slices (one row per group and
    partition) are added back. The partition ids are pinned by a
    checkpoint first, because range boundaries come from a random sample.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = [F.col(q(c)) for c in group]
    o = [F.col(q(c)) for c in order]
    ranged = df.repartitionByRange(n, *g, *o).withColumn("__pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    w = Window.partitionBy(*g, "__pid").orderBy(*o)
    cum = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(F.col(q(c))).over(cum).alias(f"__l_{c}") for c in sums],
                          *([F.lead(F.col(q(next_of))).over(w).alias("__next")] if next_of else []))
    okey = F.struct(*o)
    part = ranged.groupBy(*g, "__pid").agg(*[F.sum(F.col(q(c))).alias(f"__t_{c}") for c in sums],
                                           *([F.min_by(F.col(q(next_of)), okey).alias("__first")] if next_of else []))
    # One row per (group, partition): bounded by the partition count per group.
    wp = Window.partitionBy(*g).orderBy("__pid")
    before = wp.rowsBetween(Window.unboundedPreceding, -1)
    offs = part.select(*g, "__pid", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}")
                                      for c in sums],
                       *([F.lead("__first").over(wp).alias("__nf")] if next_of else []))
    out = null_safe_join(local, offs, [*group, "__pid"])
    cols = [F.col(q(c)) for c in df.columns] + [(F.col(f"__l_{c}") + F.col(f"__o_{c}")).alias(f"cum_{c}") for c in sums]
    if next_of:
        cols.append(F.coalesce(F.col("__next"), F.col("__nf")).alias(f"next_{next_of}"))
    return out.select(*cols)


def prefix_max(df: DataFrame, group: Sequence[str], order: str, value: str, *, pid: str = "__pid",
               name: str = "prefix_max", inclusive: bool = True) -> DataFrame:
    """Running max of ``value`` (any orderable type, e.g. a struct) inside each
    group in ``order`` order, for rows already range-partitioned with ids in
    ``pid`` (``global_row_number(keep_partition=True)``). Each (group,
    partition) slice is scanned by a bounded window; the maxima of the
    preceding slices (one row per group and partition) are folded in."""
    g = [F.col(q(c)) for c in group]
    w = Window.partitionBy(*g, pid).orderBy(order)
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = df.withColumn("__lmax", F.max(F.col(value)).over(frame))
    part = df.groupBy(*g, pid).agg(F.max(F.col(value)).alias("__pmax"))
    wp = Window.partitionBy(*g).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offs = part.select(*g, pid, F.max("__pmax").over(wp).alias("__before"))
    out = null_safe_join(local, offs, [*group, pid], "left")
    both = F.greatest(F.col("__lmax"), F.col("__before"))  # greatest skips NULLs
    return out.withColumn(name, both).drop("__lmax", "__before")
