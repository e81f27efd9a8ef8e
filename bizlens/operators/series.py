"""Time-series structure and features (V1-V9).

A series is a long frame ``(by..., ts, y)``; every window is partitioned by
the series keys, so each series is sorted inside its own task. Series here
are period aggregates (daily / monthly sums), which keeps a window
partition small; raw rows are rolled up with ``relate.monthly_rollup`` or
``to_series`` first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.exprs import finite, is_datetime, is_numeric, numeric_columns, q
from bizlens.plans.carry import running_sums, sorted_ranges
from bizlens.session import cut_lineage

# Horizon labels (periods) and the gap rule (days -> frequency).
HORIZON_LABELS = {"30 Days": 30, "90 Days": 90, "6 Months": 6, "12 Months": 12}
DATE_WORDS = ("date", "time", "year", "month")
TARGET_WORDS = ("revenue", "sales", "target", "value", "demand", "volume", "amount")
NO_DATE = "No parseable datetime column identified."
NO_TARGET = "No numeric target column identified."
GAP_RULES = [(None, 1, "D"), (6, 8, "W"), (27, 32, "MS"), (88, 93, "QS"), (360, 366, "YS")]


# Names of the lattices by place in the month, of months and weekdays.
POSITION_NAMES = {"Y": {"ce": "YE", "be": "BYE", "cs": "YS", "bs": "BYS"}, "Q": {"ce": "QE", "be": "BQE", "cs": "QS", "bs": "BQS"},
                  "M": {"ce": "ME", "be": "BME", "cs": "MS", "bs": "BMS"}}
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
WEEKDAYS = "MON TUE WED THU FRI SAT SUN".split()


def _b(by: Sequence[str]) -> list[Column]:
    return [F.col(q(c)) for c in by]


def horizon_periods(label: str | int) -> int:
    """V9: label -> number of periods (a plain number passes through)."""
    if isinstance(label, int):
        return label
    return HORIZON_LABELS.get(label, int(label) if str(label).isdigit() else 30)


def to_series(df: DataFrame, date: str, target: str, *, by: Sequence[str] = (), period: str | None = None) -> DataFrame:
    """(by..., ts, y): drop bad dates / targets (D12), sum duplicates per period."""
    ts = F.col(q(date)).cast("timestamp_ntz")
    if period:
        ts = F.date_trunc(period, ts).cast("timestamp_ntz")
    return (df.select(*_b(by), ts.alias("ts"), finite(F.col(q(target))).alias("y"))
            .dropna(subset=["ts", "y"]).groupBy(*_b(by), "ts").agg(F.sum("y").alias("y")))


def _as_date(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    return F.col(q(c)).cast("timestamp_ntz") if is_datetime(kind) else F.try_to_timestamp(F.col(q(c)).cast("string")).cast("timestamp_ntz")


def date_gaps(counts: DataFrame) -> DataFrame:
    """(gap, n): how often each gap in whole days stands between consecutive dates in order, equal
    dates included, from dates ``t`` and their counts ``n``; they are range-partitioned, not in one task."""
    spans = running_sums(sorted_ranges(counts, [], ["t"]), [], ["n"], next_of="t")
    days = F.floor(F.expr("timestampdiff(MICROSECOND, t, next_t)") / 86_400_000_000).cast("long")
    each = spans.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("n")),
                                          F.struct(days.alias("gap"), F.lit(1).cast("long").alias("n")))).alias("x"))
    return each.select("x.*").where("n > 0 AND gap IS NOT NULL").groupBy("gap").agg(F.sum("n").alias("n"))


def detect_structure(df: DataFrame, *, date: str | None = None, target: str | None = None, max_bad: float = 0.30) -> DataFrame:
    """V1: one row: is_valid_time_series, date_column, target_column, frequency,
    total_observations, bad_share, reason.

    Date: the given column, else the first whose name holds a date word, else the first that is
    not numeric and whose values all parse. Target: the given column, else the first numeric one
    that holds the earliest word of ``TARGET_WORDS``, else the first numeric one. The series is
    not valid without these, or with more than ``max_bad`` unparseable dates. Frequency: the
    exact one if no date repeats, else by the median gap of all dates in order."""
    spark = df.sparkSession
    if date is None:
        date = next((c for c in df.columns if any(w in c for w in DATE_WORDS)), None)
    if date is None:
        texts = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
        if texts:  # one job over all values
            row = df.agg(*[(F.count(F.col(q(c))) > 0).alias(f"a{i}") for i, c in enumerate(texts)],
                         *[(F.count(F.col(q(c))) == F.count(_as_date(df, c))).alias(f"b{i}") for i, c in enumerate(texts)]).first()
            date = next((c for i, c in enumerate(texts) if row[f"a{i}"] and row[f"b{i}"]), None)
    numeric = [c for c in numeric_columns(df) if c != date]
    if target is None:
        target = next((c for w in TARGET_WORDS for c in numeric if w in c), numeric[0] if numeric else None)
    kinds = ("is_valid_time_series boolean, date_column string, target_column string, frequency string, "
             "total_observations long, bad_share double, reason string")
    if date is None or date not in df.columns:
        return spark.createDataFrame([(False, None, None, None, None, None, NO_DATE)], kinds)
    if target is None or target not in df.columns:
        return spark.createDataFrame([(False, date, None, None, None, None, NO_TARGET)], kinds)
    # one pass over the rows: a row a different date, NULL among them
    counts = cut_lineage(df.select(_as_date(df, date).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("n"))), F.lit(0)).alias("parsed"))
    bad = F.when(F.col("rows") > 0, 1.0 - F.col("parsed") / F.col("rows")).otherwise(1.0)
    found = counts.dropna()
    gaps = date_gaps(found)
    exact = infer_frequency(found.select("t"), ts="t").select("inferred")
    below = F.sum("n").over(Window.orderBy("gap"))  # one row a different gap
    ranked = gaps.select("gap", "n", below.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    mid = [F.min(F.when(F.col("upto") > f((F.col("all") - 1) / 2), F.col("gap"))) for f in (F.floor, F.ceil)]
    mid = ranked.agg(((mid[0] + mid[1]) / 2.0).alias("median"), F.coalesce(F.max(F.when(F.col("gap") == 0, True)), F.lit(False)).alias("again"))
    out = rows.crossJoin(exact).crossJoin(mid)  # one row each
    freq = F.when(F.col("inferred").isNotNull() & ~F.col("again"), F.col("inferred")).otherwise(_by_median_gap(F.col("median")))
    ok = bad <= max_bad
    why = F.when(~ok, F.lit(f"Column '{date}' has >{round(max_bad * 100)}% unparseable date values."))
    return out.select(ok.alias("is_valid_time_series"), F.lit(date).alias("date_column"),
                      F.when(ok, F.lit(target)).alias("target_column"), F.when(ok, freq).alias("frequency"),
                      F.when(ok, F.col("rows")).alias("total_observations"), F.round(bad, 4).alias("bad_share"), why.alias("reason"))


def _by_median_gap(m: Column) -> Column:
    freq = F.when(m.isNull(), "D")
    for lo, hi, name in GAP_RULES:
        cond = (m <= hi) if lo is None else ((m >= lo) & (m <= hi))
        freq = freq.when(cond, name)
    return freq.otherwise("D")


def _month_position(d: Column) -> Column:
    """Where the dates of a group stand in their months (ce, be, cs, bs: calendar or business end or start), else NULL."""
    day, left, wd = F.dayofmonth(d), F.datediff(F.last_day(d), d), F.weekday(d)
    tests = [("ce", left == 0), ("be", (left == 0) | ((left < 3) & (wd == 4))),
             ("cs", day == 1), ("bs", (day == 1) | ((day <= 3) & (wd == 0)))]
    return F.coalesce(*[F.when(F.bool_and(t), F.lit(name)) for name, t in tests])


def infer_frequency(series: DataFrame, *, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """V2, exact part: (by..., median_gap_days, inferred): the coarsest lattice (years,
    quarters, months, weeks, days, business days, weekdays of the month, hours,
    minutes, seconds) on which all steps between consecutive dates are equal, with
    its anchor and step, named as pandas names frequencies ('QS-OCT', '2W-MON').
    NULL for repeated dates, fewer than three of them, or none of the lattices.

    Every lattice is a pair of ordinals' smallest and largest step, so all are
    aggregates of one pass over the sorted series."""
    t = F.col(q(ts)).cast("timestamp_ntz")
    rows = series.select(*_b(by), t.alias("_t")).select("*", F.lag("_t").over(Window.partitionBy(*_b(by)).orderBy("_t")).alias("_p"))
    month = F.year("_t") * 12 + F.month("_t")
    pmonth = F.year("_p") * 12 + F.month("_p")
    d = F.col("_t").cast("date")
    gap = F.expr("timestampdiff(MICROSECOND, _p, _t)")
    days = F.datediff(d, F.col("_p").cast("date"))
    wd, week = F.weekday("_t"), F.floor((F.dayofmonth("_t") - 1) / 7)
    g = rows.groupBy(*_b(by)).agg(
        F.count("_t").alias("n"), F.min("_t").alias("first"), F.median(days).alias("median_gap_days"),
        F.min(gap).alias("g0"), F.max(gap).alias("g1"), F.min(month - pmonth).alias("m0"), F.max(month - pmonth).alias("m1"),
        F.min(F.year("_t") - F.year("_p")).alias("y0"), F.max(F.year("_t") - F.year("_p")).alias("y1"),
        F.min(F.month("_t")).alias("month0"), F.max(F.month("_t")).alias("month1"), _month_position(d).alias("pos"),
        (F.bool_and(((F.weekday("_p") == 4) & (days == 3)) | ((F.weekday("_p") < 4) & (days == 1)) | F.col("_p").isNull())
         & F.bool_or(days == 3) & F.bool_or(days == 1)).alias("business"),
        F.min(wd).alias("wd0"), F.max(wd).alias("wd1"), F.min(F.when(week < 4, week)).alias("wk0"),
        F.max(F.when(week < 4, week)).alias("wk1"))
    day = 86_400_000_000

    def named(base: Column, step: Column) -> Column:
        return F.when(step == 1, base).otherwise(F.concat(step.cast("long").cast("string"), base))

    def pick(names: dict[str, str]) -> Column:
        return F.coalesce(*[F.when(F.col("pos") == k, F.lit(v)) for k, v in names.items()])

    def of(values: Sequence[str], index: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))

    first_month, first_day = F.month("first"), F.weekday("first")
    anchor = of(["DEC", "OCT", "NOV"], first_month % 3)
    rule = F.when((F.col("y0") == F.col("y1")) & (F.col("y0") > 0) & (F.col("month0") == F.col("month1")) & F.col("pos").isNotNull(),
                  named(F.concat(pick(POSITION_NAMES["Y"]), F.lit("-"), of(MONTHS, first_month - 1)), F.col("y0")))
    same = (F.col("m0") == F.col("m1")) & (F.col("m0") > 0) & F.col("pos").isNotNull()
    rule = rule.when(same & (F.col("m0") % 3 == 0), named(F.concat(pick(POSITION_NAMES["Q"]), F.lit("-"), anchor), F.col("m0") / 3))
    rule = rule.when(same, named(pick(POSITION_NAMES["M"]), F.col("m0")))
    even = F.col("g0") == F.col("g1")
    n_days = F.col("g0") / day
    rule = rule.when(even & (n_days % 7 == 0), named(F.concat(F.lit("W-"), of(WEEKDAYS, first_day)), n_days / 7))
    rule = rule.when(even, named(F.lit("D"), n_days)).when(F.col("business"), F.lit("B"))
    rule = rule.when((F.col("wd0") == F.col("wd1")) & (F.col("wk0") == F.col("wk1")),
                     F.concat(F.lit("WOM-"), (F.col("wk0") + 1).cast("string"), of(WEEKDAYS, F.col("wd0"))))
    fine = F.coalesce(*[F.when(even & (F.col("g0") % size == 0), named(F.lit(name), F.col("g0") / size))
                        for name, size in (("h", day // 24), ("min", 60_000_000), ("s", 1_000_000), ("ms", 1000), ("us", 1))])
    known = (F.col("n") >= 3) & (F.col("g0") > 0)
    return g.select(*_b(by), "median_gap_days", F.when(known & (F.col("g0") % day == 0), rule).when(known, fine).alias("inferred"))


def detect_frequency(series: DataFrame, *, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """V2: the exact frequency, or else the median gap in days between consecutive
    dates -> D / W / MS / QS / YS (else D)."""
    g = infer_frequency(series, by=by, ts=ts)
    return g.withColumn("freq", F.coalesce("inferred", _by_median_gap(F.col("median_gap_days"))))


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """V3 + V4: year, month, day, dayofweek (Mon=0), quarter, is_month_end, sin/cos month."""
    d = F.col(q(ts))
    month = F.month(d)
    return df.select("*", F.year(d).alias("year"), month.alias("month"), F.dayofmonth(d).alias("day"),
                     F.weekday(d).alias("dayofweek"), F.quarter(d).alias("quarter"),
                     (F.last_day(d) == d.cast("date")).cast("int").alias("is_month_end"),
                     F.sin(2 * math.pi * month / 12.0).alias("sin_month"),
                     F.cos(2 * math.pi * month / 12.0).alias("cos_month"))


def lag_features(series: DataFrame, *, by: Sequence[str] = (), ts: str = "ts", y: str = "y",
                 fill: str = "none") -> DataFrame:
    """V5 + V6 (+ V7 when ``fill='bfill'``).

    Lags 1, 2, 3 always and 6, 12 when the series has >= 24 points; rolling
    mean / std of the *previous* w values for w in (3, 6) when it has >= 12
    points, else (2, 3); NULL until the window is full. ``fill='bfill'``
    copies the reference (backward then forward fill, which leaks future
    values into early rows); ``fill='drop'`` removes rows with gaps.
    """
    w = Window.partitionBy(*_b(by)).orderBy(F.col(q(ts)))
    n = F.count(F.lit(1)).over(Window.partitionBy(*_b(by)))
    out = series.withColumn("_n", n)
    yv = F.col(q(y))
    for k in (1, 2, 3, 6, 12):
        lag = F.lag(yv, k).over(w)
        out = out.withColumn(f"{y}_lag_{k}", lag if k <= 3 else F.when(F.col("_n") >= 24, lag))
    for k in (2, 3, 6):
        frame = w.rowsBetween(-k, -1)
        full = F.count(yv).over(frame) == k
        use = (F.col("_n") >= 12) if k == 6 else ((F.col("_n") < 12) if k == 2 else F.lit(True))
        out = out.withColumn(f"{y}_rolling_mean_{k}", F.when(full & use, F.avg(yv).over(frame)))
        out = out.withColumn(f"{y}_rolling_std_{k}", F.when(full & use, F.stddev_samp(yv).over(frame)))
    feats = [c for c in out.columns if c.startswith(f"{y}_lag_") or c.startswith(f"{y}_rolling_")]
    if fill == "bfill":
        # next non-NULL = last non-NULL in reversed order (a linear, growing frame)
        fw = Window.partitionBy(*_b(by)).orderBy(F.col(q(ts)).desc()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        bw = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for c in feats:
            out = out.withColumn(c, F.coalesce(F.last(F.col(c), ignorenulls=True).over(fw),
                                               F.last(F.col(c), ignorenulls=True).over(bw)))
    elif fill == "drop":
        out = out.dropna(subset=[f"{y}_lag_1", f"{y}_lag_2", f"{y}_lag_3"])
    return out.drop("_n")


def future_dates(series: DataFrame, horizon: int, *, by: Sequence[str] = (), ts: str = "ts",
                 freq: str = "MS") -> DataFrame:
    """V8: the ``horizon`` period starts after each series' last date."""
    last = series.groupBy(*_b(by)).agg(F.max(F.col(q(ts))).alias("_last"))
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    fut = last.select(*_b(by), "_last", step)
    d = F.col("_last")
    s = F.col("step")
    nxt = {
        "D": F.date_add(d.cast("date"), s),
        "W": F.date_add(d.cast("date"), s * 7),
        "MS": F.add_months(d.cast("date"), s),
        "QS": F.add_months(d.cast("date"), s * 3),
        "YS": F.add_months(d.cast("date"), s * 12),
    }[freq]
    return fut.select(*_b(by), "step", nxt.cast("timestamp_ntz").alias("ts"))


def horizon_dates(series: DataFrame, labels: Sequence[str | int] = tuple(HORIZON_LABELS), *, by: Sequence[str] = (),
                  ts: str = "ts", freq: str = "MS") -> DataFrame:
    """V9: (by..., label, periods, first_ts, last_ts): for every horizon label the number of
    periods it asks for, and the first and last date that V8 gives for them."""
    n = F.create_map(*[x for label in labels for x in (F.lit(str(label)), F.lit(horizon_periods(label)))])
    most = max(horizon_periods(label) for label in labels)
    dates = future_dates(series, most, by=by, ts=ts, freq=freq)
    each = dates.select("*", F.explode(F.map_keys(n)).alias("label")).withColumn("periods", n[F.col("label")])
    return each.where(F.col("step") <= F.col("periods")).groupBy(*_b(by), "label", "periods") \
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
