"""Sources and sinks.

Every reader is a ``spark.read`` call, so pruning and pushdown reach the
files. CSV is read as text columns and typed by the two-phase inference
(``operators.schema.infer_types``) unless an explicit schema - the fast path
at scale - is given. The separator and the JSON layout are decided by one
aggregate over all lines.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted extensions and candidate separators.
TABULAR = {".csv": "csv", ".tsv": "delimited", ".txt": "delimited", ".json": "json", ".jsonl": "json",
           ".parquet": "parquet", ".orc": "orc"}
OFFICE = {".docx", ".pptx", ".xlsx"}
SEPARATORS = [",", ";", "\t", "|"]


class UnsupportedFormat(ValueError):
    pass


def _ext(path: str) -> str:
    base = path.rstrip("/").split("/")[-1]
    if "*" in base or "." not in base:
        return ""
    return os.path.splitext(base)[1].lower()


def load(spark: SparkSession, path: str, fmt: str | None = None, *, schema: T.StructType | str | None = None,
         infer: bool = False, **options) -> DataFrame:
    """Dispatch by format or extension; globs and folders need ``fmt``."""
    kind = fmt or TABULAR.get(_ext(path))
    if kind is None:
        if _ext(path) in OFFICE:
            from bizlens.sources.office import read_office
            return read_office(spark, path)
        raise UnsupportedFormat(f"unsupported file type: {path!r}")
    if kind == "csv":
        return read_csv(spark, path, schema=schema, infer=infer, **options)
    if kind == "delimited":
        return read_delimited(spark, path, schema=schema, infer=infer, **options)
    if kind == "json":
        return read_json(spark, path, schema=schema, **options)
    if kind in ("parquet", "orc"):
        r = spark.read.options(**options)
        return (r.schema(schema) if schema else r).format(kind).load(path)
    raise UnsupportedFormat(kind)


def read_csv(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None, sep: str = ",",
             infer: bool = False, **options) -> DataFrame:
    """Header row; text columns (then C4/C5 typing when ``infer``), or an explicit schema."""
    r = spark.read.option("header", True).option("sep", sep).option("multiLine", False).options(**options)
    if schema is not None:
        return r.schema(schema).csv(path)
    df = r.option("inferSchema", False).csv(path)
    if infer:
        from bizlens.operators.schema import infer_types
        df = infer_types(df)
    return df


def separator_counts(spark: SparkSession, path: str) -> DataFrame:
    """(sep, fields, lines): over all lines with anything in them, how many split into how many
    fields by each candidate, separators inside double quotes left out."""
    bare = F.regexp_replace("value", '"[^"]*("|$)', "")
    cells = F.array(*[F.struct(F.lit(s).alias("sep"), (F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) + 1)
                               .alias("fields")) for s in SEPARATORS])
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.explode(cells).alias("x")).groupBy("x.sep", "x.fields").agg(F.count(F.lit(1)).alias("lines"))


def sniff_separator(spark: SparkSession, path: str) -> str:
    """S3: the candidate that splits most lines of the whole file into the same number of
    fields, more than one; then that with more fields."""
    best = separator_counts(spark, path).where("fields > 1").groupBy("sep").agg(
        F.max(F.struct("lines", "fields")).alias("top")).collect()  # one row a candidate
    order = {s: -k for k, s in enumerate(SEPARATORS)}
    return max(best, key=lambda r: (r.top.lines, r.top.fields, order[r.sep])).sep if best else ","


def read_delimited(spark: SparkSession, path: str, *, sep: str | None = None, **kw) -> DataFrame:
    """S3: delimited text with a sniffed separator."""
    return read_csv(spark, path, sep=sep or sniff_separator(spark, path), **kw)


def is_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether every line with anything in it is a whole record: it begins with a brace and
    closes, outside of strings, as many braces and brackets as it opens, the last one at its end."""
    line = F.trim(F.regexp_replace("value", r'^\uFEFF', ""))
    bare = F.regexp_replace(line, r'"(\\.|[^"\\])*"', "")
    opened = F.length(F.regexp_replace(bare, r"[^{\[]", ""))
    closed = F.length(F.regexp_replace(bare, r"[^}\]]", ""))
    whole = F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}")) & (opened == closed)
    row = spark.read.text(path).where(line != "").agg(F.bool_and(whole).alias("whole")).first()
    return row.whole is not False


def read_json(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None,
              multiline: bool | None = None, **options) -> DataFrame:
    """JSON lines, or else whole documents (an array of records, or a record over several
    lines), told apart by all lines."""
    if multiline is None:
        multiline = not is_json_lines(spark, path)
    r = spark.read.option("multiLine", multiline).options(**options)
    return (r.schema(schema) if schema else r).json(path)


def jdbc_options(url: str, *, query: str | None = None, table: str | None = None, partition_column: str | None = None,
                 lower_bound: int | None = None, upper_bound: int | None = None, num_partitions: int | None = None,
                 fetch_size: int = 10000, **extra) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``: a query or a table, and a
    partitioned read (column, bounds, partitions) so the load is parallel."""
    if bool(query) == bool(table):
        raise ValueError("give exactly one of query / table")
    opts = {"url": url, "fetchsize": str(fetch_size)}
    if query:
        if partition_column:
            opts["dbtable"] = f"({query}) AS q"
        else:
            opts["query"] = query
    else:
        opts["dbtable"] = table
    if partition_column:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("a partitioned read needs lower_bound, upper_bound and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound), upperBound=str(upper_bound),
                    numPartitions=str(num_partitions))
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_jdbc(spark: SparkSession, url: str, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, **kw)).load()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Row concatenation by column name; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def validate(df: DataFrame, *, min_rows: int = 1, min_columns: int = 2) -> DataFrame:
    """One row of checks; counting stops at ``min_rows`` (a limit, not a full count)."""
    seen = df.limit(min_rows).count()
    spark = df.sparkSession
    return spark.createDataFrame(
        [(len(df.columns), seen, len(df.columns) >= min_columns, seen >= min_rows,
          len(df.columns) >= min_columns and seen >= min_rows)],
        "columns int, rows_seen long, enough_columns boolean, enough_rows boolean, valid boolean")


def write_results(df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: Sequence[str] = ()) -> None:
    """Results as Parquet / JSON; NaN / inf become NULL first (JSON-safe)."""
    from bizlens.functions.exprs import finite
    clean = df.select(*[finite(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                        else F.col(f"`{f.name}`") for f in df.schema.fields])
    w = clean.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def to_json_records(df: DataFrame, *, name: str = "json") -> DataFrame:
    """Each row as one JSON object string (nested structs and arrays kept)."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name))


def preview(df: DataFrame, n: int = 10, *, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first n rows after an explicit sort (top-n, no full sort)."""
    return df.orderBy(*[F.col(f"`{c}`") for c in (order_by or df.columns)]).limit(n)
