"""Small Spark helpers of the training-data operators: tables in the shared
folder, free column names and document keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.session import checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage ends
    there, so a lost executor costs no recomputation of what came before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def join_by_weight(rows: DataFrame, table: DataFrame, key: str, weight: str, *, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a ``key`` and in
    ``weight`` the number of ``rows`` with that key.

    Keys with more than 1 / ``share`` of all rows are fewer than ``share``: they
    are broadcast, so their rows stay where they are; the others are shuffled."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(weight) * share > total).drop(weight))
    rest = table.where(F.col(weight) * share <= total).drop(weight)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))
