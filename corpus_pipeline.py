"""The corpus pipeline: language ID, quality rules, SimHash near-dedup,
benchmark decontamination and best-fit packing, each stage written as Parquet
into the shared folder and read again by the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
``docs``; the first four drop documents, the last returns one row a piece.
An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bizlens.llm import decontam, langid, packing, quality, simhash
from bizlens.llm.shared import read, stored

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", langid.stage),
    ("quality_rules", quality.stage),
    ("simhash_dedup", simhash.stage),
    ("decontamination", decontam.stage),
    ("best_fit_packing", packing.stage),
]

#: Language ID, hashed likelihood ratios, XXH64 and BPE are beyond DuckDB's SQL;
#: tests/llm compare the pipeline with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
