"""The opN_ queries of this subpackage: each reads whole tables and returns its operator's full result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textweir.sources.tables import read_table as table

#: Query name, module, tables that its ``opN`` function takes in order.
OPERATORS = [
    ("op1_warc", "warc", ("pages",)),
    ("op2_toxicity", "toxicity", ("documents", "labels")),
    ("op3_ngram_jaccard", "ngram_jaccard", ("documents",)),
    ("op4_fingerprints", "fingerprints", ("documents",)),
    ("op5_line_dedup", "line_dedup", ("documents",)),
    ("op6_packing", "packing", ("documents",)),
    ("op7_licenses", "licenses", ("documents",)),
    ("op8_quality", "quality", ("documents",)),
    ("op9_token_counts", "token_counts", ("documents",)),
    ("op10_decontamination", "decontamination", ("documents", "benchmark")),
]


def _query(name: str, module: str, tables: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        operator = getattr(importlib.import_module(f"{__package__}.{module}"), name.split("_")[0] if name.startswith("op") else name)
        return operator(*(table(spark, sf_dir, t) for t in tables))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _query(name, module, tables) for name, module, tables in OPERATORS}
    found["decontamination_proximity"] = _query("proximity_matches", "decontamination", ("documents", "benchmark"))
    found["ngram_jaccard_links"] = _query("link_counts", "ngram_jaccard", ("documents",))
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module, _ in OPERATORS}
    return {k: v for k, v in found.items() if v}
