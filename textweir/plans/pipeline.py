"""Pipelines: many scanners with one mask pass over the original text, and guards followed by sequential censors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from textweir.functions import columns as C
from textweir.kernels import text as T
from textweir.operators.scanners import Scanner, _check_udf, _structs

Guard = Callable[[DataFrame], DataFrame]


class TextRangePipeline:
    """All scanners see the same text; their ranges are merged and masked once, in one pass through Python."""

    def __init__(self):
        self.scanners: list[Scanner] = []

    def use(self, scanner: Scanner) -> TextRangePipeline:
        if not (hasattr(scanner, "kernel") and hasattr(scanner, "name")):
            raise TypeError("a range pipeline takes scanners")
        self.scanners.append(scanner)
        return self

    def _gate(self, c: Column) -> Column:
        out = F.lit(False)
        for s in self.scanners:
            out = out | s.gate(c)
        return out

    def scan(self, text: Column | str = "text") -> Column:
        """struct<ranges, results array<struct<name, ranges>>>: merged ranges and each scanner's own."""
        c, kernels = C.normalize_text(text), [(s.name, s.kernel) for s in self.scanners]
        result = StructType([StructField("ranges", C.RANGES), StructField("results", C.ArrayType(StructType([StructField("name", C.StringType()), StructField("ranges", C.RANGES)])))])

        @F.pandas_udf(result)
        def run(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for t in texts:
                each = [(n, k(t) if t else []) for n, k in kernels]
                rows.append({"ranges": _structs(T.merge(r for _, rs in each for r in rs)), "results": [{"name": n, "ranges": _structs(rs)} for n, rs in each]})
            return pd.DataFrame(rows, columns=["ranges", "results"])

        return run.asNondeterministic()(F.when(self._gate(c), c).otherwise(F.lit("")))

    def check(self, text: Column | str = "text") -> Column:
        """Whether any scanner hits; the first hit ends a row's work."""
        c, firsts = C.normalize_text(text), [s.first for s in self.scanners]
        return _check_udf(lambda t: bool(t) and any(f(t) for f in firsts)).asNondeterministic()(F.when(self._gate(c), c).otherwise(F.lit("")))

    def censor(self, text: Column | str = "text", mask: object = "*") -> Column:
        c, kernels, m = C.normalize_text(text), [s.kernel for s in self.scanners], T.mask_char(mask, True)

        @F.pandas_udf(C.StringType())
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: T.censor(t, [r for k in kernels for r in k(t)], m))

        gate = self._gate(c)
        return F.when(gate, run.asNondeterministic()(F.when(gate, c).otherwise(F.lit("")))).otherwise(c)

    def process(self, df: DataFrame, text: str = "text", mask: object = "*") -> DataFrame:
        """``df`` with ``ranges``, ``results`` and ``censored``; the mask is Catalyst's, over the scanned ranges."""
        out = df.withColumn("_scan", self.scan(text))
        return out.withColumns({"ranges": F.col("_scan.ranges"), "results": F.col("_scan.results")}).withColumn("censored", C.censor_code_point_ranges(text, "ranges", mask)).drop("_scan")


class TextPipeline:
    """Guards judge the original text in order, then censors run one after another on what passed.

    A guard is ``DataFrame -> DataFrame`` that adds ``decision`` struct<allowed, reason>. Rows that a guard blocks never
    reach a later guard, so stateful guards see only what passed."""

    def __init__(self):
        self.guards: list[Guard] = []
        self.censors: list[Callable[[Column], Column]] = []

    def guard(self, guard: Guard) -> TextPipeline:
        self.guards.append(guard)
        return self

    def use(self, censor: Scanner | Callable[[Column], Column]) -> TextPipeline:
        self.censors.append(censor.censor if hasattr(censor, "censor") else censor)
        return self

    def censor(self, text: Column | str = "text") -> Column:
        out = C.normalize_text(text)
        for censor in self.censors:
            out = censor(out)
        return out

    def check(self, df: DataFrame) -> DataFrame:
        """Guards only: ``allowed`` and ``reason`` (null when allowed).

        The table is split only before a second guard that cannot pass over blocked rows itself (``skips``, as the spam guard
        can), so with such guards nothing is computed twice."""
        out = df.withColumns({"allowed": F.lit(True), "reason": F.lit(None).cast("string")})
        for i, guard in enumerate(self.guards):
            if not i or getattr(guard, "skips", False):
                judged = guard(out, F.col("allowed")) if i else guard(out.drop("allowed", "reason"))
                stopped = ~F.col("decision.allowed")
                before = {"allowed": F.col("allowed") & ~F.coalesce(stopped, F.lit(False)), "reason": F.coalesce("reason", "decision.reason")} if i else {"allowed": ~stopped, "reason": F.col("decision.reason")}
                out = judged.withColumns(before).drop("decision")
                continue
            judged = guard(out.where("allowed").drop("allowed", "reason"))
            live = judged.withColumns({"allowed": F.col("decision.allowed"), "reason": F.col("decision.reason")}).drop("decision")
            out = live.unionByName(out.where("not allowed"))
        return out

    def process(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``check`` plus ``output``: the censored text, null where blocked."""
        judged = self.check(df)
        return judged.withColumn("output", F.when(F.col("allowed"), self.censor(F.when(F.col("allowed"), F.col(text)))))


def cached(df: DataFrame, text: str, output: str, function: Callable[[Column], Column]) -> DataFrame:
    """A pure text function over each distinct text once; worth it where texts repeat a lot. Null texts count as empty."""
    keyed = df.withColumn("_key", C.normalize_text(text))
    done = keyed.select("_key").distinct().withColumn(output, function(F.col("_key")))
    return keyed.join(done, "_key", "left").drop("_key")
