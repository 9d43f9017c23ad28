"""Profanity over tables: analyze, check, censor and scan as columns, taxonomy filters in Catalyst, vocabulary joins."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from textweir.functions import columns as C
from textweir.kernels.profanity import MODES, SEVERITIES, ComposedFilter, Options, ProfanityFilter, terms
from textweir.operators.scanners import Scanner

MATCH = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())] + [StructField(n, StringType()) for n in ("mode", "rule_id", "category", "severity", "profile_id", "language_tag")])
MATCHES = ArrayType(MATCH, False)
_NAMES = MATCH.fieldNames()
Filter = ProfanityFilter | ComposedFilter


def analyze(text: Column | str, profanity: Filter, options: Options = Options(), modes: tuple[str, ...] = MODES) -> Column:
    """array<match>, strict before loose, of ``modes`` only; offsets are UTF-16 units. The compiled filter ships with the plan,
    once a task. Marked as not to be repeated, so a filter on the matches does not run the kernel again."""

    @F.pandas_udf(MATCHES)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(_NAMES, astuple(m))) for m in profanity.analyze(t, options, modes)] for t in texts])

    return run.asNondeterministic()(C.normalize_text(text))


def check(text: Column | str, profanity: Filter, options: Options = Options()) -> Column:
    @F.pandas_udf(BooleanType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: profanity.check(t, options)).astype(bool)

    return run.asNondeterministic()(C.normalize_text(text))


def censor(text: Column | str, profanity: Filter, options: Options = Options()) -> Column:
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: profanity.censor(t, options))

    return run.asNondeterministic()(C.normalize_text(text))


def scanner(profanity: Filter, options: Options = Options(), name: str = "profanity", mask_char: str = "*") -> Scanner:
    """For range pipelines: merged code-point ranges."""
    return Scanner(name, lambda t: profanity.ranges(t, options), lambda t: profanity.check(t, options), r"[\p{L}\p{N}@*]", mask_char)


def filter_matches(matches: Column | str, categories: Iterable[str] | None = None, severities: Iterable[str] | None = None, min_severity: str | None = None) -> Column:
    """The taxonomy filter on computed matches, native: category AND severity AND minimum severity."""
    m = F.col(matches) if isinstance(matches, str) else matches
    rank = lambda s: F.array_position(F.array(*map(F.lit, SEVERITIES)), s)
    if categories is None and severities is None and min_severity is None:
        return m

    def keep(x: Column) -> Column:
        ok = x["category"].isNotNull() & x["severity"].isNotNull()
        for given, name in ((categories, "category"), (severities, "severity")):
            if given is not None:
                given = list(given)
                ok = ok & (x[name].isin(given) if given else F.lit(False))
        return ok & (rank(x["severity"]) >= rank(F.lit(min_severity))) if min_severity else ok

    return F.filter(m, keep)


def of_mode(matches: Column | str, mode: str) -> Column:
    return F.filter(F.col(matches) if isinstance(matches, str) else matches, lambda x: x["mode"] == mode)


def match_rows(df: DataFrame, text: str, profanity: Filter, options: Options = Options(), outer: bool = False) -> DataFrame:
    """One row per match, next to the row's own columns."""
    out = df.withColumn("_m", analyze(text, profanity, options))
    return out.select(*df.columns, (F.inline_outer if outer else F.inline)("_m"))


def literal_hits(df: DataFrame, text: str, vocabulary: DataFrame, key: list[str]) -> DataFrame:
    """Strict literal terms as a join: distinct tokens of each row against ``vocabulary`` (term, ...), all native.

    For vocabularies too large to ship with a kernel; Spark broadcasts a small one by itself."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(C.normalize_text(text)), F.lit(r"[\p{L}\p{N}_-][\p{L}\p{N}\p{M}_-]*"), F.lit(0))))
    return df.select(*key, token.alias("term")).join(vocabulary, "term")


def vocabulary(spark, values: Iterable[object]) -> DataFrame:
    return spark.createDataFrame([(t.lower(),) for t in terms(values)], "term string")
