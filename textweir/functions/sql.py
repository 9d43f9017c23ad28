"""Names for SQL users: ``register(spark)`` adds scan_*, check_*, censor_* functions and the profanity_matches table function."""

from __future__ import annotations

from dataclasses import astuple

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from textweir.kernels import profanity
from textweir.kernels import spam as spam_kernel
from textweir.kernels import text as T
from textweir.operators import scanners as S


def _null_safe(f):
    return lambda t: f(t or "")


def register(spark: SparkSession) -> None:
    for s in (S.url_scanner(), S.email_scanner(), S.phone_scanner()):
        spark.udf.register(f"scan_{s.name}", S._scan_udf(_null_safe(s.kernel)))
        spark.udf.register(f"check_{s.name}", S._check_udf(_null_safe(s.first)))
        spark.udf.register(f"censor_{s.name}", S._censor_udf([s.kernel], s.mask_char))
    english = profanity.english_filter()

    @F.pandas_udf(StringType())
    def censor_profanity(text: pd.Series) -> pd.Series:
        return text.map(lambda t: english.censor(t or ""))

    @F.pandas_udf(BooleanType())
    def check_profanity(text: pd.Series) -> pd.Series:
        return text.map(lambda t: english.check(t or "")).astype(bool)

    @F.pandas_udf(StringType())
    def normalize_spam(text: pd.Series) -> pd.Series:
        return text.map(spam_kernel.normalize_text)

    @F.pandas_udf(StringType())
    def nfkc(text: pd.Series) -> pd.Series:
        return text.map(T.lower_nfkc)

    for name, f in (("censor_profanity", censor_profanity), ("check_profanity", check_profanity), ("spam_text", normalize_spam), ("lower_nfkc", nfkc)):
        spark.udf.register(name, f)
    spark.udtf.register("profanity_matches", F.udtf(_Matches, returnType="start int, end int, mode string, rule_id string, category string, severity string"))


class _Matches:
    def eval(self, text: str):
        for m in profanity.english_filter().analyze(text or ""):
            yield astuple(m)[:6]
