"""Scanners as columns: a native gate in front of an Arrow-batched kernel, for scan, check and censor.

A scanner is anything with ``name``, ``scan(Column) -> Column<ranges>`` and ``check(Column) -> Column<boolean>``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from textweir.functions import columns as C
from textweir.kernels import email, phone, url
from textweir.kernels import text as T

Kernel = Callable[[str], list[tuple[int, int]]]


def _structs(ranges: list[tuple[int, int]]) -> list[dict]:
    return [{"start": s, "end": e} for s, e in ranges]


def _scan_udf(kernel: Kernel):
    @F.pandas_udf(C.RANGES)
    def scan(text: pd.Series) -> pd.Series:
        return pd.Series([_structs(kernel(t)) for t in text])

    return scan


def _check_udf(check: Callable[[str], bool]):
    @F.pandas_udf(BooleanType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(check).astype(bool)

    return run


def _censor_udf(kernels: list[Kernel], mask: str):
    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: T.censor(t or "", [r for k in kernels for r in k(t or "")], mask))

    return run


@dataclass(frozen=True)
class Scanner:
    """``gate``: a regex that every text with a match satisfies; rows that fail it never reach Python.

    Rows that fail the gate still travel with their batch, as empty texts; :meth:`matching` filters them before the kernel
    where only hits are wanted. Kernels are marked nondeterministic, which tells Catalyst to evaluate them once, however
    often their result is used; filters on other columns belong before the scan."""

    name: str
    kernel: Kernel
    first: Callable[[str], bool]
    gate_pattern: str
    mask_char: str = "*"

    def gate(self, text: Column | str) -> Column:
        return C.normalize_text(text).rlike(self.gate_pattern)

    def _gated(self, text: Column | str) -> Column:
        """The text where the gate holds, else an empty text, which costs the kernel nothing."""
        c = C.normalize_text(text)
        return F.when(self.gate(c), c).otherwise(F.lit(""))

    def scan(self, text: Column | str) -> Column:
        return _scan_udf(self.kernel).asNondeterministic()(self._gated(text))

    def check(self, text: Column | str) -> Column:
        return _check_udf(self.first).asNondeterministic()(self._gated(text))

    def censor(self, text: Column | str) -> Column:
        c = C.normalize_text(text)
        return F.when(self.gate(c), _censor_udf([self.kernel], self.mask_char).asNondeterministic()(self._gated(c))).otherwise(c)

    def matching(self, df: DataFrame, text: str = "text", ranges: str = "ranges") -> DataFrame:
        """Rows with matches and their ranges: the gate runs as a filter below the kernel, which runs once."""
        found = _scan_udf(self.kernel).asNondeterministic()(C.normalize_text(text))
        return df.where(self.gate(text)).withColumn(ranges, found).where(F.size(ranges) > 0)


def url_scanner(tlds=(), allowed_domains=(), mask_char: object = "*") -> Scanner:
    cfg = url.UrlConfig(tuple(tlds or ()), tuple(allowed_domains or ()))
    return Scanner("url", functools.partial(url.scan, cfg=cfg), functools.partial(url.check, cfg=cfg), url.gate(cfg), T.mask_char(mask_char, True))


def email_scanner(match_obfuscated=True, allow_localhost=False, allow_single_label_domain=False, exclude_emails=(), exclude_usernames=(), exclude_domains=(), mask_char: object = "*", as_written=False) -> Scanner:
    cfg = email.EmailConfig(match_obfuscated, allow_localhost, allow_single_label_domain, tuple(exclude_emails), tuple(exclude_usernames), tuple(exclude_domains), as_written=as_written)
    return Scanner("email", functools.partial(email.scan, cfg=cfg), functools.partial(email.check, cfg=cfg), email.gate(cfg), T.mask_char(mask_char, True))


def phone_scanner(mask_char: object = "*") -> Scanner:
    return Scanner("phone", phone.scan, phone.check, phone.GATE, T.mask_char(mask_char, True))


def custom_scanner(name: str, kernel: Kernel, gate_pattern: str = r"(?s).", mask_char: object = "*") -> Scanner:
    """A user's ``str -> [(start, end)]`` in code points; its ranges are cleaned and merged."""

    def scan(text: str) -> list[tuple[int, int]]:
        return T.merge((int(s), int(e)) for s, e in kernel(text) if s == s and e == e and abs(s) < 2**31 and abs(e) < 2**31)

    return Scanner(name, scan, lambda t: bool(scan(t)), gate_pattern, T.mask_char(mask_char, True))
