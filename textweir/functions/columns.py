"""Column builders for text input, ranges, masks and hints. Everything here is Catalyst expressions unless it says so.

Code-point ranges are ``array<struct<start:int,end:int>>``; Spark strings count code points. UTF-16 widths come from the
number of astral characters.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from textweir.kernels import text as T

RANGE = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
RANGES = ArrayType(RANGE, False)
HINTS = StructType(
    [StructField(n, IntegerType()) for n in ("text_length", "code_point_length")]
    + [StructField(n, BooleanType()) for n in ("is_empty", "has_ascii_only", "has_non_ascii", "has_digit")]
    + [StructField("digit_count", IntegerType())]
    + [StructField(n, BooleanType()) for n in ("has_ascii_letter", "has_whitespace", "has_punctuation")]
    + [StructField("punctuation_count", IntegerType())]
    + [StructField(n, BooleanType()) for n in ("has_at_sign", "has_dot", "has_slash", "has_colon", "has_plus")]
)
_SPACES = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in T.SPACE) + "]"
_ZEROS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in T.ZERO_WIDTH) + "]"
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"
#: Compatibility forms of the delimiters (fixed values): @ . / : +
_FORMS = {"at_sign": "@＠﹫", "dot": ".．﹒․", "slash": "/／", "colon": ":：﹕︓", "plus": "+＋﹢⁺₊﬩"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str, data_type: DataType | None = None) -> Column:
    """Any value as text: null is empty; whole doubles (``data_type`` given) lose their fraction."""
    c = _col(c)
    if isinstance(data_type, (DoubleType, FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
        return F.coalesce(F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


@F.pandas_udf(StringType())
def _nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(T.lower_nfkc)


def lower_nfkc(c: Column | str) -> Column:
    """NFKC, then lower case. Catalyst has no NFKC: ASCII text takes ``lower``, other text an Arrow UDF."""
    c = normalize_text(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc_udf(c)).otherwise(F.lower(c))


def strip_zero_width(c: Column | str) -> Column:
    return F.regexp_replace(normalize_text(c), _ZEROS, "")


def mask_char(c: Column | str) -> Column:
    """First code point, ``*`` for nothing."""
    return F.substring(F.coalesce(F.nullif(_col(c).cast("string"), F.lit("")), F.lit("*")), 1, 1)


def length_preserving_mask_char(c: Column | str) -> Column:
    """As ``mask_char``; a mask of two UTF-16 units becomes ``*``."""
    m = mask_char(c)
    return F.when(m.rlike(_ASTRAL), F.lit("*")).otherwise(m)


def code_points(c: Column | str) -> Column:
    c = normalize_text(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def utf16_length(c: Column | str) -> Column:
    c = normalize_text(c)
    return (F.length(c) + F.regexp_count(c, F.lit(_ASTRAL))).cast("int")


def normalize_ranges(ranges: Column | str) -> Column:
    """Whole numbers, without empty, reversed or non-finite ranges."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 2**31)
    cut = lambda x: F.when(finite(x), F.when(x.cast("double") < 0, F.ceil(x.cast("double"))).otherwise(F.floor(x.cast("double")))).cast("int")
    whole = F.transform(_col(ranges), lambda r: F.struct(cut(r["start"]).alias("start"), cut(r["end"]).alias("end")))
    return F.filter(whole, lambda r: F.coalesce(r["end"] > r["start"], F.lit(False)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, inside an expression."""
    return F.transform(F.array(value), body)[0]


#: Ranges that are joined in one fold; growing an array by one copies it, so longer arrays are folded in parts.
_FOLD = 256


def merge_ranges(ranges: Column | str) -> Column:
    """Sorted by start, with overlapping and adjacent ranges joined. One open range is carried over the sorted ones."""
    none, closed = F.lit(None).cast(RANGE), F.array().cast(RANGES)

    def step(acc: Column, r: Column) -> Column:
        joins = acc["open"].isNotNull() & (r["start"] <= acc["open"]["end"])
        grown = F.struct(acc["open"]["start"].alias("start"), F.greatest(acc["open"]["end"], r["end"]).alias("end"))
        done = F.when(joins | acc["open"].isNull(), acc["closed"]).otherwise(F.concat(acc["closed"], F.array(acc["open"])))
        return F.struct(F.when(joins, grown).otherwise(r).alias("open"), done.alias("closed"))

    def fold(part: Column, first: Column) -> Column:
        return F.aggregate(part, F.struct(first.alias("open"), closed.alias("closed")), step)

    def ended(acc: Column, parts: Column) -> Column:
        return F.when(acc["open"].isNull(), parts).otherwise(F.concat(parts, F.array(acc["open"])))

    def long(rs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(rs) - 1) / _FOLD).cast("int")), lambda c: F.slice(rs, c * _FOLD + 1, _FOLD))
        next_ = lambda acc, part: let(fold(part, acc["open"]), lambda x: F.struct(x["open"].alias("open"), F.concat(acc["closed"], F.array(x["closed"])).alias("closed")))
        return F.aggregate(parts, F.struct(none.alias("open"), F.array().cast(ArrayType(RANGES)).alias("closed")), next_, lambda acc: ended(acc, F.flatten(acc["closed"])))

    short = lambda rs: let(fold(rs, none), lambda acc: ended(acc, acc["closed"]))
    return let(F.array_sort(normalize_ranges(ranges)), lambda rs: F.when(F.size(rs) <= _FOLD, short(rs)).otherwise(long(rs)))


def _masked(text: Column, ranges: Column, fill: Callable[[Column], Column]) -> Column:
    """Fold over the merged ranges with ``substring``: the cost is the text's length, not length times ranges."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    n = F.length(text)

    def step(acc, r):
        s, e = F.least(F.greatest(r["start"], acc["at"]), n), F.least(F.greatest(r["end"], acc["at"]), n)
        return F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s - acc["at"]), fill(F.substring(text, s + 1, e - s))).alias("out"), e.alias("at"))

    return F.aggregate(merge_ranges(ranges), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, n)))


def mask_code_point_ranges(c: Column | str, ranges: Column | str, mask: Column | str = "*") -> Column:
    """One mask character a covered code point."""
    m = mask_char(mask if isinstance(mask, Column) else F.lit(mask))
    return _masked(normalize_text(c), _col(ranges), lambda part: F.repeat(m, F.length(part)))


def censor_code_point_ranges(c: Column | str, ranges: Column | str, mask: Column | str = "*") -> Column:
    """A mask character a covered UTF-16 unit, so the UTF-16 length stays."""
    m = length_preserving_mask_char(mask if isinstance(mask, Column) else F.lit(mask))
    return _masked(normalize_text(c), _col(ranges), lambda part: F.repeat(m, utf16_length(part)))


def utf16_to_code_points(c: Column | str, ranges: Column | str) -> Column:
    """UTF-16 ranges as code-point ranges; text without astral characters keeps its ranges."""
    c = normalize_text(c)

    @F.pandas_udf(RANGES)
    def convert(text: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in T.u16_to_cp(t, [(r["start"], r["end"]) for r in rs])] for t, rs in zip(text, given)])

    return F.when(c.rlike(_ASTRAL), convert(c, normalize_ranges(ranges))).otherwise(normalize_ranges(ranges))


def mask_ranges(c: Column | str, ranges: Column | str, mask: Column | str = "*") -> Column:
    """UTF-16 ranges, one mask character a covered code point."""
    return mask_code_point_ranges(c, utf16_to_code_points(c, ranges), mask)


def text_hints(c: Column | str) -> Column:
    """Sixteen cheap facts that gate the scanners."""
    c = normalize_text(c)
    spaces = F.regexp_count(c, F.lit(_SPACES))
    digits = F.regexp_count(c, F.lit(r"\p{Nd}"))
    punctuation = F.regexp_count(c, F.lit(rf"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]|(?![\x00-\x7F])\p{{P}}"))
    ascii_only = ~c.rlike(r"[^\x00-\x7F]")
    form = lambda k: c.rlike("[" + "".join(f"\\x{{{ord(x):X}}}" for x in _FORMS[k]) + "]")
    values = [utf16_length(c), F.length(c), c == "", ascii_only, ~ascii_only, digits > 0, digits, c.rlike("[A-Za-z]"), spaces > 0, punctuation > 0, punctuation, *(form(k) for k in _FORMS)]
    return F.struct(*(v.cast(f.dataType).alias(f.name) for v, f in zip(values, HINTS)))


def scan_result(ranges: Column | str, metadata: Column | None = None) -> Column:
    """Merged ranges with optional metadata (map<string,string>)."""
    return F.struct(merge_ranges(ranges).alias("ranges"), (metadata if metadata is not None else F.lit(None).cast("map<string,string>")).alias("metadata"))
