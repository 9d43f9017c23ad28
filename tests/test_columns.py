from pyspark.sql import functions as F

from textweir.functions import columns as C
from textweir.kernels import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<struct<start:double,end:double>>'}" for k, v in values.items())).select(column).first()[0]


def test_merge_adjacent_and_drop_bad(spark):
    got = one(spark, C.merge_ranges("r"), r=[(5.9, 8.0), (0.0, 2.0), (2.0, 4.0), (7.0, 7.0), (9.0, 8.5), (float("nan"), 3.0), (1.0, float("inf")), (None, 2.0)])
    assert [(x.start, x.end) for x in got] == [(0, 4), (5, 8)]
    assert T.merge([(0, 2), (2, 4), (5, 8), (6, 7)]) == [(0, 4), (5, 8)]


def test_merge_of_many_ranges(spark):
    import random

    r = random.Random(2)
    for n in (0, 1, 255, 256, 257, 512, 513, 3000):
        for reach in (1, 40, 3000):
            given = [(float(a), float(a + r.randrange(1, reach + 1))) for a in (r.randrange(0, 20_000) for _ in range(n))]
            got = one(spark, C.merge_ranges("r"), r=given)
            assert [(x.start, x.end) for x in got] == T.merge([(int(a), int(b)) for a, b in given])


def test_masks(spark):
    cases = [("a😀z", [(1.0, 2.0)], "*", "a*z", "a**z"), ("a😀z", [(1.0, 2.0)], "#", "a#z", "a##z"), ("abc", [(1.0, 9.0)], "", "a**", "a**"), ("abc", [], "x", "abc", "abc"), (None, [(0.0, 1.0)], "*", "", ""), ("abcd", [(-2.0, 1.0), (3.0, 4.0)], "ab", "abca"[:0] + "abca"[:1] + "bc" + "a", "abca"[:1] + "bc" + "a")]
    for text, ranges, mask, plain, preserved in cases:
        assert one(spark, C.mask_code_point_ranges("t", "r", mask), t=text, r=ranges) == plain
        assert one(spark, C.censor_code_point_ranges("t", "r", mask), t=text, r=ranges) == preserved
        assert T.censor(text or "", [(int(a), int(b)) for a, b in ranges], mask) == preserved
    assert one(spark, C.censor_code_point_ranges("t", "r", "😀"), t="abc", r=[(0.0, 2.0)]) == "**c"
    assert one(spark, C.mask_code_point_ranges("t", "r", "😀"), t="abc", r=[(0.0, 2.0)]) == "😀😀c"
    assert one(spark, C.mask_ranges("t", "r"), t="a😀z", r=[(1.0, 3.0)]) == "a*z"


def test_text(spark):
    assert one(spark, C.strip_zero_width("t"), t="a​b﻿‍c") == "abc"
    assert one(spark, C.lower_nfkc("t"), t="ＡＢ℡ⅣÉ") == "abteliv" + "é"
    assert one(spark, C.code_points("t"), t="a😀") == ["a", "😀"]
    assert one(spark, C.code_points("t"), t="") == []
    assert one(spark, C.utf16_length("t"), t="a😀") == 3
    d = spark.createDataFrame([(1.0, 2.5)], "a double, b double")
    assert d.select(C.normalize_text("a", d.schema["a"].dataType), C.normalize_text("b", d.schema["b"].dataType)).first() == ("1", "2.5")


def test_hints(spark):
    h = one(spark, C.text_hints("t"), t="A+9@example.com/path:tail.")
    assert (h.text_length, h.code_point_length, h.digit_count, h.punctuation_count) == (26, 26, 1, 6)
    assert h.has_plus and h.has_at_sign and h.has_dot and h.has_slash and h.has_colon and h.has_ascii_only and not h.has_whitespace
    h = one(spark, C.text_hints("t"), t="٣＠ a😀﻿…")
    assert h.has_at_sign and h.has_digit and h.has_whitespace and h.has_non_ascii and h.text_length == 8 and h.punctuation_count == 2
    assert one(spark, C.text_hints("t"), t=None).is_empty
    assert spark.range(1).select(C.scan_result(F.array().cast(C.RANGES))).first()[0].ranges == []
