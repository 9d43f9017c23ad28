"""Phone kernel: numbers made from templates of digit groups, and things made of digits that are no numbers."""

import itertools
import json
import random
import time

import pytest
import regex
from helpers import check_censor

from textweir.kernels import phone as K
from textweir.kernels import text as T

R = random.Random(11)


def digits(n: int, first: str = "23456789") -> str:
    return R.choice(first) + "".join(R.choice("0123456789") for _ in range(n - 1))


def made(template: str) -> str:
    """A number from a template: each N is any digit, the rest stays."""
    return "".join(R.choice("23456789") if c == "N" else c for c in template)


#: Shapes that count as numbers anywhere.
SHAPES = ["+7 NNN NNN NN NN", "+1 NNN NNN NNNN", "+44 NN NNNN NNNN", "+49 NNN NNNNNNN", "8 NNN NNN NN NN", "NNN NNN NNNN", "(NNN) NNN NNNN", "+7 (NNN) NNN-NN-NN", "+7-NNN-NNN-NN-NN", "+7.NNN.NNN.NN.NN", "+7NNNNNNNNNN", "8NNNNNNNNNN", "0044 NN NNNN NNNN", "+33 N NN NN NN NN", "7NNN NNN NNN", "NNNNNNNNNN", "NNNNNNNNNNNNNNN"]
NUMBERS = [made(s) for s in SHAPES for _ in range(3)]


@pytest.mark.parametrize("number", NUMBERS)
def test_numbers_in_text(number):
    for text in (number, f"ring {number} today", f"({number})", f"tel: {number}, thanks", f"{number}\n", f"«{number}»"):
        if not (text[0] == "(" and number[0] == "("):
            once = T.censor(text, K.scan(text))
            assert not any(c.isdigit() for c in once), text
            assert T.censor(once, K.scan(once)) == once and T.u16_length(once) == T.u16_length(text) and K.check(text)
    check_censor(K, f"ring {number} today", [number])


@pytest.mark.parametrize("zero", K.ZERO_DIGITS)
def test_digits_of_every_script(zero):
    number = "".join(chr(zero + int(d)) for d in digits(10))
    check_censor(K, f"call {number} now", [number])


def test_marks_that_do_not_count():
    number = "+7 912 345 67 89"
    for mark in ("​", "﻿", "­"):
        hidden = number.replace(" ", mark)
        check_censor(K, f"at {hidden} now", [hidden])
    check_censor(K, "from 79123456789́ on", ["79123456789́"])


NO_NUMBERS = (
    [f"{y}-{m:02}-{d:02} {h:02}:{mi:02}" for y, m, d, h, mi in ((R.randrange(1950, 2060), R.randrange(1, 13), R.randrange(1, 29), R.randrange(24), R.randrange(60)) for _ in range(12))]
    + [f"{d:02}.{m:02}.{y} {h:02}.{mi:02}" for y, m, d, h, mi in ((R.randrange(1950, 2060), R.randrange(1, 13), R.randrange(1, 29), R.randrange(24), R.randrange(60)) for _ in range(12))]
    + [f"host {R.randrange(10, 256)}.{R.randrange(100, 256)}.{R.randrange(100, 256)}.{R.randrange(10, 256)}" for _ in range(8)]
    + [f"at {R.uniform(-89, 89):.5f}, {R.uniform(10, 179):.5f}" for _ in range(8)]
    + [f"sum {R.randrange(1, 999)},{R.randrange(100, 999)},{R.randrange(100, 999)}.{R.randrange(10, 99)}" for _ in range(8)]
    + ["id 3f2a91bc-77d0-4c1e-9b52-604417250938", "ISBN 9783161484100", "x" + digits(11), digits(11) + "y", digits(16), "0" * 11, digits(9), "12 34 56", "lot_" + digits(10), "code #" + digits(6), "-2147483648", "12 34 56 78 91 12 34"]
)


@pytest.mark.parametrize("text", NO_NUMBERS)
def test_no_numbers(text):
    check_censor(K, text, [])


@pytest.mark.parametrize("before", NO_NUMBERS[:36] + ["price 12.50", "ratio ½", "10.0.0.7:8080", "net 10.0.0.0/24", "v 2.3.4", "unit AB12", "fe80::1"])
def test_a_number_behind_something_else(before):
    number = "+1 346 555 0172"
    check_censor(K, f"{before}; {number}", [number])


@pytest.mark.parametrize("label", K.LABELS)
def test_labels_touch(label):
    for number in ("+79123456789", "(79123456789)"):
        check_censor(K, f"{label}{number}", [number])


def test_extensions_and_glue():
    number = "+1 346 555 0172"
    for tail, ok in (("x12", True), ("x.12", True), ("ext44", True), ("z", False), ("_1", False)):
        check_censor(K, f"dial {number}{tail}", [number] if ok else [])


def metadata(**fields) -> str:
    return json.dumps(fields)


@pytest.mark.parametrize("key,value,parts", [("cursor", 1690000000123, []), ("serverTs", 1690000000123, []), ("cursor", "1690000000123-0", []), ("cursor", "1690000000123-79123456789", ["79123456789"]), ("cursor", "1690000000123-0-79123456789", ["79123456789"]), ("Cursor", 1690000000123, ["1690000000123"]), ("ts", 1690000000123, ["1690000000123"]), ("serverTs", "1690000000123-0", ["1690000000123"])])
def test_metadata_numbers(key, value, parts):
    for wrap in ("{}", "note {} end", '{{"items": [{}]}}', '"stray {}'):
        check_censor(K, wrap.format(metadata(**{key: value})), parts)


def test_metadata_needs_a_complete_object():
    whole = metadata(cursor=1690000000123)
    assert K.scan(whole) == [] and len(K.scan(whole[:-1])) == 1
    page = json.dumps({"items": [{"id": i, "tags": [{}, 'a}"{']} for i in range(50)], "cursor": 1690000000123, "serverTs": "1690000000123", "tel": "+79123456789"})
    for text in (page, "log: {x " + page + " and {", '" {' + page):
        assert [text[a:b] for a, b in K.scan(text)] == ["+79123456789"], text
    assert len(K.scan(page[:-1])) == 3
    assert K._objects('{"a": {"b": 1}, } {"c": [1, {}]} {"d" 1} [{}]') == [(6, 14), (18, 32), (42, 44)]


def test_gate_is_a_superset():
    for number, before in itertools.product(NUMBERS, ("", "call ", "é ")):
        assert regex.search(K.GATE, before + number)


@pytest.mark.parametrize("text", ["0" * 40_000, "1 " * 20_000, '{"a":' * 5_000, "(" * 40_000, "+ " * 20_000, "12-" * 15_000, '{"cursor":1690000000123} ' * 3_000, '" ' + '{"cursor":1690000000123} ' * 3_000, '{"cursor":1690000000123, ' * 2_000, "tel +1 346 555 0172, " * 4_000], ids=range(10))
def test_linear(text):
    began = time.process_time()
    K.scan(text)
    assert time.process_time() - began < 20
