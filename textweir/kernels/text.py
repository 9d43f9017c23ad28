"""Text primitives shared by the kernels: white space, zero-width marks, folding, ranges, masking. No Spark here.

Ranges are half-open. ``cp`` counts code points (Python's own index), ``u16`` counts UTF-16 units.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable

import regex

#: White space and zero-width marks of the text model (fixed values): U+FEFF and U+00A0 count as space, U+0085 does not.
SPACE = "\t\n\x0b\x0c\r \xa0                　﻿"
ZERO_WIDTH = "​‌‍⁠﻿"
SPACES, ZEROS = frozenset(SPACE), frozenset(ZERO_WIDTH)
SPACE_RUN = regex.compile(f"[{SPACE}]+")
ZERO_RUN = regex.compile(f"[{ZERO_WIDTH}]+")
LETTER_OR_DIGIT = regex.compile(r"[\p{L}\p{N}]")

Range = tuple[int, int]


def text_of(value: object) -> str:
    """Null is empty; whole doubles print without a fraction, as text input does elsewhere in the engine."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def lower_nfkc(value: object) -> str:
    s = text_of(value)
    return s.lower() if s.isascii() else unicodedata.normalize("NFKC", s).lower()


def strip_zero_width(value: object) -> str:
    return ZERO_RUN.sub("", text_of(value))


def u16_width(c: str) -> int:
    return 2 if ord(c) > 0xFFFF else 1


def u16_length(s: str) -> int:
    return len(s) + sum(c > "￿" for c in s)


def u16_to_cp(text: str, ranges: Iterable[Range]) -> list[Range]:
    """UTF-16 ranges as code-point ranges; a unit inside a pair belongs to its code point."""
    ranges = list(ranges)
    if not any(c > "￿" for c in text):
        return ranges
    at: list[int] = []
    for i, c in enumerate(text):
        at += [i] * u16_width(c)
    at.append(len(text))
    out = []
    for s, e in ranges:
        s, e = min(max(s, 0), len(at) - 1), min(max(e, 0), len(at) - 1)
        out.append((at[s], at[e - 1] + 1 if e > s else at[s]))
    return out


def cp_to_u16(text: str, ranges: Iterable[Range]) -> list[Range]:
    ranges = list(ranges)
    if not any(c > "￿" for c in text):
        return ranges
    at, n = [0], 0
    for c in text:
        n += u16_width(c)
        at.append(n)
    return [(at[s], at[e]) for s, e in ranges]


def merge(ranges: Iterable[Range]) -> list[Range]:
    """Sorted, with overlapping and adjacent ranges joined; empty ones go."""
    out: list[list[int]] = []
    for s, e in sorted(r for r in ranges if r[1] > r[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def mask_char(value: object, fallback_astral: bool = False) -> str:
    """First code point, ``*`` if there is none, or if it takes two units where length must stay."""
    s = text_of(value)
    c = s[:1] or "*"
    return "*" if fallback_astral and c > "￿" else c


def censor(text: str, ranges: Iterable[Range], mask: object = "*") -> str:
    """Mask code-point ranges so that the UTF-16 length stays."""
    m, out, at = mask_char(mask, True), [], 0
    for s, e in merge(ranges):
        s, e = max(s, at), min(e, len(text))
        if e <= s:
            continue
        out += [text[at:s], m * u16_length(text[s:e])]
        at = e
    return "".join([*out, text[at:]])


def fold_code_points(text: str) -> list[str]:
    """Each code point's NFKC lower case, which may be several characters."""
    if text.isascii():
        return list(text.lower())
    return [c.lower() if c < "\x80" else unicodedata.normalize("NFKC", c).lower() for c in text]


@functools.lru_cache(maxsize=1)
def folded_class() -> str:
    """A regex class of the characters beyond ASCII whose folding holds an ASCII character, and of zero-width and combining marks:
    texts without them are what they look like. For gates; worked out on first use."""
    points = [i for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000 and (any(c < "\x80" for c in unicodedata.normalize("NFKC", chr(i)).lower()) or chr(i) in ZERO_WIDTH or chr(i) in SPACE)]
    spans: list[list[int]] = []
    for i in points:
        if spans and i == spans[-1][1] + 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in spans) + r"\p{Mn}\p{Cf}]"
