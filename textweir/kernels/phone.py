"""Phone scanner: runs of digit groups of 10 to 15 digits that are shaped like a number, and not like something else.

The text is folded to ASCII digits and one separator class, without ignorable marks, with a map back to code points.
Dates, times, addresses, coordinates, amounts, versions, identifiers and JSON metadata are marked first; numbers are
then looked for in what is left, group by group.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from calendar import monthrange
from collections.abc import Iterator

import regex

from .text import SPACES, ZEROS, Range, merge

#: Code points of the zeros of the decimal digit rows that are folded (fixed values; a row has ten digits).
ZERO_DIGITS = [
    0x30, 0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xDE6, 0xE50, 0xED0, 0xF20, 0x1040, 0x1090, 0x17E0, 0x1810, 0x1946, 0x19D0, 0x1A80, 0x1A90, 0x1B50, 0x1BB0, 0x1C40, 0x1C50,
    0xA620, 0xA8D0, 0xA900, 0xA9D0, 0xA9F0, 0xAA50, 0xABF0, 0xFF10, 0x104A0, 0x10D30, 0x10D40, 0x11066, 0x110F0, 0x11136, 0x111D0, 0x112F0, 0x11450, 0x114D0, 0x11650, 0x116C0, 0x116D0, 0x116DA, 0x11730, 0x118E0, 0x11950,
    0x11BF0, 0x11C50, 0x11D50, 0x11DA0, 0x11DE0, 0x11F50, 0x16130, 0x16A60, 0x16AC0, 0x16B50, 0x16D70, 0x1CCF0, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6, 0x1E140, 0x1E2F0, 0x1E4F0, 0x1E5F1, 0x1E950, 0x1FBF0,
]
_DIGIT = {chr(z + d): str(d) for z in ZERO_DIGITS for d in range(10)}
MIN_DIGITS, MAX_DIGITS = 10, 15
#: Words after which digits may follow without a blank (fixed values).
LABELS = "tel phone mobile cell call fax whatsapp telegram viber тел".split()
#: What a text must hold: ten digits of any script without a letter between them.
GATE = r"(?:[\p{Nd}\p{No}][^\p{L}\p{Nd}\p{No}]*+){10}"

_UUID = regex.compile(r"(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])")
_IPV4 = regex.compile(r"(?<![\d.+])(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2}(?!\d)|:\d{1,5}(?!\d))?(?![\d]|\.\d)")
_BOOK = regex.compile(r"(?:isbn|ean)(?:-1[03])?:? ?[\d -]{10,17}")
_TIME = r"(?:[01]?\d|2[0-3])[:.][0-5]\d(?:[:.][0-5]\d(?:\.\d{1,6})?)?(?: ?(?:z|[+-]\d{2}:?\d{2}))?(?![\d:])"
_DATE = regex.compile(rf"(?<![\d.+])(?:(?P<d>\d{{1,2}})(?P<s>[./-])(?P<m>\d{{1,2}})(?P=s)(?P<y>(?:19|20)?\d\d)|(?P<y2>(?:19|20)\d\d)(?P<s2>[./-])(?P<m2>\d{{1,2}})(?P=s2)(?P<d2>\d{{1,2}}))(?![\d.]?\d)(?:[ t](?:at )?{_TIME}|[ t]\d\d-\d\d-\d\d(?!\d))?")
_CLOCK = regex.compile(rf"(?<![\d.:+]){_TIME}(?=[ ,;)]|$)")
_COORD = regex.compile(r"(?<![\d.,])(?P<s>[+-]?)(?P<lat>\d{1,2}[.,]\d{3,8})[,;]? {1,2}(?P<t>[+-]?)(?P<lon>\d{1,3}[.,]\d{3,8})(?![\d.,]?\d)(?P<alt> \d{1,4}(?![ \d-]*\d))?")
_THOUSANDS = regex.compile(r"(?<![\d.,+(])(?! ?[78][.,]\d{3}[.,]\d{3}[.,]\d{3}(?!\d))(?:\d{1,3}(?P<g>[.,])\d{3}(?:(?P=g)\d{3})+|(?<!\d )(?![78] )\d{1,3}(?: \d{3}){2,}(?! \d{1,4}(?!\d)))(?:[.,]\d{1,2})?(?![\d.,]?\d)")
_AMOUNT = regex.compile(r"(?<![\d.,+(])\d{1,3}(?:(?:,\d{3})*\.\d{1,2}|(?:\.\d{3})*,\d{1,2})(?= )")
_VERSION = regex.compile(r"(?<=version |ver |v )\d{1,3}(?:\.\d{1,3}){1,3}(?![\d.])")
_LEAST = regex.compile(r"(?<!\d)-2147483648(?!\d)")
_IPV6 = regex.compile(r"(?<![0-9a-z:])(?:[0-9a-f]{1,4}:){1,7}:?(?:[0-9a-f]{1,4}(?::|(?![0-9a-z])))*(?=\d{10,}|[ ,;)]|$)")
_META = regex.compile(r'(?P<key>"(?:[^"\\]|\\.){1,40}")[ \t\r\n]*:[ \t\r\n]*(?P<q>"?)(?P<n>\d{13})(?P<seq>-0)?(?=(?P=q)|-)')

#: Braces and quotes from the right, a quote with the backslashes before it.
_BACKWARD = regex.compile(r'(?r)\\*+"|[{}]')
#: A number behind a cursor, also when it is masked already.
_NUMBER_AFTER = regex.compile(r"-(?:0-)?(?:\d{10,15}|([^\w\s])\1{9,}+)")

_SEP = r"[ \-./()‐‑‒–—·]"
_RUN = regex.compile(rf"(?:\G|(?<![(+ ]))[(+ ]*+\d(?:{_SEP}{{0,4}}\+?\d)*(?: ?\))?")
_GROUP = regex.compile(r"\d+")
#: What may stand before a number's first digit, from its first sign on.
_LEAD = regex.compile(r"(?:[+(][+( ]*)?$")
_CLOSE, _EXTENSION, _CODE = regex.compile(r" ?\)"), regex.compile(r"(?:x|ext)\.?\d"), regex.compile(r"[*#]+\d")
_LABELS = tuple(LABELS)
_LABELLED = regex.compile(rf"(?:{'|'.join(LABELS)})[ :.(+]*$")


class _Folded:
    def __init__(self, text: str):
        if text.isascii():
            self.s, self.at = text.lower(), range(len(text) + 1)
            return
        s, at = [], []
        for i, c in enumerate(text):
            if c in ZEROS or unicodedata.category(c) in ("Mn", "Cf", "Me") or 0xFE00 <= ord(c) <= 0xFE0F:
                continue
            d = _DIGIT.get(c)
            if d is None and c > "\x7f":
                n = unicodedata.normalize("NFKC", c)
                d = _DIGIT.get(n, n.lower() if len(n) == 1 else c)
            s.append(" " if c in SPACES and c not in "\t\r\n" else (d or c.lower())[:1])
            at.append(i)
        self.s, self.at = "".join(s), [*at, len(text)]


def _real_date(y: int, m: int, d: int) -> bool:
    y += 2000 if y < 100 else 0
    return 1 <= m <= 12 and 1 <= d <= monthrange(y, m)[1]


def _is_date(m: regex.Match) -> bool:
    if m["y2"]:
        return _real_date(int(m["y2"]), int(m["m2"]), int(m["d2"]))
    y, a, b = int(m["y"]), int(m["d"]), int(m["m"])
    return _real_date(y, b, a) or _real_date(y, a, b)


def _is_coordinate(m: regex.Match) -> bool:
    lat, lon = (float(m[x].replace(",", ".")) for x in ("lat", "lon"))
    return lat <= 90 and lon <= 180


_JSON_TOKEN = regex.compile(r'"(?:[^"\\]|\\.)*+(?:"|$)|[{}\[\]:,]|[^"{}\[\]:,\s]+', regex.DOTALL)


def _objects(text: str) -> list[tuple[int, int]]:
    """Merged spans of all complete JSON objects: one pass with a stack, from each brace outside of any.

    A container that is no JSON is given up when it closes; the objects inside it stay, and what follows is read on."""
    spans: list[tuple[int, int]] = []
    stack: list[list] = []  # [opening, start, whether JSON so far, what may come next]

    def value(good: bool = True) -> None:
        if stack:
            top = stack[-1]
            top[2] = top[2] and good and top[3] in ("value", "value or end")
            top[3] = "comma or end"

    at = text.find("{")
    while 0 <= at < len(text):
        if not stack:
            at = text.find("{", at)
            if at < 0:
                break
        m = _JSON_TOKEN.search(text, at)
        if not m:
            break
        t, at = m.group(), m.end()
        if t[0] in "{[":
            stack.append([t, m.start(), True, "key or end" if t == "{" else "value or end"])
        elif t[0] in "}]":
            want = "{" if t == "}" else "["
            while stack and stack[-1][0] != want:
                stack.pop()
                value(False)
            if stack:
                _, start, good, state = stack.pop()
                good = good and state in ("comma or end", "key or end", "value or end")
                if good and want == "{":
                    spans.append((start, at))
                value(good)
        elif t == ":":
            stack[-1][2] = stack[-1][2] and stack[-1][3] == "colon"
            stack[-1][3] = "value"
        elif t == ",":
            stack[-1][2] = stack[-1][2] and stack[-1][3] == "comma or end"
            stack[-1][3] = "key" if stack[-1][0] == "{" else "value"
        else:
            try:
                json.loads(t)
                good = True
            except ValueError:
                good = False
            if t[0] == '"' and stack[-1][0] == "{" and stack[-1][3] in ("key", "key or end"):
                stack[-1][2], stack[-1][3] = stack[-1][2] and good, "colon"
            else:
                value(good)
    return merge(spans)


def _behind_stray_quote(text: str, position: int, ends: dict[int, int]) -> bool:
    """Whether ``position`` lies in a JSON object that starts at the nearest brace, going back, that no later brace closes: for
    text whose quotes do not pair up, which hides objects from ``_objects``. ``ends``: where objects tried before end."""
    depth, quoted = 0, False
    for m in _BACKWARD.finditer(text, 0, position):
        c = m.group()
        if c[-1] == '"':
            quoted = quoted if len(c) % 2 == 0 else not quoted  # behind an odd number of backslashes it is no quote
        elif quoted:
            continue
        elif c == "}":
            depth += 1
        elif depth:
            depth -= 1
        else:
            start = m.start()
            if start not in ends:
                try:
                    ends[start] = json.JSONDecoder().raw_decode(text, start)[1]
                except (ValueError, RecursionError):
                    ends[start] = 0
            return ends[start] > position
    return False


def _metadata(text: str) -> Iterator[tuple[int, int]]:
    """Code-point spans of cursor and timestamp numbers, in exact ASCII spelling, inside complete JSON objects."""
    objects, ends = None, {}
    for m in _META.finditer(text):
        try:
            key = json.loads(m["key"])
        except ValueError:
            continue
        if key not in ("cursor", "serverTs") or not m["n"].isascii():
            continue
        objects = _objects(text) if objects is None else objects
        i = bisect_right(objects, (m.start("n"), len(text) + 1)) - 1
        if (i < 0 or objects[i][1] <= m.start("n")) and not _behind_stray_quote(text, m.start("n"), ends):
            continue
        end, close = m.end(), m["q"]
        if text.startswith("-", end):
            after = _NUMBER_AFTER.match(text, end)
            if after and text.startswith(close, after.end()):
                yield m.start("n"), end
        elif m["seq"]:
            if key == "cursor" and close and text.startswith('"', end):
                yield m.start("n"), end
        elif text.startswith(close, end):
            yield m.start("n"), end


def _other_numbers(s: str) -> list[tuple[int, int]]:
    spans = [m.span() for p in (_UUID, _IPV4, _BOOK, _LEAST) for m in p.finditer(s) if p is not _IPV4 or all(int(x) <= 255 for x in _GROUP.findall(m.group())[:4])]
    spans += [m.span() for m in _DATE.finditer(s) if _is_date(m)]
    spans += [m.span() for m in _COORD.finditer(s) if _is_coordinate(m)]
    spans += [m.span() for p in (_CLOCK, _THOUSANDS, _AMOUNT, _VERSION, _IPV6) for m in p.finditer(s)]
    return merge(spans)


def _shaped(groups: list[str], plus: bool, paren: bool, label: bool) -> bool:
    """Whether digit groups make a number."""
    n = [len(g) for g in groups]
    total = sum(n)
    if not MIN_DIGITS <= total <= MAX_DIGITS or not any(c != "0" for g in groups for c in g):
        return False
    if len(n) == 1:
        return True
    if plus:
        return n[0] <= 4 and max(n) <= 10
    first = groups[0]
    if first.startswith("00") and n[0] in (2, 4, 5) or paren and max(n) <= 7:
        return True
    if n[0] == 4 and max(n[1:]) > 3:
        return False
    if first[0] in "78" and n == [4, 2, 2, 2, 2]:
        return True
    if first[0] in "78" and max(n) <= 7:
        return total in (10, 11) or max(n) <= 4 and total <= 13 and len(n) <= 4
    if n in ([3, 3, 4], [1, 3, 3, 4], [3, 3, 2, 2], [2, 4, 4], [3, 7], [2, 2, 2, 2, 2]):
        return n != [2, 2, 2, 2, 2] or first[0] == "0"
    return label and len(n) >= 3 and total <= 13


def _exact(groups: list[str], plus: bool) -> bool:
    n, first = [len(g) for g in groups], groups[0]
    total = sum(n)
    if plus:
        return first[0] in "17" and total == 11
    return first[0] in "78" and (total == 11 or n == [4, 2, 2, 2, 2]) or n[0] == 4 and first[0] in "78" and total == 10 or n in ([3, 3, 4], [3, 3, 2, 2], [1, 3, 3, 4]) or len(n) == 1


def _left_ok(s: str, i: int) -> bool:
    """Nothing glued to the left: a letter, digit or underscore, also behind one sign or dot, unless it is a label."""
    if i == 0:
        return True
    c = s[i - 1]
    if c.isalnum() or c == "_":
        return s.endswith(_LABELS, 0, i) and s[i] in "+(" or unicodedata.category(c) in ("So",) or not c.isalpha() and not c.isdigit() and c != "_"
    if c in ".-" and i > 1 and (s[i - 2].isalnum() or s[i - 2] == "_"):
        if c == "-":
            return s[i - 2].isdigit()
        return s.endswith(_LABELS, 0, i - 1) or s[i - 2].isdigit()
    return True


def _right_ok(s: str, i: int) -> bool:
    if i >= len(s):
        return True
    c = s[i]
    if c.isalnum() or c == "_":
        return bool(_EXTENSION.match(s, i))
    return not (c in "*#" and _CODE.match(s, i))


def _in_run(s: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Numbers of a run of digit groups. A number has at most fifteen digits, so at most fifteen groups are looked at from each."""
    groups = [m.span() for m in _GROUP.finditer(s, lo, hi)]
    i = 0
    while i < len(groups):
        start = groups[i][0]
        lead = groups[i - 1][1] if i else lo
        lead = start - len(_LEAD.search(s, lead, start).group())
        head = s[lead:start]
        plus, digits, ends = "+" in head, 0, []
        for j in range(i, len(groups)):
            digits += groups[j][1] - groups[j][0]
            if digits > MAX_DIGITS:
                break
            if digits >= MIN_DIGITS:
                ends.append(j + 1)
        best = None
        label = bool(ends) and bool(_LABELLED.search(s, max(0, lead - 20), lead))
        for j in reversed(ends):
            end = groups[j - 1][1]
            texts = [s[a:b] for a, b in groups[i:j]]
            inner = s[start:end]
            if j > i + 1 and not plus and max(map(len, texts)) > 6:
                continue
            if "+" in inner:
                continue
            opens = head.count("(") + inner.count("(")
            closed = inner.count(")")
            stop = end
            if opens > closed:
                m = _CLOSE.match(s, end)
                if m:
                    stop = m.end()
                    closed += 1
            paren = "(" in head and closed >= 1
            if closed > opens or opens > closed and "(" in inner:
                continue
            begin = lead
            if opens > closed:  # an opening bracket that stays outside
                begin = lead + head.rfind("(") + 1
                if closed:
                    continue
            if not _shaped(texts, plus, paren, label) or not _left_ok(s, begin) or not _right_ok(s, stop):
                continue
            exact = _exact(texts, plus)
            if best is None or exact and not best[3]:
                best = (begin, stop, j, exact)
        if best:
            yield best[0], best[1]
            i = best[2]
        else:
            i += 1


def matches(text: str) -> Iterator[Range]:
    if not text:
        return
    f = _Folded(text)
    if sum(map(f.s.count, "0123456789")) < MIN_DIGITS:
        return
    kept = [(a, b) for a, b in _other_numbers(f.s) if not (_LEAST.fullmatch(f.s, a, b) and text[f.at[a] : f.at[b - 1] + 1] != f.s[a:b])]
    if '"' in text and "{" in text:
        spans = list(_metadata(text))
        if spans:
            index = {p: k for k, p in enumerate(f.at)}
            kept = merge([*kept, *((index[a], index.get(b, len(f.s))) for a, b in spans)])
    cuts, at = [], 0
    for a, b in [*kept, (len(f.s), len(f.s))]:
        if a > at:
            cuts.append((at, a))
        at = max(at, b)
    for lo, hi in cuts:
        for m in _RUN.finditer(f.s, lo, hi):
            for a, b in _in_run(f.s, m.start(), m.end()):
                end = f.at[b - 1] + 1
                while end < f.at[b] and unicodedata.category(text[end]) in ("Mn", "Me"):
                    end += 1
                yield f.at[a], end


def scan(text: str) -> list[Range]:
    """Code-point ranges of numbers, merged."""
    return merge(matches(text))


def check(text: str) -> bool:
    return next(matches(text), None) is not None
