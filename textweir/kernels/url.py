"""URL scanner: explicit links (http, https, hxxp), bare domains of known top-level domains, and obfuscated forms.

The text is folded one code point to one character, so positions in the folded views are code-point positions. Regular
expressions find where a link can begin; small readers then take labels, dots, ports and tails.
"""

from __future__ import annotations

import ipaddress
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import regex

from .text import SPACES, ZEROS, Range, folded_class, lower_nfkc, merge

#: Top-level domains accepted without a scheme (fixed values).
DEFAULT_TLDS = "ru рф com biz net org io gg me co cc uk ly gl tv dev app xyz online site link top shop store pro info su ua by kz".split()
#: Cyrillic letters that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans({"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "т": "t", "у": "y", "х": "x", "ё": "e"})
DOTS = frozenset(".。｡．·•⋅・")
SENTENCE_DOTS = frozenset(".。")
OPENERS = {"[": "]", "(": ")", "{": "}", "<": ">"}
TRAILING = frozenset(".,!?;:)]}>\"'`”’»")
CLOSERS = {")": "(", "]": "[", "}": "{", ">": "<"}
Z = "​"
#: Names of dots in words (fixed values): as folded to Latin, and as written.
DOT_WORDS = ("dot", "d0t")
DOT_WORDS_RAW = ("точка",)

_SEP = r"[^\p{L}\p{N}:/\\\[\](){}<>]*"
_SCHEME = regex.compile(rf"(?<![\p{{L}}\p{{N}}])h{_SEP}(?:t{_SEP}t|x{_SEP}x){_SEP}p(?:{_SEP}s)?[\s{Z}]*(?:[\[({{<][\s{Z}]*:[\s{Z}]*[\])}}>][\s{Z}]*/[\s{Z}]*/|[\[({{<][\s{Z}]*:[\s{Z}]*/[\s{Z}]*/[\s{Z}]*[\])}}>]|:[\s{Z}]*/[\s{Z}]*/)")
@dataclass(frozen=True)
class UrlConfig:
    """``tlds``: accepted without a scheme; ``allowed_domains``: exact hosts left alone."""

    tlds: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    mask_char: str = "*"
    _tlds: frozenset = field(init=False, repr=False, compare=False, default=frozenset())
    _skeletons: frozenset = field(init=False, repr=False, compare=False, default=frozenset())
    _allowed: frozenset = field(init=False, repr=False, compare=False, default=frozenset())

    def __post_init__(self):
        tlds = normalize_tlds(self.tlds)
        object.__setattr__(self, "_tlds", frozenset(tlds))
        object.__setattr__(self, "_skeletons", frozenset(t.translate(LOOKALIKES) for t in tlds))
        object.__setattr__(self, "_allowed", frozenset(normalize_domains(self.allowed_domains)))


def gate(cfg: UrlConfig) -> str:
    """What a text must hold before the kernel looks at it: the letters of a scheme, a dot (or its name) before a known top-level
    domain, or a character that folds into something else or belongs to a script with look-alikes."""
    apart = "[^a-z0-9]*"
    tlds = "|".join([*(apart.join(t) for t in sorted(cfg._tlds) if t.isascii() and t.isalnum()), *(regex.escape(t) for t in sorted(cfg._tlds) if t.isascii() and not t.isalnum()), "xn--"])
    scheme = f"h{apart}(?:t{apart}t|x{apart}x){apart}p"
    return rf"(?i:{scheme}|(?:\.|d{apart}[o0]{apart}t){apart}(?:{tlds})(?![a-z0-9])|xn--)|[\p{{IsCyrillic}}\p{{IsGreek}}{''.join(sorted(DOTS - {'.'}))}]|{folded_class()}"


def normalize_tlds(raw: Iterable[object] | None) -> list[str]:
    """NFKC lower case, trimmed, empty and repeated ones dropped, order kept; the defaults where none are given."""
    source = list(raw or ()) or DEFAULT_TLDS
    return list(dict.fromkeys(t for t in (lower_nfkc(str(x if x is not None else "").strip()) for x in source) if t))


def normalize_domains(raw: Iterable[object] | None) -> list[str]:
    """Exact host names; addresses, ports, paths, single labels and over-long names are dropped."""
    out = []
    for x in raw or ():
        d = lower_nfkc(str(x).strip()).rstrip(".")
        labels = d.split(".")
        ok = len(labels) > 1 and len(d) <= 253 and all(regex.fullmatch(r"[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}-]{0,61}[\p{L}\p{N}\p{M}])?", label) for label in labels)
        if ok and not all(label.isdigit() for label in labels):
            out.append(d)
    return list(dict.fromkeys(out))


class _View:
    """Folded views of a text, one character a code point."""

    def __init__(self, text: str):
        if text.isascii():
            self.raw = text.lower()
        else:
            raw = []
            for c in text:
                if c in ZEROS:
                    raw.append(Z)
                    continue
                f = unicodedata.normalize("NFKC", c).lower()[:1] or c
                raw.append("." if c in DOTS or f in DOTS else " " if f in SPACES else f)
            self.raw = "".join(raw)
        self.text = text
        self.dots: dict[tuple[int, bool], tuple[int, bool] | None] = {}
        self.labels: dict[tuple[int, bool], tuple[int, str] | None] = {}
        self.pieces: dict[int, tuple[int, str] | None] = {}
        self.known: dict[str, bool] = {}
        self.skeleton = self.raw if text.isascii() else self.raw.translate(LOOKALIKES)
        self.n = len(text)

    def word(self, i: int) -> bool:
        return i < self.n and (self.raw[i].isalnum() or unicodedata.category(self.raw[i])[0] in "LN")

    def space(self, i: int) -> bool:
        return self.raw[i] in SPACES

    def skip_zero(self, i: int) -> int:
        while i < self.n and self.raw[i] == Z:
            i += 1
        return i

    def skip_blank(self, i: int) -> int:
        while i < self.n and (self.raw[i] == Z or self.space(i)):
            i += 1
        return i


@dataclass
class _Host:
    end: int
    labels: list[str]
    spaced: bool = False


_WORD_DOT = regex.compile(rf"(?:d[\s{Z}]*[o0][\s{Z}]*t)(?![\p{{L}}\p{{N}}])")
_RAW_DOT = regex.compile(rf"т[\s{Z}]*о[\s{Z}]*ч[\s{Z}]*к[\s{Z}]*а(?![\p{{L}}\p{{N}}])")


def _dot(v: _View, i: int, explicit: bool) -> tuple[int, bool] | None:
    """``_read_dot``, once a place: in a chain of labels each one's rest is looked at again."""
    if (i, explicit) not in v.dots:
        v.dots[i, explicit] = _read_dot(v, i, explicit)
    return v.dots[i, explicit]


def _label(v: _View, i: int, explicit: bool) -> tuple[int, str] | None:
    """``_read_label``, once a place."""
    if (i, explicit) not in v.labels:
        v.labels[i, explicit] = _read_label(v, i, explicit)
    return v.labels[i, explicit]


def _read_dot(v: _View, i: int, explicit: bool) -> tuple[int, bool] | None:
    """(end, spaced) of a dot at ``i`` with the blanks around it: a real one, a bracketed one, or a word in blanks."""
    j = v.skip_blank(i)
    if j >= v.n:
        return None
    before = any(v.space(k) for k in range(i, j))
    c = v.raw[j]
    if c == ".":
        k = v.skip_blank(j + 1)
        after = any(v.space(x) for x in range(j + 1, k))
        if after and not before:  # "site. com" ends a sentence unless its dot is no sentence dot
            return (k, True) if v.text[j] not in SENTENCE_DOTS and unicodedata.normalize("NFKC", v.text[j]) not in SENTENCE_DOTS else None
        if before and not after:
            return None
        return k, before
    if c in OPENERS:
        k = v.skip_blank(j + 1)
        if k < v.n and v.raw[k] == ".":
            end = k + 1
        elif m := (_WORD_DOT.match(v.skeleton, k) or _RAW_DOT.match(v.raw, k)):
            end = m.end()
        else:
            return None
        end = v.skip_blank(end)
        if end < v.n and v.raw[end] == OPENERS[c]:
            return v.skip_blank(end + 1), before
        return None
    if before and (m := (_WORD_DOT.match(v.skeleton, j) or _RAW_DOT.match(v.raw, j))):
        k = v.skip_blank(m.end())
        return (k, True) if k > m.end() else None
    return None


def _read_label(v: _View, i: int, explicit: bool) -> tuple[int, str] | None:
    """(end, folded text) of a host label: letters, digits, inner hyphens, zero-width marks inside."""
    j, out, last = i, [], i
    while j < v.n:
        c = v.raw[j]
        if v.word(j) or unicodedata.category(c) == "Mn" and out:
            out.append(c)
            j += 1
            last = j
        elif c == Z and out and j + 1 < v.n:
            k = v.skip_zero(j)
            if k < v.n and (v.word(k) or v.raw[k] == "-"):
                j = k
            else:
                break
        elif c == "-" and out and j + 1 < v.n:
            k = j
            while k < v.n and v.raw[k] == "-":
                k += 1
            if not v.word(k):
                break
            out.append(v.raw[j:k])
            j = k
        elif explicit and (c == "_" or ord(c) > 0x2000 and unicodedata.category(c) in ("So", "Sk", "Cf", "Mn")):
            out.append(c)
            j += 1
            last = j
        else:
            break
    text = "".join(out)
    return (last, text) if text and len(text) <= 63 else None


def _split_label(v: _View, i: int) -> tuple[int, str] | None:
    """``_read_pieces``, once a place."""
    if i not in v.pieces:
        v.pieces[i] = _read_pieces(v, i)
    return v.pieces[i]


def _read_pieces(v: _View, i: int) -> tuple[int, str] | None:
    """Letters set apart by single blanks: 'e x a m p l e'."""
    out, j, end = [], i, i
    while v.word(j) and not v.word(j + 1):
        out.append(v.raw[j])
        end = j + 1
        k = v.skip_blank(end)
        if k == end or not v.word(k):
            break
        j = k
    return (end, "".join(out)) if len(out) > 1 else None


def _known(label: str, cfg: UrlConfig) -> bool:
    return label in cfg._tlds or label.translate(LOOKALIKES) in cfg._skeletons or label.startswith("xn--") and len(label) > 4


def _host(v: _View, i: int, cfg: UrlConfig, explicit: bool) -> _Host | None:
    """Labels and dots from ``i``. Without a scheme the last label must be a known top-level domain: the longest such
    prefix counts. A top-level domain ends before a hyphen or letters glued to it."""
    if explicit and i < v.n and v.raw[i] == "[":
        close = v.raw.find("]", i)
        if close < 0:
            return None
        inner = v.raw[i + 1 : close].replace(Z, "")
        try:
            ipaddress.IPv6Address(inner)
        except ValueError:
            return None
        return _Host(close + 1, [inner])
    labels, best, spaced, at, used = [], None, False, i, 0
    zeros, known = Z in v.raw, v.known

    def is_known(label: str) -> bool:
        if label not in known:
            known[label] = _known(label, cfg)
        return known[label]

    while len(labels) < 127:
        got = (_split_label(v, at) if explicit or labels and spaced else None) or _label(v, at, explicit)
        if not got:
            break
        end, text = got
        tld_end, tld = end, text
        if labels:
            if not explicit or spaced:
                head = text.split("-")[0]
                if not is_known(text) and is_known(head) and "-" in text:  # example.com-like
                    tld, tld_end = head, at + len(head)
                zero = v.raw.find(Z, at, end) if zeros else -1
                if not is_known(tld) and zero > 0 and is_known(v.raw[at:zero]):  # example.com<zero width>next
                    tld, tld_end = v.raw[at:zero], zero
            if is_known(tld):
                best = _Host(tld_end, [*labels, tld], spaced)
            elif explicit and not spaced:
                best = _Host(end, [*labels, text], spaced)
            if tld_end != end:
                break
        elif explicit:
            best = _Host(end, [text], spaced)
        labels.append(text)
        used += len(text) + 1
        if used > 254:
            break
        dot = _dot(v, end, explicit)
        if not dot:
            break
        if best and dot[1] and not spaced and best.end == end:
            nxt = (_split_label(v, dot[0]) if explicit else None) or _label(v, dot[0], explicit)
            if not nxt or not is_known(nxt[1]):
                break
        at, spaced = dot[0], spaced or dot[1]
    return best


def _port_end(v: _View, i: int) -> int | None:
    j = v.skip_zero(i + 1)
    if j >= v.n or not v.raw[j].isdigit():
        return None
    while j < v.n and (v.raw[j].isdigit() or v.raw[j] == Z and v.skip_zero(j) < v.n and v.raw[v.skip_zero(j)].isdigit()):
        j += 1
    if v.word(v.skip_zero(j)) or j < v.n and v.raw[j] in "-_":
        return None
    return j


def _tail(v: _View, i: int) -> int:
    """End of port, path, query and fragment from ``i``, without closing punctuation and prose glued behind commas."""
    j = i
    k = j + 1 if j < v.n and v.raw[j] == "." and j + 1 < v.n and v.raw[j + 1] in "/:" else j
    if k < v.n and v.raw[k] == ":":
        port = _port_end(v, k)
        if port is not None:
            j = port
        elif k + 1 < v.n and v.raw[k + 1] in "/?#":
            j = k + 1
        else:
            return i
    elif k < v.n and v.raw[k] == "/":
        j = k
    if j >= v.n or v.raw[j] not in "/?#":
        return j
    if v.raw[j] in "?#" and not (j + 1 < v.n and not v.space(j + 1) and v.raw[j + 1] != Z and v.raw[j + 1] not in TRAILING):
        return j
    k, query = j, False
    while k < v.n and not v.space(k):
        if v.raw[k] in "?#":
            query = True
        if v.raw[k] in ",!" and not query:
            break
        k += 1
    return _trim(v, j, k)


def _trim(v: _View, start: int, end: int) -> int:
    """Drop closing punctuation and zero-width marks at the end, but keep a bracket that closes one of the link's own."""
    while end > start:
        c = v.raw[end - 1]
        if c == Z:
            end -= 1
        elif c in TRAILING:
            if c in CLOSERS and v.raw.count(CLOSERS[c], start, end) >= v.raw.count(c, start, end):
                break
            end -= 1
        else:
            break
    return end


def _explicit(v: _View, m: regex.Match, cfg: UrlConfig) -> tuple[int, list[str]] | None:
    at = v.skip_blank(m.end())
    gap = any(v.space(k) for k in range(m.end(), at))
    # user information up to '@' inside the authority
    stop = at
    while stop < v.n and not v.space(stop) and v.raw[stop] not in "/?#\\":
        stop += 1
    mark = v.raw.rfind("@", at, stop)
    host = _host(v, mark + 1 if mark >= 0 else at, cfg, True)
    if not host or gap and len(host.labels) < 2:
        return None
    if gap and not host.spaced and not _known(host.labels[-1], cfg):
        return None
    end = host.end if host.spaced and v.space(min(host.end, v.n - 1)) else _tail(v, host.end)
    return end, host.labels


#: Where a host's dot can stand: glued to what follows, in brackets, between blanks, or as a word.
_DOT_PLACE = regex.compile(rf"\.{Z}*(?=[\p{{L}}\p{{N}}])|[\s{Z}]\.[\s{Z}]|[\[({{<][\s{Z}]*(?:\.|d[\s{Z}]*[o0]|т)|[\s{Z}](?:d[\s{Z}]*[o0][\s{Z}]*t|т[\s{Z}]*о[\s{Z}]*ч)")
#: Characters before its dot in which a host's first label must begin.
_REACH = 160


def _dot_places(v: _View) -> list[int]:
    if any(c in "·•⋅・" for c in v.text):
        return list(range(v.n))
    both = {m.start() for m in _DOT_PLACE.finditer(v.raw)}
    if v.skeleton is not v.raw:
        both |= {m.start() for m in _DOT_PLACE.finditer(v.skeleton)}
    return sorted(both)


def matches(text: str, cfg: UrlConfig) -> Iterator[Range]:
    """Code-point ranges of links in order; they do not overlap."""
    if not text:
        return
    v = _View(text)
    schemes = {m.start(): m for m in _SCHEME.finditer(v.skeleton)}
    dots, starts = _dot_places(v), sorted(schemes)
    i = d = k = 0
    while i < v.n:
        while d < len(dots) and dots[d] < i:
            d += 1
        while k < len(starts) and starts[k] < i:
            k += 1
        ahead = min(dots[d] - _REACH if d < len(dots) else v.n, starts[k] if k < len(starts) else v.n)
        if ahead > i:  # nothing can begin before
            i = ahead
            continue
        if i in schemes:
            got = _explicit(v, schemes[i], cfg)
            if got:
                end, labels = got
                if ".".join(labels) not in cfg._allowed:
                    yield i, end
                i = max(end, i + 1)
                continue
            i = schemes[i].end()
            continue
        if not v.word(i) or i and (v.word(i - 1) or v.raw[i - 1] in "-_"):
            i += 1
            continue
        run = i
        while v.word(run):
            run += 1
        host = _host(v, i, cfg, False)
        if host:
            end = _tail(v, host.end)
            if not (i and v.raw[i - 1] == "@") and ".".join(host.labels) not in cfg._allowed:
                yield i, end
            i = max(end, run)
            continue
        joined = _joined(v, i, run, cfg)
        if joined:
            end, labels = joined
            if ".".join(labels) not in cfg._allowed:
                yield i, end
            i = end
            continue
        # labels already tried from here cannot start a link: skip the dotted run they form
        i = run
        while i < v.n and v.raw[i] == "." and i + 1 < v.n and v.word(i + 1):
            j = i + 1
            while v.word(j):
                j += 1
            if _known(v.raw[i + 1 : j], cfg):
                break
            i = j


#: Words before a domain that are prose rather than its first, split-off piece.
_PROSE = frozenset("a an the and or to go see at on in is it of for from visit please check open now not by with this that my our your use try via и в на по из за от".split())


def _joined(v: _View, i: int, run: int, cfg: UrlConfig) -> tuple[int, list[str]] | None:
    """A host whose first label is split by one blank: 'exa mple.com'. Pieces are short and the first is no prose word."""
    first = v.raw[i:run]
    if run - i > 3 or first in _PROSE or not v.raw[run : run + 1].isspace():
        return None
    at = v.skip_blank(run)
    if not v.word(at):
        return None
    second = _label(v, at, False)
    if not second or len(second[1]) > 6:
        return None
    host = _host(v, at, cfg, False)
    if not host:
        return None
    labels = [first + host.labels[0], *host.labels[1:]]
    return _tail(v, host.end), labels


def scan(text: str, cfg: UrlConfig = UrlConfig()) -> list[Range]:
    return merge(matches(text, cfg))


def check(text: str, cfg: UrlConfig = UrlConfig()) -> bool:
    return next(matches(text, cfg), None) is not None
