"""Profanity matcher: rule dictionaries, strict tokens, loosened patterns, literals, taxonomy, composition. No Spark here.

Matches are in UTF-16 units of the original text. A *strict* match is a whole token that a rule's pattern describes; a
token gives its first rule in order. A *loose* match lets separators and repeated letters stand inside a pattern; every
rule gives its own. Rules are ordered by the length of their source, longest first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate

import regex

from .text import ZEROS, censor, merge, u16_to_cp, u16_width

SEVERITIES = ("soft", "low", "medium", "high")
CATEGORIES = ("OBSCENE_MAT", "STRONG_INSULT", "VULGAR", "EUPHEMISM", "TRANSLIT")
STRATEGIES = ("default", "latin-preserving")
#: Latin letters read as Cyrillic ones (fixed values).
LATIN_TO_CYRILLIC = str.maketrans("aeopcyxkmhtb", "аеорсухкмнть")
_GONE = "￿"
_TOKEN = regex.compile(r"[\p{L}\p{N}_-][\p{L}\p{N}\p{M}_\-￿]*")
_WORD = regex.compile(r"[\p{L}\p{N}]")
_TAIL = regex.compile(r"-\p{L}+")
_ASTRAL = regex.compile(r"[\U00010000-\U0010FFFF]")
#: What may stand between the letters of a loose rule: any number of marks, or a few with digits among them.
_BETWEEN = r"(?:[^\p{L}\p{N}]*|[^\p{L}\p{N}]{0,3}\p{N}[^\p{L}]{0,3})"


@dataclass(frozen=True)
class Loose:
    stretch: bool = False
    hyphen_tail: bool = False
    hyphen_tail_min: int = 1


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    source: str
    strict: bool = True
    loose: Loose | None = None


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    mode: str
    rule_id: str | None = None
    category: str | None = None
    severity: str | None = None
    profile_id: str | None = None
    language_tag: str | None = None


@dataclass(frozen=True)
class Options:
    """None means no restriction; an empty tuple matches nothing."""

    categories: tuple[str, ...] | None = None
    severities: tuple[str, ...] | None = None
    min_severity: str | None = None

    @property
    def any(self) -> bool:
        return self.categories is not None or self.severities is not None or self.min_severity is not None

    def accepts(self, m: Match) -> bool:
        if not self.any:
            return True
        if m.category is None or m.severity is None:
            return False
        return (self.categories is None or m.category in self.categories) and (self.severities is None or m.severity in self.severities) and (self.min_severity is None or SEVERITIES.index(m.severity) >= SEVERITIES.index(self.min_severity))

    def narrowed(self, other: Options) -> Options:
        """Both at once: sets intersect, the stronger minimum holds."""
        both = lambda a, b: b if a is None else a if b is None else tuple(x for x in a if x in b)
        least = max((s for s in (self.min_severity, other.min_severity) if s), key=SEVERITIES.index, default=None)
        return Options(both(self.categories, other.categories), both(self.severities, other.severities), least)


class _Folds(dict):
    """Code point -> its folded character, worked out when first met."""

    def __init__(self, cyrillic: bool):
        super().__init__()
        self.cyrillic = cyrillic

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if c in ZEROS:
            out = _GONE
        else:
            c = chr(point - 0xFEE0) if 0xFF01 <= point <= 0xFF5E else c
            low = c.lower()
            out = (low if len(low) == 1 else c).replace("ё", "е")
            out = out.translate(LATIN_TO_CYRILLIC) if self.cyrillic else out
        self[point] = out
        return out


_FOLDS = {"default": _Folds(True), "latin-preserving": _Folds(False)}


def fold(text: str, strategy: str = "default") -> str:
    """Same length: lower case, full-width ASCII to ASCII, yo to ye, zero-width marks to one mark, look-alikes to Cyrillic."""
    if strategy == "latin-preserving" and text.isascii():
        return text.lower()
    return text.translate(_FOLDS[strategy])


_ATOM = regex.compile(r"\[\^?\]?[^\]]*\]|\\p\{[^}]*\}|\\.|\(\?[:=!<][=!]?|\(|\)|\||[?*+]\??|\{\d+(?:,\d*)?\}\??|.", regex.DOTALL)


def loosened(source: str, stretch: bool) -> str:
    """The pattern with separators allowed between its letters, and repeats of them if ``stretch``."""
    atoms, out, plain = _ATOM.findall(source), [], []
    stretched = False
    first, opened = True, [True]  # whether a match can begin here; the same at the start of each open group
    for i, a in enumerate(atoms):
        if a.startswith("("):
            plain.append(a == "(?:")
            opened.append(first)
            out.append(a)
        elif a == ")":
            plain and plain.pop()
            len(opened) > 1 and opened.pop()
            first = False
            out.append(a)
        elif a == "|":
            first = opened[-1]
            out.append(a)
        elif a[0] in "?*+{":
            if a != "+" or not stretched:
                out.append(a)
            stretched = False
        elif all(plain):
            quantifier = atoms[i + 1] if i + 1 < len(atoms) and atoms[i + 1][0] in "?*+{" else ""
            stretched = stretch and quantifier in ("", "+")
            letter = f"{a}(?:{_BETWEEN}{a})*" if stretched else a
            out.append(letter if first else f"(?:{_BETWEEN}{letter})")
            first = False
        else:
            out.append(a)
    return "".join(out)


#: Where a match may begin and end: at no letter or digit, seen through combining and zero-width marks.
_BEGIN, _END_OF = rf"(?<![\p{{L}}\p{{N}}][\p{{Mn}}{_GONE}]*)", rf"(?![\p{{Mn}}{_GONE}]*[\p{{L}}\p{{N}}])"
#: Pieces of one or two letters or digits with white space (and marks) between them, in which a spread word can stand.
_SPREAD = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{L}\p{N}](?:[^\p{L}\p{N}\s]*+[\p{L}\p{N}])?[^\p{L}\p{N}\s]*+\s[^\p{L}\p{N}]*+)+[\p{L}\p{N}](?:[^\p{L}\p{N}\s]*+[\p{L}\p{N}])?(?![\p{L}\p{N}])[^\p{L}\p{N}\s]*+")
#: Chunks and spread pieces longer than this are not remembered; so many others are.
_SHORT, _REMEMBERED = 64, 200_000
MODES = ("strict", "loose")

#: Two views in which the letters of a loosened match stand together: with the digits that stand for letters, and without.
_STRIPPED = (regex.compile(r"[^\p{L}@\n]+"), regex.compile(r"[^\p{L}@0369\n]+"))
_DOUBLED = regex.compile(r"([\p{L}@])\1+")
_DIGITS, _MARKS = regex.compile("[0369]"), regex.compile(rf"[\p{{M}}{_GONE}]+")


def _views(s: str) -> Iterator[str]:
    """The squeezed views of lines: letters only, then with the digits if there are any."""
    yield _DOUBLED.sub(r"\1", _STRIPPED[0].sub("", s))
    if _DIGITS.search(s):
        yield _DOUBLED.sub(r"\1", _STRIPPED[1].sub("", s))


def _squeezed(source: str) -> str:
    """A pattern without doubled letters, for the squeezed views."""
    return regex.sub(r"(\p{L})\1", r"\1", source)


def _either(patterns: list[str]) -> regex.Pattern | None:
    return _compiled("|".join(f"(?:{p})" for p in patterns)) if patterns else None


def literal_pattern(term: str, loose: bool, strategy: str) -> str:
    letters = [regex.escape(c) for c in fold(term, strategy)]
    return r"[^\p{L}\p{N}]*".join(letters) if loose else "".join(letters)


def _compiled(pattern: str) -> regex.Pattern | None:
    try:
        return regex.compile(pattern, regex.IGNORECASE)
    except regex.error:
        return None  # a pattern that does not compile is left out, as documented


def terms(values: Iterable[object] | None) -> list[str]:
    """Trimmed, without empty and repeated ones."""
    return list(dict.fromkeys(t for t in (str(v).strip() for v in values or () if v is not None) if t))


@dataclass(frozen=True)
class Dictionary:
    language: str
    rules: tuple[Rule, ...]
    normalization: str = "default"


@dataclass(frozen=True)
class ProfanityFilter:
    """Immutable: ``with_strict`` and ``with_loose`` give new filters with runtime literals added."""

    dictionary: Dictionary | None = None
    strict_terms: tuple[str, ...] = ()
    loose_terms: tuple[str, ...] = ()
    exclude: object = None
    _parts: tuple = field(init=False, repr=False, compare=False, default=())
    _any: tuple = field(init=False, repr=False, compare=False, default=())

    def __post_init__(self):
        d, strategy = self.dictionary, self.strategy
        rules = sorted(d.rules if d else (), key=lambda r: -len(r.source))
        strict = [(p, r) for r in rules if r.strict and (p := _compiled(f"(?:{fold_pattern(r.source)})"))]
        # longest match: between spread letters every ending, the empty one too, would do
        loose = [(p, r) for r in rules if r.loose and (p := _compiled(f"(?p){_BEGIN}(?:{loosened(fold_pattern(r.source), r.loose.stretch)}){_END_OF}"))]
        known = [t for t in terms(self.strict_terms)]
        words = {fold(t, strategy): t for t in known if _TOKEN.fullmatch(fold(t, strategy))}
        phrases = [p for t in known if fold(t, strategy) not in words and (p := _compiled(literal_pattern(t, False, strategy)))]
        free = [p for t in terms(self.loose_terms) if (p := _compiled(literal_pattern(t, True, strategy)))]
        object.__setattr__(self, "_parts", (strict, loose, words, phrases, free))
        # one alternation of all sources, to skip texts and tokens that no rule can match
        plain = [_squeezed(fold_pattern(r.source)) for r in rules if r.loose] + [_squeezed(literal_pattern(t, False, strategy)) for t in terms(self.loose_terms)]
        literal = regex.compile(r"\L<words>", words=list(words)) if words else None
        object.__setattr__(self, "_any", (_either([p.pattern for p, _ in strict]), _either(plain), {}, {}, literal))

    @property
    def strategy(self) -> str:
        return self.dictionary.normalization if self.dictionary else "default"

    def with_strict(self, *values: object) -> ProfanityFilter:
        return replace(self, strict_terms=tuple(terms([*self.strict_terms, *values])))

    def with_loose(self, *values: object) -> ProfanityFilter:
        return replace(self, loose_terms=tuple(terms([*self.loose_terms, *values])))

    def replace_strict(self, *values: object) -> ProfanityFilter:
        return replace(self, strict_terms=tuple(terms(values)))

    def replace_loose(self, *values: object) -> ProfanityFilter:
        return replace(self, loose_terms=tuple(terms(values)))

    def without_strict(self, *values: object) -> ProfanityFilter:
        return replace(self, strict_terms=tuple(t for t in self.strict_terms if t not in terms(values)))

    def without_loose(self, *values: object) -> ProfanityFilter:
        return replace(self, loose_terms=tuple(t for t in self.loose_terms if t not in terms(values)))

    def _token(self, token: str) -> tuple[tuple[int, int, Rule | None], ...] | None:
        """Matches inside a token, None if there are none; remembered for up to 200,000 tokens."""
        memo = self._any[2]
        if token in memo:
            return memo[token]
        if len(memo) >= 200_000:
            memo.clear()
        rules, _, words, _, _ = self._parts
        anything = self._any[0]

        def first(t: str) -> Rule | None:
            return next((r for p, r in rules if p.fullmatch(t)), None) if t and anything and anything.fullmatch(t) else None

        clean = token if token.isascii() else _MARKS.sub("", token)
        hit = first(clean) or first(clean.strip("-_"))
        out: list[tuple[int, int, Rule | None]] = [(0, len(token), None)] if clean in words else []
        if hit:
            out.insert(0, (0, len(token), hit))
        if not out and "-" in token:  # two words joined, or the same kind throughout; three pieces are more likely syllables
            at, parts = 0, token.split("-")
            for part in parts:
                hit = first(_MARKS.sub("", part))
                if hit:
                    out.append((at, at + len(part), hit))
                at += len(part) + 1
            if len(parts) > 2 and len(out) < len(parts):
                out = []
        memo[token] = tuple(out) or None
        return memo[token]

    def _chunk(self, chunk: str, spread: bool) -> tuple[tuple, tuple]:
        """Strict and loose matches (place, end, rule number, rule) inside a chunk without white space, or the loose ones that
        reach over the white space of a spread stretch; remembered if it is short."""
        memo = self._any[3]
        if (key := (chunk, spread)) in memo:
            return memo[key]
        strict: list[tuple] = []
        loose: list[tuple] = []
        if not spread:
            for m in _TOKEN.finditer(chunk):
                strict += [(m.start() + a, m.start() + b, 0, r) for a, b, r in self._token(m.group()) or ()]
        anything, (_, rules, _, _, free) = self._any[1], self._parts
        if anything and any(map(anything.search, _views(chunk.replace("\n", " ")))):
            for number, (p, r) in enumerate([*rules, *((p, None) for p in free)]):
                for m in p.finditer(chunk):
                    a, b = m.span()
                    if r and r.loose.hyphen_tail and chunk[b : b + 1] == "-":
                        tail = _TAIL.match(chunk, b)
                        b += len(tail.group()) if tail and len(tail.group()) > r.loose.hyphen_tail_min else 0
                    if b > a and _clear(chunk, a, b) and (len(chunk[a:b].split()) > 1) == spread and _one_word(chunk[a:b]):
                        loose.append((a, b, number, r))
        found = (tuple(strict), tuple(loose))
        if len(chunk) <= _SHORT:
            if len(memo) >= _REMEMBERED:
                memo.clear()
            memo[key] = found
        return found

    def _clean(self, lines: str) -> bool:
        """Whether chunks, one a line, hold nothing that a rule or literal could match; one look at all of them together."""
        strict, loose, _, _, literal = self._any
        plain = lines if lines.isascii() else _MARKS.sub("", lines)
        return not (strict and strict.search(plain) or literal and literal.search(plain) or loose and any(map(loose.search, _views(lines))))

    def _found(self, s: str, modes: tuple[str, ...]) -> Iterator[tuple[str, int, int, Rule | None]]:
        """(mode, place, end, rule) in a folded text: a match stands in one chunk or in a spread stretch, so each different one
        is looked at once, and texts whose chunks all are known to be clean cost no more than the split."""
        chunks = s.split()
        memo = self._any[3]
        fresh = [c for c in set(chunks) if (c, False) not in memo]
        if fresh and self._clean("\n".join(fresh)):
            if len(memo) + len(fresh) > _REMEMBERED:
                memo.clear()
            memo.update(((c, False), ((), ())) for c in fresh if len(c) <= _SHORT)
            hits = {c for c in set(chunks).difference(fresh) if any(self._chunk(c, False))}
        else:
            hits = {c for c in set(chunks) if any(self._chunk(c, False))}
        strict: list[tuple] = []
        loose: list[tuple] = []
        at = 0
        for c in chunks if hits else ():
            at = s.index(c, at)
            if c in hits:
                one, other = self._chunk(c, False)
                strict += [(at + a, at + b, n, r) for a, b, n, r in one]
                loose += [(at + a, at + b, n, r) for a, b, n, r in other]
            at += len(c)
        if "strict" in modes:
            yield from (("strict", a, b, r) for a, b, _, r in strict)
            for p in self._parts[3]:
                yield from (("strict", *m.span(), None) for m in p.finditer(s) if _clear(s, *m.span()))
        if "loose" in modes and self._any[1]:
            for m in _SPREAD.finditer(s):
                loose += [(m.start() + a, m.start() + b, n, r) for a, b, n, r in self._chunk(m.group(), True)[1]]
            yield from (("loose", a, b, r) for a, b, _, r in sorted(loose, key=lambda x: (x[2], x[0])))

    def matches(self, text: str, options: Options = Options(), modes: tuple[str, ...] = MODES) -> Iterator[Match]:
        """Strict matches, then loose ones."""
        if not text:
            return
        places = None
        for mode, a, b, r in self._found(fold(text, self.strategy), modes):
            if places is None:
                places = range(len(text) + 1) if not _ASTRAL.search(text) else [0, *accumulate(map(u16_width, text))]
            m = Match(places[a], places[b], mode, *((r.id, r.category, r.severity) if r else ()))
            if options.accepts(m) and not (r and self.exclude and self.exclude(text, a, b)):
                yield m

    def analyze(self, text: str, options: Options = Options(), modes: tuple[str, ...] = MODES) -> list[Match]:
        return list(self.matches(text, options, modes))

    def check(self, text: str, options: Options = Options()) -> bool:
        return next(self.matches(text, options), None) is not None

    def ranges(self, text: str, options: Options = Options()) -> list[tuple[int, int]]:
        """Merged code-point ranges."""
        return merge(u16_to_cp(text, [(m.start, m.end) for m in self.matches(text, options)]))

    def censor(self, text: str, options: Options = Options()) -> str:
        return censor(text, self.ranges(text, options))


def fold_pattern(source: str) -> str:
    """A rule's source in the folded alphabet, where yo is ye."""
    return source.replace("ё", "е")


def _clear(s: str, a: int, b: int) -> bool:
    """Word boundaries on both sides, seen through combining and zero-width marks."""
    while a > 0 and (s[a - 1] == _GONE or unicodedata.category(s[a - 1]) == "Mn"):
        a -= 1
    while b < len(s) and (s[b] == _GONE or unicodedata.category(s[b]) == "Mn"):
        b += 1
    return not (a > 0 and _WORD.match(s[a - 1])) and not (b < len(s) and _WORD.match(s[b]))


def _one_word(part: str) -> bool:
    """Spread letters or one word; never pieces of two words: with blanks inside, pieces hold at most two letters."""
    pieces = [p for p in part.split() if _WORD.search(p)]
    return len(pieces) <= 1 or all(len(_WORD.findall(p)) <= 2 for p in pieces)


# --- English ---------------------------------------------------------------

#: English rules by what users see of them (fixed values: id, category, severity), with the words that each covers, as stems and
#: their endings, and whether spread and stretched spellings count.
ENGLISH_WORDS = {
    "en.insult.asshole": ("STRONG_INSULT", "high", {"asshole": "s"}, False),
    "en.insult.bastard": ("STRONG_INSULT", "medium", {"bastard": ""}, False),
    "en.insult.bitch": ("STRONG_INSULT", "medium", {"bitch": "", "bich": ""}, True),
    "en.insult.fag": ("STRONG_INSULT", "high", {"fag": ""}, True),
    "en.insult.faggot": ("STRONG_INSULT", "high", {"faggot": "s"}, True),
    "en.insult.motherfucker": ("STRONG_INSULT", "high", {"motherfucker": ""}, False),
    "en.insult.nigga": ("STRONG_INSULT", "high", {"nigga": ""}, True),
    "en.insult.whore": ("STRONG_INSULT", "high", {"whore": ""}, True),
    "en.obscene.fuck.family": ("OBSCENE_MAT", "high", {"fuck": "ed en ing", "fack": "", "fick": ""}, True),
    "en.obscene.shit": ("OBSCENE_MAT", "high", {"shit": ""}, True),
    "en.vulgar.cock": ("VULGAR", "medium", {"cock": ""}, False),
    "en.vulgar.dick": ("VULGAR", "medium", {"dick": "head heads"}, False),
    "en.vulgar.suck": ("VULGAR", "medium", {"suck": "ed ing"}, True),
}
#: Greek letters that stand for Latin ones (fixed values).
_GREEK = {"a": "α", "i": "ι", "u": "υ"}


def word_pattern(words: dict[str, str]) -> str:
    """A pattern of stems with their endings, each letter also as its look-alike."""
    spelt = lambda w: "".join(f"[{c}{_GREEK[c]}]" if c in _GREEK else c for c in w)
    endings = lambda e: f"(?:{'|'.join(map(spelt, e.split()))})?" if e else ""
    return "|".join(spelt(stem) + endings(e) for stem, e in words.items())


ENGLISH = Dictionary("en", tuple(Rule(i, category, severity, word_pattern(words), True, Loose() if loose else None) for i, (category, severity, words, loose) in ENGLISH_WORDS.items()), "latin-preserving")

_LINKISH = regex.compile(r"(?<![\p{L}\p{N}])(?:[a-z][a-z0-9+.-]*://\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?:[\w-]+\.)+[a-z]{2,}(?:/\S*)?|/[\w./-]+)", regex.IGNORECASE)
_MENTION = regex.compile(r"(?<![\p{L}\p{N}@])@[\w-]+")


def english_context(text: str, a: int, b: int) -> bool:
    """Standalone mentions, hosts, addresses and paths are names, not speech."""
    near = range(max(0, a - 100), min(len(text), b + 100))
    window, base = text[near.start : near.stop], near.start
    return any(m.start() + base <= a and b <= m.end() + base for p in (_LINKISH, _MENTION) for m in p.finditer(window))


def english_filter(strict: Iterable[object] = (), loose: Iterable[object] = ()) -> ProfanityFilter:
    return ProfanityFilter(ENGLISH, tuple(terms(strict)), tuple(terms(loose)), english_context)


# --- Russian: an own table by stem family ----------------------------------

_B, _YA, _A, _O, _Z, _E, _U, _I = "[б6]", "[я9]", "[а@]", "[о0]", "[з3]", "[еэ]", "[уy]", "[иu]"
_PRE = "(?:по|за|вы|на|от|до|у|об|обо|об[ьъ]|про|при|раз|раз[ьъ]|рас|под|под[ьъ]|пере|недо|с|с[ьъ]|из|из[ьъ]|ото|вз|в[ьъ]|вз[ьъ])"
_END = "[а-я]*"
#: family, name, category, severity, pattern, strict, loose, stretch
_RU = [
    ("blya", "base", "OBSCENE_MAT", "medium", f"{_B}л(?:{_YA}+|[е]а|{_A}(?=[дт]))(?:[дт][ьъ]|тb|tь|tb|ди(?:на|н[аы])?|дск[а-я]+|дств[а-я]+)?", True, True, True),
    ("blya", "translit", "TRANSLIT", "medium", "[bв6ь]l(?:ya|ja|ea)(?:[dt])?", True, True, False),
    ("blya", "compound", "OBSCENE_MAT", "medium", f"вы{_B}л{_YA}д(?:ок|ка|ки|ков|ку|ком)", True, True, False),
    ("eb", "verb", "OBSCENE_MAT", "high", f"{_PRE}?[ьъ]?[еe]{_B}(?:{_A}(?:л|ла|ли|ло|ть|ться|лся|лась|шь|н|на|ны|нный|нная|нное|нные|нутый|нутая|нутые|нат|нько|ный|ная|ное|ные|ного|ному|ной|ную|ных|ними|нут|шит|ш|рь|ри)?|ут|уч(?:ий|ая|ее|ие)|ет|ешь|ись|ись|и|ло|ла|лан|ланы|лище|ну(?:л|ла|ли|ть|лся|лась|тый|тая|тые|вшийся)|ыва[а-я]+|ошить|ашить|учка)", True, True, True),
    ("eb", "forms", "OBSCENE_MAT", "high", f"[её]{_B}(?:у|ём|ем|ёт|ут|ешь|ёшь|ите|ля|ли|лей|лю|лись|ись|учк[а-я]+|ливый|анько)", True, True, False),
    ("eb", "short", "OBSCENE_MAT", "high", "[её]б", True, False, False),
    ("eb", "noun", "STRONG_INSULT", "high", f"(?:долбо|далба|долба|мозго|ш[еи]шко|дурако|козло)[ьъ]?[её]?{_B}(?:{_A}?(?:|ы|ов|ам|ами|е|у|ом|а))", True, True, False),
    ("eb", "prefix", "OBSCENE_MAT", "high", f"(?:за|вы|на|до|у|про|при|раз[ьъ]?|об[ьъ]?|под[ьъ]|с[ьъ]|от[ьъ]|из[ьъ]?)[ьъ]?[е]{_B}(?:{_A}[а-я]*|ись|ок|енн?[а-я]*|ыш[а-я]*|ываться|ывать|ывает|у|ем|ете)?", True, True, False),
    ("eb", "translit", "TRANSLIT", "high", "(?:za|vy|na|do|u|pro|ob|raz|pod|ot)?(?:yo|e|ye|j[eo])b(?:al|ala|ali|at|an|anat|anyi|aniy|anyy|anut[a-z]*|at'|lo|uchii)", True, True, False),
    ("huy", "base", "OBSCENE_MAT", "high", f"(?:на|по|ни|не|до|от|о|а|при|за)?[хx]{_U}[йяеюи](?:|м|в|ми|ях|ев|ем|ло|ла|лом|ли|лу|ня|ни|ней|ню|нёй|сос[а-я]*|та|ты|ту|той|к|вый|вая|вое|вые|вого|вину|вина|вин[а-я]*|нул[а-я]*|ть|рить|рил[а-я]*|шечк[а-я]*|шк[а-я]*|плет[а-я]*|лов?|лы|чить|ачить|ач[а-я]*)", True, True, True),
    ("huy", "forms", "OBSCENE_MAT", "high", f"о?х{_U}(?:ительн[а-я]+|етен[ьи]|етени|ёв[а-я]+|ев[а-я]+|ищ[еа]|ишк[аоу])", True, True, False),
    ("huy", "pri", "OBSCENE_MAT", "high", f"(?:при|о|а|за|на|от|до|под|пере|рас|вы|у)х{_U}[еяю](?:л|ла|ли|ло|ть|вать|вает|вш[а-я]+|вал[а-я]*|рить|рил[а-я]*|чить|чил[а-я]*|нно|нный|нная|ваю|ваем|ем|ешь|ю|ют|вающ[а-я]+)", True, True, True),
    ("huy", "double", "OBSCENE_MAT", "high", f"х{_U}як(?:-?х{_U}як)?", True, True, False),
    ("huy", "translit", "TRANSLIT", "high", "(?:na|po|ni|ne|do|ot|o)?(?:x|h|kh)[uy](?:y|i|j|e|ya|ja|yu|ia)(?:|nya|nia|evo|vo|lo|ta|sos|m|v|yo|li)", True, True, False),
    ("pizda", "base", "OBSCENE_MAT", "high", f"(?:рас|за|на|от|по|про|с|у|до|вы|ис|под|при|пере|недо|о)?п{_I}{_Z}д[аеуыоиюяёь](?:[а-я]{{0,12}})?", True, True, True),
    ("pizda", "short", "OBSCENE_MAT", "high", f"п{_I}{_Z}д(?:ц|ec|ецкий)?", True, True, True),
    ("pizda", "translit", "TRANSLIT", "high", "(?:s|na|ot|za|po|ras|v)?pizd(?:a|e|u|y|ec|ets|ez|etc|abol|uk|at|yulya|atyi|yk|it|ato)[a-z]*", True, True, False),
    ("pidor", "base", "STRONG_INSULT", "high", f"п[иеi][дd][{_O[1:-1]}аеиюя]р(?:|а|ы|ас|асы|аса|асов|асина|ок|ка|ки|ков|у|ом|ов|ам|ский|ская|ский|юга|юги|аст|аста|асты|астов|растия)", True, True, True),
    ("pidor", "translit", "TRANSLIT", "high", "pid[oa]r(?:|y|as|asy|i|ok|ka|a|ast|asti)", True, True, False),
    ("mud", "base", "STRONG_INSULT", "medium", f"м{_U}д(?:ак|ака|аки|аков|акам|аку|ачье|ила|илы|ило|ень|озвон[а-я]*|ачин[а-я]*|ацкий|ня|ни)", True, True, True),
    ("mud", "translit", "TRANSLIT", "medium", "muda(?:k|ki|ka|kov|chyo|china)", True, True, False),
    ("suka", "base", "STRONG_INSULT", "medium", f"с+{_U}+к+(?:{_A}+|и|у|е|ой|ам|ами|ах|ин[а-я]{{0,3}})", True, True, True),
    ("suka", "compound", "STRONG_INSULT", "medium", f"с{_U}ч(?:ка|ки|ку|кой|ара|ары|ий|ья|ье|ьи|онок|ок)", True, True, False),
    ("suka", "translit", "TRANSLIT", "medium", "s[u]+k+(?:a+|i|u)", True, True, False),
    ("shlyuha", "base", "STRONG_INSULT", "high", "шл[юу](?:ха|хи|хе|ху|хой|х|шка|шки|шку|хан[а-я]*)", True, True, True),
    ("shlyuha", "whore", "STRONG_INSULT", "high", "(?:по)?тас?ку(?:ха|хи|ху|хой)|прошмандовк[а-я]+", True, True, False),
    ("shlyuha", "translit", "TRANSLIT", "high", "shl(?:yu|u|iu|ju)(?:ha|kha|hi|xa|shka)", True, True, False),
    ("zalupa", "base", "OBSCENE_MAT", "high", f"{_Z}{_A}луп(?:а|ы|е|у|ой|ам|ин[а-я]*|ный|ыш)", True, True, True),
    ("zalupa", "translit", "TRANSLIT", "high", "zalup(?:a|y|u|oi|e)", True, True, False),
    ("gandon", "base", "STRONG_INSULT", "high", "г[ао]нд(?:он|оны|она|онов|ону|оном|онище)", True, True, True),
    ("gandon", "translit", "TRANSLIT", "high", "gand(?:on|ony|ona|onov)", True, True, False),
    ("her", "base", "VULGAR", "low", "(?:на|по|ни|до|о)?хер(?:|а|у|ом|ня|ни|ню|ней|ово|овый|овая|овое|овые|ачить|ачит|ачил|анул|ануть|ит|ил|ить|ов|ы|ище)", True, False, False),
    ("her", "verb", "VULGAR", "low", "(?:о|за|на|по|вы|от|про|до)хер(?:еть|ел|ела|ели|ачить|ачил[а-я]*|енно|енный|евать|евший|ело|ею|еешь)", True, False, False),
    ("her", "translit", "TRANSLIT", "low", "(?:na|po|ni|do)?her(?:nya|nia|ovo|ovyi|a)", True, False, False),
    ("shit", "govno", "VULGAR", "medium", f"г{_O}вн(?:о|а|е|у|ом|ище|юк|юки|яный|яная|яное|яные|ецо|оед[а-я]*|окод[а-я]*|ина|ы)", True, True, True),
    ("shit", "derm", "VULGAR", "low", "дерьм(?:о|а|у|ом|е|овый|овая|овое|ище|ец[а-я]*)", True, True, False),
    ("shit", "srat", "VULGAR", "medium", "(?:на|за|об|обо|у|про|по|вы|до|пере|ра[сз])?ср(?:ать|ал|ала|али|ань|анина|аный|аная|аное|аные|ака|аки|ешь|ет|ут|анец)", True, False, False),
    ("shit", "zhopa", "VULGAR", "low", f"ж{_O}п(?:а|ы|е|у|ой|ам|ой|ка|ку|ошник|олиз[а-я]*)", True, True, False),
    ("shit", "translit", "TRANSLIT", "medium", "govn(?:o|a|yuk|ina|ische)|der[']?mo", True, False, False),
    ("chmo", "base", "STRONG_INSULT", "medium", f"чм{_O}(?:|шник|шники|шника|шный|ня|шня|рить)|чмырь|чмыр[яиюе]", True, True, False),
    ("chmo", "translit", "TRANSLIT", "medium", "chmo(?:|shnik|shniki|nya)", True, False, False),
    ("drochit", "base", "VULGAR", "medium", "(?:по|на|за|от|про)?др[оа]ч(?:ить|ит|ил|ила|или|ер|еры|ка|ки|ишь|у|ат|илово)", True, False, False),
    ("manda", "base", "OBSCENE_MAT", "medium", "манд(?:а|ы|е|у|ой|авошка|авошк[а-я]+|енка|овошка)", True, False, False),
]
_SEGMENT = {"OBSCENE_MAT": "obscene", "STRONG_INSULT": "insult", "VULGAR": "vulgar", "TRANSLIT": "translit", "EUPHEMISM": "euphemism"}


def _russian_rules() -> tuple[Rule, ...]:
    out = []
    for family, name, category, severity, pattern, strict, loose, stretch in _RU:
        folded = pattern
        if category == "TRANSLIT":
            folded = "".join(a.translate(LATIN_TO_CYRILLIC) if len(a) == 1 or a[0] == "[" and "-" not in a else r"\p{L}" if a[0] == "[" else a for a in _ATOM.findall(pattern))
        out.append(Rule(f"ru.{_SEGMENT[category]}.{family}.{name}", category, severity, folded, strict, Loose(stretch) if loose else None))
    return tuple(out)


RUSSIAN = Dictionary("ru", _russian_rules())


def russian_filter(strict: Iterable[object] = (), loose: Iterable[object] = ()) -> ProfanityFilter:
    return ProfanityFilter(RUSSIAN, tuple(terms(strict)), tuple(terms(loose)))


def custom_filter(strict: Iterable[object] = (), loose: Iterable[object] = (), normalization: str = "default") -> ProfanityFilter:
    """Literals only, no built-in rules."""
    return ProfanityFilter(Dictionary("custom", (), normalization), tuple(terms(strict)), tuple(terms(loose)))


# --- Composition -----------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    id: str
    language_tag: str
    filter: ProfanityFilter


def russian_profile() -> Profile:
    return Profile("ru:default", "ru", russian_filter())


def english_profile() -> Profile:
    return Profile("en:default", "en", english_filter())


@dataclass(frozen=True)
class ComposedFilter:
    """Profiles run on the original text; their matches are sorted by place and carry profile and language."""

    selections: tuple[tuple[Profile, Options], ...]

    def analyze(self, text: str, options: Options = Options(), modes: tuple[str, ...] = MODES) -> list[Match]:
        found = [replace(m, profile_id=p.id, language_tag=p.language_tag) for p, own in self.selections for m in p.filter.analyze(text, own.narrowed(options), modes)]
        return sorted(found, key=lambda m: (m.start, m.end))

    def check(self, text: str, options: Options = Options()) -> bool:
        return any(p.filter.check(text, own.narrowed(options)) for p, own in self.selections)

    def ranges(self, text: str, options: Options = Options()) -> list[tuple[int, int]]:
        return merge(u16_to_cp(text, [(m.start, m.end) for m in self.analyze(text, options)]))

    censor = ProfanityFilter.censor


def compose(profiles: Iterable[Profile | tuple[Profile, Options]]) -> ComposedFilter:
    """A repeated profile counts once; one id for different profiles, different options for one, or none at all are errors."""
    seen: dict[str, tuple[Profile, Options]] = {}
    for entry in profiles:
        profile, options = entry if isinstance(entry, tuple) else (entry, Options())
        if not isinstance(profile, Profile) or not profile.id or not profile.language_tag:
            raise TypeError("profiles need an id, a language tag and a filter")
        if profile.id in seen and seen[profile.id] != (profile, options):
            raise ValueError(f"profile {profile.id!r} is given twice with different content")
        seen[profile.id] = (profile, options)
    if not seen:
        raise ValueError("at least one profile is needed")
    return ComposedFilter(tuple(seen.values()))
