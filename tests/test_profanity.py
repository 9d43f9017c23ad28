"""Profanity kernel: words by stem family, each in the disguises that the rules see through, and words that only look alike."""

import itertools
import json
import time

import pytest

from textweir.kernels import profanity as P
from textweir.kernels import text as T
from textweir.sources import dictionaries as D

RU, EN = P.russian_filter(), P.english_filter()
#: Russian words by family; any spread spelling counts for the first of a family that allows it.
FAMILIES = {
    "blya": ["блядь", "бля"], "eb_forms": ["ебу", "ебем", "ёбля"], "huy_forms": ["охуительно", "хуетень"], "huy": ["хуйня", "нахуй", "хуета"], "pizda": ["пизда", "распиздяй", "пиздец"], "eb": ["ебаный", "заебали", "объебал"], "pidor": ["пидорас", "пидоры"],
    "mud": ["мудак", "мудила"], "suka": ["сука", "суки"], "shlyuha": ["шлюха", "шлюхи"], "zalupa": ["залупа"], "gandon": ["гандон", "гондоны"], "shit": ["говно", "говнюк", "дерьмо"], "chmo": ["чмо"],
}
STRICT_ONLY = ["хер", "нахер", "срать", "дрочить", "манда"]
ENGLISH = [stem + end for _, _, words, _ in P.ENGLISH_WORDS.values() for stem, ends in words.items() for end in ("", *ends.split())]
SPREAD_ENGLISH = [stem for _, _, words, loose in P.ENGLISH_WORDS.values() if loose for stem in words]
MARKS = [" ", ".", "-", "_", " . ", "*", "💀", "​", "‍", "...", " - "]


def whole(f, text):
    out = f.censor(text)
    assert set(out) == {"*"} and len(out) == T.u16_length(text), (text, out)
    assert f.check(text) and f.analyze(text)


@pytest.mark.parametrize("word", [w for ws in FAMILIES.values() for w in ws] + STRICT_ONLY)
def test_russian_words(word):
    for spelling in (word, word.upper(), word.capitalize(), "".join(c.upper() if i % 2 else c for i, c in enumerate(word))):
        whole(RU, spelling)
        assert RU.censor(f"вот {spelling}, да") == f"вот {'*' * len(spelling)}, да"
        assert RU.censor(f"я{spelling}щ") == f"я{spelling}щ" or word in ("ебаный",)


@pytest.mark.parametrize("family,mark", list(itertools.product(FAMILIES, MARKS)))
def test_russian_spread(family, mark):
    whole(RU, mark.join(FAMILIES[family][0]))


@pytest.mark.parametrize("word,disguise", [("сука", "cyкa"), ("хуй", "xyй"), ("бля", "6ля"), ("блядь", "бл9дь"), ("пизда", "п1зда"[:1] + "изда"), ("сука", "сууукаа"), ("пиздец", "пиииздец"), ("мудак", "мууудак"), ("говно", "г0вно"), ("блядь", "бл＠дь"), ("залупа", "за́лупа"), ("пиздец", "п-и-и-з-д-е-ц"), ("пиздец", "п и и з д е ц"), ("сука", "с с у у к а")])
def test_russian_disguises(word, disguise):
    assert RU.check(word)
    whole(RU, disguise)


@pytest.mark.parametrize("word", ["suka", "blyad", "huy", "pizdec", "mudak", "gandon", "shlyuha"])
def test_russian_in_latin_letters(word):
    whole(RU, word)
    whole(RU, word.upper())


@pytest.mark.parametrize("text", ["хлебный", "оскорблять", "корабля", "мудрость", "сукно", "барсуки", "застрахуй", "употребить", "скипидар", "командир", "мандарины", "херувим", "х о л о д и л ь н и к", "небо", "рубли", "учебник", "стебель", "колебания", "гребля", "потреблять", "психуй", "отеб", "хуйлоид", "о-хер-ес", "на-хер-сон", "небеса", "хлебушек", "учёба", "тебе", "себе", "вебинар", "ребята"])
def test_russian_clean(text):
    assert RU.censor(text) == text and not RU.check(text)


@pytest.mark.parametrize("word", ENGLISH)
def test_english_words(word):
    for spelling in (word, word.upper(), word.title(), word.replace("u", "υ").replace("i", "ι").replace("a", "α"), "".join(chr(ord(c) + 0xFEE0) for c in word)):
        whole(EN, spelling)
        assert EN.censor(f"so {spelling}; ok") == f"so {'*' * len(spelling)}; ok"
    for glued in (f"{word}zq", f"zq{word}", f"x{word}x"):
        assert not EN.check(glued)
    for name in (f"@{word}", f"{word}.example.org", f"http://host/{word}", f"{word}@example.org"):
        assert EN.censor(f"see {name} there") == f"see {name} there"


@pytest.mark.parametrize("word,mark", list(itertools.product(SPREAD_ENGLISH, MARKS)))
def test_english_spread(word, mark):
    whole(EN, mark.join(word))
    assert EN.censor(f"oh... {mark.join(word)}!") == f"oh... {'*' * T.u16_length(mark.join(word))}!"


def test_any_number_of_marks_between_letters():
    for mark, n in itertools.product((".", "-", "*", " . "), (1, 4, 5, 40)):
        for f, word in ((EN, "shit"), (RU, "сука")):
            spread = (mark * n).join(word)
            assert f.censor(f"so {spread}!") == "so " + "*" * len(spread) + "!", spread
    assert not EN.check("f" + "." * 3000 + "x" + "." * 3000 + "uck")


def test_pieces_of_words_are_no_spread_word():
    for text in ("this hit", "fa gone", "push it", "as shown", "wh ore-ship", "sh item"):
        assert not EN.check(text), text


def test_modes_and_ids():
    strict, loose = EN.analyze("shit")
    assert (strict.mode, loose.mode, strict.rule_id, loose.rule_id) == ("strict", "loose", "en.obscene.shit", "en.obscene.shit")
    assert [m.mode for m in EN.analyze("s h i t")] == ["loose"] and [m.mode for m in EN.analyze("shit", modes=("strict",))] == ["strict"]
    assert {m.mode for m in RU.analyze("хуйня")} == {"strict", "loose"}


def test_options_and_offsets():
    text = "😀 dick and shit"
    assert [(m.start, m.end) for m in EN.analyze(text, P.Options(categories=("VULGAR",)))] == [(3, 7)]
    assert EN.ranges(text, P.Options(min_severity="high")) == [(11, 15)]
    assert EN.analyze(text, P.Options(severities=())) == []
    assert P.Options(("VULGAR",), None, "low").narrowed(P.Options(("VULGAR", "EUPHEMISM"), None, "high")) == P.Options(("VULGAR",), None, "high")


def test_runtime_literals_are_never_patterns():
    f = P.custom_filter(["q.r", "grumpy"], ["bogus"])
    assert f.censor("q.r qxr grumpy grumpyish b-o-g-u-s") == "*** qxr ****** grumpyish *********"
    g = f.with_strict("more", " more ", "")
    assert g.strict_terms == ("q.r", "grumpy", "more") and f.strict_terms == ("q.r", "grumpy")
    assert g.analyze("more")[0].category is None and not g.check("more", P.Options(min_severity="soft"))


def test_a_runtime_literal_lifts_the_exclusion():
    assert not EN.check("hello @dick")
    assert P.english_filter(strict=["dick"]).censor("hello @dick") == "hello @****"


def test_runtime_terms_can_be_replaced_and_removed():
    f = P.custom_filter(["one", "two"], ["three"])
    assert f.replace_strict("four").strict_terms == ("four",) and f.replace_loose().loose_terms == ()
    assert f.without_strict("one", "none").strict_terms == ("two",) and f.without_loose("three").loose_terms == ()
    assert not f.without_strict("one").check("one") and f.check("one")


def test_composition():
    both = P.compose([P.russian_profile(), P.english_profile(), P.english_profile()])
    found = both.analyze("shit и хуйня")
    assert [m.language_tag for m in found] == ["en", "en", "ru", "ru"]
    assert both.censor("shit и хуйня") == "**** и *****"
    with pytest.raises(ValueError):
        P.compose([])
    with pytest.raises(ValueError):
        P.compose([P.english_profile(), P.Profile(P.english_profile().id, "en-GB", EN)])
    with pytest.raises(TypeError):
        P.compose(["en"])


def test_chunks_equal_the_whole_text():
    """The shortcuts (known chunks, squeezed views) against every pattern on the whole text."""
    words = [w for ws in FAMILIES.values() for w in ws] + ENGLISH + ["хлебный", "sucker", "ok", "a", "b-c", "1", "..."]
    for i, text in enumerate([*words, *(" ".join(words[k : k + 7]) for k in range(0, len(words), 5)), *(m.join(w) for w in words[:12] for m in MARKS)]):
        for f in (RU, EN):
            s = P.fold(text, f.strategy)
            loose = {(a, b) for p, r in f._parts[1] for a, b in (m.span() for m in p.finditer(s)) if P._clear(s, a, b) and P._one_word(s[a:b])}
            want = {T.cp_to_u16(text, [x])[0] for x in loose if not (f.exclude and f.exclude(text, *x))}
            assert want <= {(m.start, m.end) for m in f.analyze(text) if m.mode == "loose"}, text


@pytest.mark.parametrize("part", ["f u c k ", "f ", "f.", "shit ", "😀 shit ", "сука ", "a" * 50 + " ", "х.у.й ", "-"])
def test_linear(part):
    began = time.process_time()
    text = part * (40_000 // len(part))
    EN.analyze(text)
    RU.analyze(text)
    assert time.process_time() - began < 30


GOOD = {"language": "en", "normalization": "latin-preserving", "rules": [{"id": "en.vulgar.heck", "category": "VULGAR", "severity": "low", "source": ["he", "ck"], "match": {"strict": {}, "loose": {"stretch": True}}}]}


def test_dictionary_lint_and_compile(spark):
    assert D.validate(GOOD) == []
    d = D.compile_dictionary(GOOD)
    assert P.ProfanityFilter(d).censor("heck h e c k heeeck checks") == "**** ******* ****** checks"
    bad = json.loads(json.dumps(GOOD))
    bad["rules"][0] |= {"severity": "loud", "match": {"fuzzy": {}}, "ruleId": 1}
    bad["rules"].append(dict(GOOD["rules"][0], source="x("))
    codes = {c for _, c, _ in D.validate(bad)}
    assert {"invalid_rule_severity", "unsupported_match_key", "generated_metadata", "duplicate_rule_id", "invalid_rule_pattern", "empty_match"} <= codes
    with pytest.raises(ValueError):
        D.compile_dictionary(bad)
    assert D.validate([])[0][1] == "invalid_dictionary"
    table = D.rules_table(spark, d, P.ENGLISH)
    assert table.count() == 14 and D.dictionary_of(table, "en", "latin-preserving").rules[0].id.startswith("en.")
    for dictionary in (P.ENGLISH, P.RUSSIAN):
        ids = [r.id for r in dictionary.rules]
        assert len(ids) == len(set(ids))
        assert all(P._compiled(P.loosened(r.source, True)) for r in dictionary.rules)


def test_cli(tmp_path, capsys):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(GOOD))
    bad.write_text("{}")
    assert D.main([str(good)]) == 0
    assert D.main([str(bad), "--format", "json"]) == 1
    assert D.main([str(tmp_path / "none.json")]) == 2 and D.main([]) == 2 and D.main(["--x"]) == 2
    assert '"valid": false' in capsys.readouterr().out
