"""Dictionaries as data: reading them, linting them, rules as a table, and a command-line check of one JSON file.

    python -m textweir.sources.dictionaries FILE [--format text|json]

Exit codes: 0 valid, 1 issues, 2 unreadable or wrong usage.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from typing import Any

import regex
from pyspark.sql import DataFrame, SparkSession

from textweir.kernels.profanity import CATEGORIES, SEVERITIES, STRATEGIES, Dictionary, Loose, Rule, loosened

RULES_SCHEMA = "position int, language string, id string, category string, severity string, source string, strict boolean, loose struct<stretch:boolean,hyphen_tail:boolean,hyphen_tail_min:int>"
#: Category segments of rule ids (fixed values).
SEGMENTS = {"OBSCENE_MAT": "obscene", "STRONG_INSULT": "insult", "VULGAR": "vulgar", "EUPHEMISM": "euphemism", "TRANSLIT": "translit"}
_LANGUAGE = regex.compile(r"[a-z]{2,3}(?:-[a-z0-9]{2,8})*")
_ID = regex.compile(r"[a-z]{2,3}(?:\.[a-z0-9_-]+){2,}")
_RULE_KEYS = {"id", "category", "severity", "source", "match"}
_GENERATED = {"ruleId", "ruleSource", "mode", "generated", "profileId", "languageTag"}
_LOOSE_KEYS = {"stretch", "hyphenTail", "hyphenTailMin"}

Issue = tuple[str, str, str]


def source_of(source: Any) -> str:
    """A source may be given in parts."""
    return "".join(source) if isinstance(source, list) else source


def validate(d: Any) -> list[Issue]:
    """(path, code, message) of everything wrong with a dictionary, in document order."""
    if not isinstance(d, dict):
        return [("", "invalid_dictionary", "a dictionary is an object")]
    out: list[Issue] = []
    language = d.get("language")
    if not isinstance(language, str) or not language.strip():
        out.append(("language", "missing_language", "language is required"))
    elif not _LANGUAGE.fullmatch(language):
        out.append(("language", "invalid_language", "language is a lower-case tag such as 'en'"))
    if "normalization" in d and d["normalization"] not in STRATEGIES:
        out.append(("normalization", "unsupported_normalization", f"normalization is one of {', '.join(STRATEGIES)}"))
    rules = d.get("rules")
    if not isinstance(rules, list):
        return [*out, ("rules", "invalid_rules", "rules is a list")]
    if not rules:
        out.append(("rules", "empty_rules", "at least one rule is needed"))
    seen: dict[str, int] = {}
    for i, rule in enumerate(rules):
        out += _validate_rule(rule, f"rules[{i}]", language if isinstance(language, str) else "", seen, i)
    return out


def _validate_rule(rule: Any, at: str, language: str, seen: dict[str, int], i: int) -> list[Issue]:
    if not isinstance(rule, dict):
        return [(at, "invalid_rule", "a rule is an object")]
    out = [(f"{at}.{k}", "generated_metadata" if k in _GENERATED else "unsupported_rule_key", f"{k} is not a rule's key") for k in rule if k not in _RULE_KEYS]
    rid, category, severity = rule.get("id"), rule.get("category"), rule.get("severity")
    if not isinstance(rid, str) or not rid.strip():
        out.append((f"{at}.id", "missing_rule_id", "id is required"))
    else:
        if rid.startswith("builtin:"):
            out.append((f"{at}.id", "generated_rule_id", "builtin ids are generated"))
        elif not _ID.fullmatch(rid):
            out.append((f"{at}.id", "invalid_rule_id", "id is language.category.name"))
        elif language and rid.split(".")[0] != language:
            out.append((f"{at}.id", "rule_id_language_mismatch", f"id starts with {language!r}"))
        elif category in SEGMENTS and rid.split(".")[1] != SEGMENTS[category]:
            out.append((f"{at}.id", "rule_id_category_mismatch", f"the second part is {SEGMENTS[category]!r}"))
        if rid in seen:
            out.append((f"{at}.id", "duplicate_rule_id", f"also rules[{seen[rid]}]"))
        seen.setdefault(rid, i)
    for key, value, allowed in (("category", category, CATEGORIES), ("severity", severity, SEVERITIES)):
        if value is None:
            out.append((f"{at}.{key}", f"missing_rule_{key}", f"{key} is required"))
        elif value not in allowed:
            out.append((f"{at}.{key}", f"invalid_rule_{key}", f"{key} is one of {', '.join(allowed)}"))
    source = rule.get("source")
    parts = source if isinstance(source, list) else [source]
    if source is None or source == [] or source == "":
        out.append((f"{at}.source", "missing_rule_source", "source is required"))
    elif not all(isinstance(p, str) and p for p in parts):
        out.append((f"{at}.source", "invalid_rule_source", "source is text or a list of texts"))
    else:
        whole = source_of(source)
        if whole != whole.strip():
            out.append((f"{at}.source", "untrimmed_rule_source", "source has blanks at an end"))
        if whole != unicodedata.normalize("NFC", whole):
            out.append((f"{at}.source", "unnormalized_rule_source", "source is not in NFC"))
        try:
            regex.compile(whole)
        except regex.error as e:
            out.append((f"{at}.source", "invalid_rule_pattern", str(e)))
        else:
            out += _validate_match(rule.get("match"), f"{at}.match", whole)
    return out


def _validate_match(match: Any, at: str, source: str) -> list[Issue]:
    if match is None:
        return []
    if not isinstance(match, dict):
        return [(at, "invalid_match", "match is an object")]
    out = [(f"{at}.{k}", "unsupported_match_key", f"{k} is not a way to match") for k in match if k not in ("strict", "loose")]
    if not any(k in match for k in ("strict", "loose")):
        out.append((at, "empty_match", "strict or loose is needed"))
    if "strict" in match and match["strict"] != {}:
        out.append((f"{at}.strict", "invalid_strict_match", "strict takes no options"))
    loose = match.get("loose")
    if loose is not None:
        if not isinstance(loose, dict):
            return [*out, (f"{at}.loose", "invalid_loose_match", "loose is an object")]
        out += [(f"{at}.loose.{k}", "unsupported_loose_option", f"{k} is no loose option") for k in loose if k not in _LOOSE_KEYS]
        out += [(f"{at}.loose.{k}", "invalid_loose_option", f"{k} is true or false") for k in ("stretch", "hyphenTail") if k in loose and not isinstance(loose[k], bool)]
        least = loose.get("hyphenTailMin")
        if least is not None and (isinstance(least, bool) or not isinstance(least, int) or least < 1):
            out.append((f"{at}.loose.hyphenTailMin", "invalid_loose_option", "hyphenTailMin is a whole number from 1"))
        try:
            regex.compile(loosened(source, loose.get("stretch") is True))
        except regex.error as e:
            out.append((f"{at}.loose", "invalid_loose_pattern", str(e)))
    return out


def compile_dictionary(d: dict) -> Dictionary:
    """A valid dictionary's rules; ValueError with all issues otherwise."""
    issues = validate(d)
    if issues:
        raise ValueError("invalid dictionary:\n" + "\n".join(f"- {p}: {c}: {m}" for p, c, m in issues))
    rules = []
    for r in d["rules"]:
        match = r.get("match") or {"strict": {}, "loose": {}}
        loose = match.get("loose")
        rules.append(Rule(r["id"], r["category"], r["severity"], source_of(r["source"]), "strict" in match, Loose(loose.get("stretch", False), loose.get("hyphenTail", False), loose.get("hyphenTailMin", 1)) if loose is not None else None))
    return Dictionary(d["language"], tuple(rules), d.get("normalization", "default"))


def read_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """A dictionary from any path Spark can read."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(2).collect())
    return compile_dictionary(json.loads(text))


def rules_table(spark: SparkSession, *dictionaries: Dictionary) -> DataFrame:
    """One row per rule in authored order."""
    rows = [(i, d.language, r.id, r.category, r.severity, r.source, r.strict, (r.loose.stretch, r.loose.hyphen_tail, r.loose.hyphen_tail_min) if r.loose else None) for d in dictionaries for i, r in enumerate(d.rules)]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def dictionary_of(rules: DataFrame, language: str, normalization: str = "default") -> Dictionary:
    """Back from a table; rule tables are small by nature."""
    rows = rules.where(rules["language"] == language).orderBy("position").collect()
    return Dictionary(language, tuple(Rule(r.id, r.category, r.severity, r.source, r.strict, Loose(*r.loose) if r.loose else None) for r in rows), normalization)


def issues_table(spark: SparkSession, d: Any) -> DataFrame:
    return spark.createDataFrame(validate(d), "path string, code string, message string")


def main(argv: list[str]) -> int:
    form, files, args = "text", [], list(argv)
    while args:
        a = args.pop(0)
        if a == "--format" and args and args[0] in ("text", "json"):
            form = args.pop(0)
        elif a.startswith("--"):
            print(f"unknown option {a}", file=sys.stderr)
            return 2
        else:
            files.append(a)
    if len(files) != 1:
        print("usage: dictionaries FILE [--format text|json]", file=sys.stderr)
        return 2
    try:
        with open(files[0], encoding="utf-8") as f:
            d = json.load(f)
    except (OSError, ValueError) as e:
        print(f"{files[0]}: {e}", file=sys.stderr)
        return 2
    issues = validate(d)
    if form == "json":
        print(json.dumps({"file": files[0], "valid": not issues, "issues": [dict(zip(("path", "code", "message"), i)) for i in issues]}, ensure_ascii=False))
    else:
        print(f"{files[0]}: " + ("valid" if not issues else f"{len(issues)} issues"))
        for p, c, m in issues:
            print(f"- {p}: {c}: {m}")
    return 1 if issues else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
