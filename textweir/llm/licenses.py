"""License scans by ordered signature rules, with DataFrame expressions only.

A text becomes its lower-cased words. A keyword prefilter drops documents, then rules, that cannot match; the regexes of
the rest run over the words. A detection that lies inside one of higher priority, or of equal priority and greater
length, is suppressed. The three base phrases are counted at all their places and always keep their labels.

Null and empty texts have no words; repeated rows give repeated results; an empty table gives no rows; other columns are
ignored. Everything happens inside a row: no shuffle, no join.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Detections of a row that are looked through together.
_CHUNK = 256

#: Phrases of the base rule and their labels (fixed values).
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: What separates words; upper case still counts as a word's character here.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Licenses: label, the words that name it (regex over single-spaced lower-case words), words of which such text holds one at least.
NAMES = [
    ("mit", r"mit licen[cs]e", "mit"),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?", "attribution"),
    ("x11", r"x11 licen[cs]e", "x11"),
    ("isc", r"isc licen[cs]e", "isc"),
    ("apache-1.1", r"apache (?:software )?licen[cs]e (?:version )?1 1", "apache"),
    ("apache-2", r"apache (?:software )?licen[cs]e (?:version |v )?(?:2 0|2|v2)(?: 0)?", "apache"),
    ("apache", r"apache (?:software )?licen[cs]e", "apache"),
    ("gpl-1", r"(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v )?(?:1|v1)(?: 0)?", "1|v1"),
    ("gpl-2", r"(?:gnu )?(?:general public licen[cs]e|gpl) (?:as published by the free software foundation )?(?:either )?(?:version |v )?(?:2|v2)(?: 0)?(?: or (?:any |at your option )?(?:any )?later(?: version)?)?", "2|v2"),
    ("gpl-3", r"(?:gnu )?(?:general public licen[cs]e|gpl) (?:as published by the free software foundation )?(?:either )?(?:version |v )?(?:3|v3)(?: 0)?(?: or (?:any |at your option )?(?:any )?later(?: version)?)?", "3|v3"),
    ("gpl-2", r"gplv2", "gplv2"),
    ("gpl-3", r"gplv3", "gplv3"),
    ("gpl", r"gnu (?:general public licen[cs]e|gpl)", "gnu"),
    ("lgpl-2", r"(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl) (?:version |v )?(?:2|v2)(?: 0)?", "2|v2"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl) (?:version |v )?(?:2 1|v2 1)", "2|v2"),
    ("lgpl-3", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl) (?:version |v )?(?:3|v3)(?: 0)?", "3|v3"),
    ("lgpl", r"gnu (?:(?:lesser|library) general public licen[cs]e|lgpl)", "gnu"),
    ("agpl-3", r"(?:gnu )?(?:affero general public licen[cs]e|agpl) (?:version |v )?(?:3|v3)(?: 0)?", "3|v3"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "affero"),
    ("gfdl-1.3", r"(?:gnu )?free documentation licen[cs]e (?:version )?1 3", "documentation"),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", "documentation"),
    ("bsd-2", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", "bsd|freebsd"),
    ("bsd-3", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", "bsd"),
    ("bsd-4", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?", "bsd"),
    ("bsd-0", r"(?:bsd zero clause|zero clause bsd|0bsd)(?: licen[cs]e)?", "bsd|0bsd"),
    ("bsd", r"bsd(?: style)? licen[cs]e", "bsd"),
    ("mpl-1.1", r"mozilla public licen[cs]e (?:version )?1 1", "mozilla"),
    ("mpl-2", r"mozilla public licen[cs]e (?:version |v )?2(?: 0)?", "mozilla"),
    ("mpl", r"mozilla public licen[cs]e", "mozilla"),
    ("epl-1", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?", "eclipse"),
    ("epl-2", r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?", "eclipse"),
    ("epl", r"eclipse public licen[cs]e", "eclipse"),
    ("eupl", r"european union public licen[cs]e(?: (?:version )?1 [12])?", "european"),
    ("cddl-1", r"common development and distribution licen[cs]e(?: (?:version )?1 [01])?", "common"),
    ("cpl-1", r"common public licen[cs]e(?: (?:version )?1 0)?", "common"),
    ("ms-pl", r"microsoft public licen[cs]e", "microsoft"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft"),
    ("bsl-1", r"boost software licen[cs]e(?: (?:version )?1 0)?", "boost"),
    ("busl-1.1", r"business source licen[cs]e(?: (?:version )?1 1)?", "business"),
    ("elastic-2", r"elastic licen[cs]e(?: (?:version |v )?2(?: 0)?)?", "elastic"),
    ("sspl-1", r"server side public licen[cs]e(?: (?:version |v )?1)?", "server"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("artistic-2", r"artistic licen[cs]e (?:version )?2(?: 0)?", "artistic"),
    ("artistic", r"artistic licen[cs]e", "artistic"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e", "what"),
    ("wtfpl", r"wtfpl", "wtfpl"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("psf-2", r"python software foundation licen[cs]e(?: (?:version )?2)?", "python"),
    ("ruby", r"ruby licen[cs]e", "ruby"),
    ("php-3", r"php licen[cs]e(?: (?:version )?3(?: 01?)?)?", "php"),
    ("openssl", r"openssl licen[cs]e", "openssl"),
    ("ofl-1.1", r"sil open font licen[cs]e(?: (?:version )?1 1)?", "font"),
    ("odbl-1", r"open (?:data commons )?(?:open )?database licen[cs]e", "database"),
    ("odc-by", r"open data commons attribution licen[cs]e", "attribution"),
    ("pddl", r"public domain dedication(?: and licen[cs]e)?", "dedication"),
    ("cc0", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "cc0|zero"),
    ("cc-by", r"cc by(?: licen[cs]e)?(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", "by"),
    ("cc-by", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", "commons"),
    ("cc-by-sa", r"cc by sa(?: licen[cs]e)?(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", "sa"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", "commons"),
    ("cc-by-nd", r"cc by nd(?: [1-4] [05])?", "nd"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", "commons"),
    ("cc-by-nc", r"cc by nc(?: [1-4] [05])?", "nc"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", "commons"),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?", "sa"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "commons"),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?", "nd"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?", "commons"),
    ("cc", r"creative commons licen[cs]e", "commons"),
]

#: SPDX identifiers whose words no name above holds: label, regex, keyword, whether it counts by itself. The others are words of
#: everyday texts, so they count after "license identifier" only, also in an expression ("MIT OR Apache-2.0").
IDENTIFIERS = [
    ("mit", r"mit", "mit", False),
    ("mit-0", r"mit 0", "mit", False),
    ("x11", r"x11", "x11", False),
    ("isc", r"isc", "isc", False),
    ("apache-1.1", r"apache 1 1", "apache", True),
    ("apache-2", r"apache 2 0", "apache", True),
    ("gfdl-1.3", r"gfdl 1 3", "gfdl", True),
    ("gfdl", r"gfdl 1 [12]", "gfdl", True),
    ("mpl-1.1", r"mpl 1 1", "mpl", True),
    ("mpl-2", r"mpl 2 0", "mpl", True),
    ("epl-1", r"epl 1 0", "epl", True),
    ("epl-2", r"epl 2 0", "epl", True),
    ("eupl", r"eupl 1 [012]", "eupl", True),
    ("cddl-1", r"cddl 1 [01]", "cddl", True),
    ("cpl-1", r"cpl 1 0", "cpl", True),
    ("ms-pl", r"ms pl", "pl", False),
    ("ms-rl", r"ms rl", "rl", False),
    ("bsl-1", r"bsl 1 0", "bsl", True),
    ("busl-1.1", r"busl 1 1", "busl", True),
    ("elastic-2", r"elastic 2 0", "elastic", False),
    ("sspl-1", r"sspl 1 0", "sspl", True),
    ("zlib", r"zlib", "zlib", False),
    ("artistic-2", r"artistic 2 0", "artistic", False),
    ("artistic", r"artistic 1 0", "artistic", False),
    ("postgresql", r"postgresql", "postgresql", False),
    ("psf-2", r"(?:psf|python) 2 0(?: 1)?", "psf|python", False),
    ("ruby", r"ruby", "ruby", False),
    ("php-3", r"php 3 01?", "php", False),
    ("openssl", r"openssl", "openssl", False),
    ("ofl-1.1", r"ofl 1 1", "ofl", True),
    ("odbl-1", r"odbl 1 0", "odbl", True),
    ("odc-by", r"odc by 1 0", "odc", True),
    ("pddl", r"pddl 1 0", "pddl", True),
]

#: Ways to grant a license: regex around the name, extra keyword, priority, weight.
FORMS = [
    (r"{name}", None, 40, 0.7),
    (r"under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}", "under", 60, 0.9),
    (r"licen[cs]ed (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}", "under", 80, 0.97),
    (r"(?:re)?(?:released|distributed|available|provided|published|offered) under (?:the )?(?:terms of (?:the )?)?{name}", "under", 75, 0.95),
    (r"(?:spdx )?licen[cs]e identifier {name}(?: only| or later)?", "identifier", 90, 1.0),
]

#: Texts that grant or reserve rights without a license's name: label, regex, keyword, priority, weight.
SIGNATURES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby", 85, 0.98),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission", 85, 0.98),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 85, 0.98),
    ("bsd-3", r"neither the name of .{1,80}? nor the names of its contributors", "neither", 86, 0.9),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "redistribute", 85, 0.97),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", "redistribute", 85, 0.97),
    ("apache-2", r"you may not use this file except in compliance with the licen[cs]e", "compliance", 70, 0.9),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public licen[cs]e", "mozilla", 88, 0.99),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 88, 0.99),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty", 80, 0.9),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain", "domain", 70, 0.9),
    ("public-domain", r"(?:is|are) in the public domain", "domain", 50, 0.7),
    ("proprietary", r"all rights reserved", "reserved", 30, 0.5),
    ("proprietary", r"(?:unauthori[sz]ed|no) (?:copying|reproduction|use|distribution)(?: of this file)? (?:is (?:strictly )?prohibited|without (?:prior )?(?:written )?permission)", "prohibited|permission", 45, 0.7),
    ("proprietary", r"proprietary and confidential", "proprietary", 45, 0.7),
    ("proprietary", r"end user licen[cs]e agreement", "agreement", 45, 0.7),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 20, 0.4),
    ("copyright", r"copyright (?:c )?by", "copyright", 20, 0.4),
]

#: A document without any of these holds no rule's text (every rule needs a name, a grant or a reservation).
PREFILTER = (
    r"(?i)licen[cs]|copyright|gpl|wtfpl|creative" + SEPARATORS + "commons|public" + SEPARATORS + "domain|(?:^|" + SEPARATORS + ")cc(?:0|" + SEPARATORS + "(?:by|zero)(?:" + SEPARATORS + "|$))|bsd|permission|redistribut|compliance|all" + SEPARATORS + "rights|proprietary|neither" + SEPARATORS + r"the|mit" + SEPARATORS + "no|warranty|prohibited|(?:^|" + SEPARATORS + ")(?:apache|gfdl|[me]pl|eupl|cddl|cpl|bu?sl|sspl|ofl|odbl|odc" + SEPARATORS + "by|pddl)" + SEPARATORS + "[123]"
)


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """(label, regex, keywords, second keywords, priority, weight), by priority; names times forms, the identifiers, then the signatures."""
    out = [(label, form.replace("{name}", name), keyword, extra or keyword, priority, weight) for label, name, keyword in NAMES for form, extra, priority, weight in FORMS]
    known = "|".join([r"[al]?gpl [123] [01]", r"bsd [234] clause", "0bsd", "wtfpl", "unlicense", "cc0 1 0", r"cc by(?: nc)?(?: sa| nd)? [1-4] [05]", *(regex for _, regex, _, _ in IDENTIFIERS)])
    operand = f"(?:(?:{known})(?: only| or later)? (?:or|and) )?"  # written out, as Java wants a look-behind's greatest length
    after = rf"(?<=licen[cs]e identifier {operand * 8})"
    out += [(label, f"(?={regex} ){after}{regex}(?: only| or later)?", keyword, "identifier", 90, 1.0) for label, regex, keyword, _ in IDENTIFIERS]
    out += [(label, regex, keyword, keyword, 40, 0.7) for label, regex, keyword, alone in IDENTIFIERS if alone]
    out += [(label, regex, keyword, keyword, priority, weight) for label, regex, keyword, priority, weight in SIGNATURES]
    return sorted(out, key=lambda r: -r[4])


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, inside an expression."""
    return F.transform(F.array(value), body)[0]


def _chunks(items: Column) -> Column:
    """An array cut into arrays of at most _CHUNK items."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / _CHUNK).cast("int") - 1, F.lit(0))), lambda c: F.slice(items, c * _CHUNK + 1, _CHUNK))


def _places(words: Column, regex: Column) -> Column:
    """Word ranges of the matches of ``regex`` in ' w0 w1 ... ': pieces between matches start and end with a space. Running
    sums are taken in chunks, as growing an array by one copies it."""
    pieces = F.transform(F.split(words, regex, -1), lambda p: _spaces(p) - 1)
    matches = F.transform(F.regexp_extract_all(words, regex, F.lit(0)), lambda m: _spaces(m) + 1)
    none = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    step = lambda acc, x: F.struct((acc["at"] + x["p"] + x["m"]).alias("at"), F.concat(acc["found"], F.array(F.struct((acc["at"] + x["p"]).alias("start"), (acc["at"] + x["p"] + x["m"]).alias("stop")))).alias("found"))
    total = lambda chunk: F.aggregate(chunk, F.lit(0), lambda acc, x: acc + x["p"] + x["m"])
    before = lambda chunks: F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + total(c))))
    ranges = lambda z: F.aggregate(z["chunk"], F.struct(z["at"].alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    all_of = lambda chunks: F.flatten(F.transform(F.filter(F.arrays_zip(chunks.alias("chunk"), before(chunks).alias("at")), lambda z: z["chunk"].isNotNull()), ranges))
    return _let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(_let(_chunks_of_pairs(pieces, m), all_of)))


def _chunks_of_pairs(pieces: Column, matches: Column) -> Column:
    return _let(F.slice(F.arrays_zip(pieces.alias("p"), matches.alias("m")), 1, F.size(matches)), _chunks)


def _exactly(regex: str) -> str:
    return f"(?<= )(?:{regex})(?= )"


def _table(entries: list[tuple]) -> Column:
    names = ("label", "regex", "first", "second", "priority", "weight")
    return F.array(*(F.struct(*((F.array(*(F.lit(f" {x} ") for x in v.split("|"))) if n in ("first", "second") else F.lit(_exactly(v) if n == "regex" else v)).alias(n) for n, v in zip(names, e)), F.lit(i).alias("rule")) for i, e in enumerate(entries)))


def detections(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, ``base`` and ``found``: arrays of (start, stop, label, priority, weight, rule), ``found`` after suppression."""
    none = "cast(array() as array<struct<start:int,stop:int,label:string,priority:int,weight:double,rule:int>>)"
    text = F.coalesce("text", F.lit(""))
    d = documents.select("doc_id", F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("n_words"), F.when(text.rlike(PREFILTER), text).alias("_text"))
    d = d.withColumn("_words", F.when(F.col("_text").isNotNull(), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("_text", string.ascii_uppercase, string.ascii_lowercase), SEPARATORS, " ")), F.lit(" ")))).drop("_text")

    def matched(table: Column) -> Column:
        holds = lambda keywords: F.exists(keywords, lambda x: F.contains(F.col("_words"), x))
        gated = F.filter(table, lambda r: holds(r["first"]) & holds(r["second"]))
        hits = lambda r: F.transform(_places(F.col("_words"), r["regex"]), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight"), r["rule"].alias("rule")))
        return F.when(F.col("_words").isNotNull(), F.flatten(F.transform(gated, hits))).otherwise(F.expr(none))

    d = d.withColumns({"base": matched(_table([(label, phrase, phrase.split()[0], phrase.split()[-1], 100, 1.0) for phrase, label in BASE])), "_all": matched(_table(rules()))})

    def beats(o: Column, x: Column) -> Column:
        inside = (o["start"] <= x["start"]) & (o["stop"] >= x["stop"])
        longer = (o["stop"] - o["start"]) > (x["stop"] - x["start"])
        same = (o["start"] == x["start"]) & (o["stop"] == x["stop"])
        return inside & ((o["priority"] > x["priority"]) | ((o["priority"] == x["priority"]) & (longer | (same & (o["rule"] < x["rule"])))))

    # a detection that contains another begins no more than the longest one's words before it: in order of their starts, only
    # those of the chunk and of that stretch before it are compared
    d = d.withColumn("_all", F.array_sort("_all"))
    reach = F.array_max(F.transform("_all", lambda x: x["stop"] - x["start"]))
    d = d.withColumn("_reach", reach)
    near = lambda xs: F.filter("_all", lambda o: (o["start"] >= xs[0]["start"] - F.col("_reach")) & (o["start"] <= F.element_at(xs, -1)["start"]))
    kept = lambda z: F.filter(z["xs"], lambda x: ~F.exists(z["near"], lambda o: beats(o, x)))
    found = F.flatten(F.transform(F.transform(_chunks(F.col("_all")), lambda xs: F.struct(xs.alias("xs"), near(xs).alias("near"))), kept))
    return d.withColumn("found", F.when(F.size("_all") == 0, F.expr(none)).otherwise(found)).drop("_all", "_words", "_reach")


def op7(documents: DataFrame) -> DataFrame:
    labels = lambda *cs: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(c, lambda x: x["label"]) for c in cs)))), ",")
    starts = F.transform("base", lambda x: x["start"])
    weights = F.transform(F.concat("base", "found"), lambda x: x["weight"])
    return detections(documents).select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "found").alias("labels"), F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
    )
