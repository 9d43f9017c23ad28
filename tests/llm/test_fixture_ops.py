"""Every operator on one small table with nulls, empty and long texts, ties, repeated rows and clashing columns, against
brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from textweir.llm import common, decontamination, fingerprints, licenses, line_dedup, ngram_jaccard, packing, quality, token_counts, toxicity, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = []
    base = [" ".join(words_of(r, 120, 5000)) for _ in range(12)]
    for i, b in enumerate(base):
        out.append((i * 10, b))
        for k in range(r.randrange(1, 9)):  # near copies
            w = b.split()
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            out.append((i * 10 + k + 1, " ".join(w)))
    passage = "\n".join(" ".join(words_of(r, 30)) for _ in range(3))
    for i in range(200, 212):
        lines = [" ".join(words_of(r, r.randrange(1, 40))) for _ in range(4)]
        lines.insert(r.randrange(5), passage)
        out.append((i, "\n".join(lines)))
    out += [(300, None), (301, ""), (302, "   \n\t "), (303, "one two"), (304, "One TWO"), (305, "x " * 21_000), (306, "Released under the MIT License.\nApache License, Version 2.0; CC BY-NC 4.0"), (307, "ünder the mit license and under-the-MIT license"), (308, "\n\n\n"), (309, "a\n" * 120), (310, "é̈ 日本語 😀 İΣ it's don't"), (311, base[0]), (312, base[0])]
    out += [(None, base[1]), (None, "lonely words here"), (303, "one two"), (0, base[0])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(i, t, "en", 1.5, "z", 7) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id bigint, text string, lang string, score double, block string, start int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def five(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    sets = [(i, five(t)) for i, t in rows]
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i == j or a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                low = min((x, y), key=lambda v: -1 if v is None else v)
                label[x] = label[y] = low
    return sorted([(i, len(s), find(i)) for i, s in sets], key=repr)


@pytest.mark.parametrize("small,crowd", [(32, 64), (3, 2)])
def test_near_duplicates(docs, rows, empty, small, crowd, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SMALL_KEY", small)
    monkeypatch.setattr(ngram_jaccard, "CROWD", crowd)
    monkeypatch.setattr(ngram_jaccard, "HUB_PAIRS", 2 if small == 3 else 500)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_NODES", 4 if small == 3 else 8192)
    got = sorted(map(tuple, ngram_jaccard.op3(docs).collect()), key=repr)
    assert got == components(rows)
    if small == 32:
        assert ngram_jaccard.op3(empty).collect() == []


@pytest.mark.parametrize("small, crowd", [(32, 64), (3, 3)])
def test_all_links(docs, rows, empty, small, crowd, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SMALL_KEY", small)
    monkeypatch.setattr(ngram_jaccard, "CROWD", crowd)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_NODES", 4 if small == 3 else 8192)
    sets = [five(t) for _, t in rows]
    alike = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    want = sorted(((i, len(x), sum(alike(x, y) for y in sets) - bool(x)) for (i, _), x in zip(rows, sets)), key=repr)
    assert sorted(map(tuple, ngram_jaccard.link_counts(docs).collect()), key=repr) == want
    found = ngram_jaccard.links(docs)[1]
    different = {frozenset(x) for x in sets if x}
    assert found.where("a >= b").isEmpty() and found.distinct().count() == found.count() == sum(alike(x, y) for x in different for y in different if x != y) // 2
    if small == 32:
        assert ngram_jaccard.link_counts(empty).collect() == []


def test_pigeonhole_bounds():
    bands = ngram_jaccard.size_bands(80)
    for n in range(1, 400):
        for m in range(n, n * 100 // 80 + 1):
            apart = ngram_jaccard.most_apart(n + m, 80)
            j = int(np.searchsorted(bands, m))
            assert apart <= ngram_jaccard.most_apart(2 * bands[j], 80) < ngram_jaccard.parts_of(bands[j], 80)
            assert np.searchsorted(bands, n) <= j <= np.searchsorted(bands, n * 100 // 80)
            for both in range(n + 1):
                if 100 * both >= 80 * (n + m - both):
                    assert n + m - 2 * both <= apart


def test_one_of_each(docs, rows):
    got = ngram_jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    sets, group = [five(t) for _, t in rows], list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) and group[x] != group[y]:
                group = [group[y] if g == group[x] else g for g in group]
    members = defaultdict(list)
    for (i, _), s, g in zip(rows, sets, group):
        members[g if s else (g, i)].append((i is not None, i or 0, i))
    want = [min(m)[2] for g, m in members.items()]
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert {t for i, t in ((r.doc_id, r.text) for r in got.collect()) if i is None} >= {"lonely words here"}  # shares an id, no link


def test_only_contaminated_rows_go(spark):
    item = " ".join(f"w{i}" for i in range(20))
    table = [(1, item + " end"), (1, "clean words only"), (None, item), (None, "another clean text"), (2, item), (2, item), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in table], "doc_id bigint, text string, row int")
    bench = spark.createDataFrame([("a", item), (None, None)], "item_id string, text string")
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "clean words only"), (None, "another clean text"), (3, None), (4, "")], key=repr)


def lines_left(rows):
    seen, first, out = {}, {}, []
    keyed = sorted({(-(2**63) if i is None else i, t) for i, t in rows}, key=lambda r: (r[0], r[1] or ""))
    windows = []
    for i, t in keyed:
        lines = [(k, x, len([w for w in re.split("[\x20\x09-\x0d]+", x) if w])) for k, x in enumerate((t or "").split("\n"))]
        full = [x for x in lines if x[2]]
        for a in range(len(full)):
            for b in range(a, len(full)):
                if sum(x[2] for x in full[a : b + 1]) >= 50:
                    windows.append((i, t, full[a][0], full[b][0], tuple(x[1] for x in full[a : b + 1])))
                    if b - a > 60:
                        break
    for i, t, s, e, body in windows:
        first[body] = min(first.get(body, (i, s)), (i, s))
    gone = defaultdict(set)
    for i, t, s, e, body in windows:
        if (i, s) > first[body]:
            gone[(i, t)].update(range(s, e + 1))
    for i, t in rows:
        key = (-(2**63) if i is None else i, t)
        lines = (t or "").split("\n")
        out.append((i, len(lines) if t else 0, len(gone[key]), t if not gone[key] else "\n".join(x for k, x in enumerate(lines) if k not in gone[key])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot,block", [(2_000, 50_000), (2, 3)])
def test_line_dedup(docs, rows, empty, hot, block, monkeypatch):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(line_dedup, "_BLOCK", block)
    assert sorted(map(tuple, line_dedup.op5(docs).collect()), key=repr) == lines_left(rows)
    assert line_dedup.op5(empty).collect() == []
    kept = line_dedup.drop_emptied(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (311, 312)").count() == 0 and kept.where("doc_id in (300, 301, 308)").count() == 3


def grams(rows, bench):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    items = [(i, tok(t)) for i, t in bench]
    out = []
    for i, t in rows:
        w, hit, found = tok(t), set(), set()
        for item, b in items:
            for k in range(max(1, len(b) - 12) if b else 0):
                g = b[k : k + 13]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        if item is not None:
                            found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [10**6, 300])
def test_decontamination(spark, docs, rows, empty, limit, monkeypatch):
    text = {i: t for i, t in rows}
    bench = [(1, " ".join(text[0].split()[20:50])), (2, "One, two!"), (3, ""), (4, None), (5, " ".join(text[200].split()[:14]).upper()), (10, " ".join(text[0].split()[30:43])), (None, "lonely words here"), (6, "zzz " * 13)]
    items = spark.createDataFrame([(*b, "x") for b in bench], "item_id bigint, text string, lang string")
    monkeypatch.setattr(decontamination, "BENCHMARK_BYTES", limit)
    found = decontamination.decontaminate(docs, items, benchmark_bytes=limit)
    ids = found.select("doc_id", "n_words", "n_hit", decontamination.F.size("items").alias("n"), decontamination.F.sha2(decontamination.F.array_join("items", ",").cast("binary"), 256).alias("h"), decontamination.contaminated().alias("c"))
    assert sorted(map(tuple, ids.collect()), key=repr) == grams(rows, bench)
    assert decontamination.op10(empty, items).collect() == []
    assert decontamination.op10(docs, items.limit(0)).where("n_hit > 0").count() == 0
    near = " ".join(w if k % 7 else "other" for k, w in enumerate(text[0].split()[20:50]))
    one = spark.createDataFrame([(1, near)], "doc_id bigint, text string")
    row = decontamination.decontaminate(one, items).first()
    assert row.n_hit == 0 and row.n_near > 0


def near_places(words, windows, slop=2, share=0.8):
    """Brute force over one document: places with enough terms nearby and one in its own place."""
    at = lambda p: words[p] if 0 <= p < len(words) else None
    found = set()
    for g in windows:
        k = len(g)
        for s in range(-k - slop, len(words) + slop):
            if sum(any(at(s + o + d) == x for d in range(-slop, slop + 1)) for o, x in enumerate(g)) >= share * k and any(at(s + o) == x for o, x in enumerate(g)):
                found.add(s)
    return found


def test_proximity_does_not_depend_on_the_block(spark):
    item = [f"item{k}" for k in range(30)]
    apart = [w if k % 7 else f"other{k}" for k, w in enumerate(item)]
    moved = item[:6] + ["more"] + item[6:20] + item[21:]
    texts = [(1, item), (2, apart), (3, moved), (4, item[5:11] + ["x"] * 20), (5, item[2:]), (6, ["y"] * 20 + item[:6]), (7, item[6:13] + ["z"] * 9)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    windows = [item[i : i + 13] for i in range(18)]
    want = {i: len(near_places(w, windows)) for i, w in texts}
    assert want[2] > 0 and want[4] == want[6] == want[7] == 0
    frame = lambda t: spark.createDataFrame([(i, " ".join(w)) for i, w in t], "doc_id bigint, text string").coalesce(1)
    together = {r.doc_id: r.n_near for r in decontamination.decontaminate(frame(texts), items).collect()}
    alone = {t[0]: decontamination.decontaminate(frame([t]), items).first().n_near for t in texts}
    assert together == alone == want
    assert {r.doc_id for r in decontamination.proximity_matches(frame(texts), items).collect()} == {1, 2, 3, 5}


def test_fingerprints(docs, rows, empty):
    keyed = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = fingerprints.op4(docs).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in rows), key=repr)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.fingerprint].add(r.doc_id)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {0, 311, 312} <= next(v for v in by_text.values() if 311 in v)
    unique = [(i, t or "") for i, t in keyed if i is not None and [x for x, _ in rows].count(i) == 1]
    following = {i: (keyed[k + 1][1] or "") for k, (i, _) in enumerate(keyed[:-1])}
    want = {i: hashlib.sha256(fingerprints.edited(t, following[i]).encode()).hexdigest() for i, t in unique if i in following}
    have = {r.doc_id: r.edited_sha256 for r in got}
    assert all(have[i] == h for i, h in want.items())
    own = {r.doc_id: r for r in got}
    for i, t in unique:
        assert own[i].n_chars == len(t) and own[i].fingerprint == fingerprints.fingerprint(fingerprints.tree(t.encode()))
        if i in following:  # the likeness follows from the fingerprints alone
            after, changed = following[i], (t[: len(t) - len(t) // 4] + following[i][: len(t) // 4]).encode()
            assert own[i].edited_fingerprint == fingerprints.fingerprint(fingerprints.tree(changed))
            next_print = fingerprints.fingerprint(fingerprints.tree(after.encode()))
            for near, other in ((own[i].near_edited, own[i].edited_fingerprint), (own[i].near_next, next_print)):
                a, b = (sorted(fingerprints.leaves_of(f).elements()) for f in (own[i].fingerprint, other))
                both, left = 0, list(b)
                for leaf in a:
                    if leaf in left:
                        left.remove(leaf)
                        both += leaf[1]
                total = sum(n for _, n in a) + sum(n for _, n in b)
                assert abs(near - (2 * both / total if total else 1.0)) < 1e-12
    last = max(i for i, _ in rows if i is not None)
    assert {r.edited_sha256 for r in got if r.doc_id == last} == {hashlib.sha256(fingerprints.edited(dict(rows)[last], keyed[0][1] or "").encode()).hexdigest()} or keyed[0][0] is None
    roots = defaultdict(set)
    for r in got:
        roots[r.fingerprint.split("|")[0]].add(r.fingerprint)
    assert all(len(v) == 1 for v in roots.values()) and len(roots) == len({t or "" for _, t in rows})
    assert fingerprints.op4(empty).collect() == []
    a, b = "one line here\n" * 3 + "last words", "one line here\n" * 3 + "other words"
    fa, fb = (fingerprints.fingerprint(fingerprints.tree(x.encode())) for x in (a, b))
    assert fa != fb and fingerprints.edits(fa, fb) and fingerprints.edits(fa, fa) == []


def test_fingerprints_of_a_paragraph_that_grows():
    r = random.Random(3)
    text = " ".join(words_of(r, 90, 5000)).encode()
    for n in (100, 250, 255, 256, 257, 300, 400):
        for more in (1, 10, 100):
            kept, grown = (fingerprints.leaves(fingerprints.tree(text[:x])) for x in (n, n + more))
            assert sum(size * c for (_, size), c in (kept - grown).items()) <= 160
            assert fingerprints.likeness(kept, grown) > 2 * max(0, n - 160) / (2 * n + more)
            assert n > 255 or list(fingerprints._cuts(text[:n]))[:-1] == [c for c in fingerprints._cuts(text[: n + more]) if c < n]


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.op6(docs).toPandas()
    want = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    have = [tuple(None if pd.isna(v) else int(v) for v in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    plain = packing.best_fit(sorted(got.length.tolist(), reverse=True))
    assert -(-got.length.sum() // 2048) <= got.sequence_id.nunique() <= max(plain) + 1
    assert packing.op6(empty).collect() == []


def test_local_search_empties_bins():
    sizes = np.array([4, 4, 3, 3, 3, 3])
    before = np.array(packing.best_fit(sizes.tolist(), 10))
    assert len(set(before)) == 3 and len(set(packing.improve(sizes, before, 10).tolist())) == 2
    for low, high in ((300, 1500), (600, 1100)):
        sizes = -np.sort(-np.random.default_rng(2).integers(low, high, 1500))
        before = np.array(packing.best_fit(sizes.tolist()))
        after = packing.improve(sizes, before)
        assert len(np.unique(after)) < len(np.unique(before)) and np.bincount(after, weights=sizes).max() <= packing.CAPACITY


def test_local_search_only_improves():
    r = np.random.default_rng(0)
    for low, high in ((300, 1500), (1, 2049), (600, 1100)):
        sizes = -np.sort(-r.integers(low, high, 800))
        before = np.array(packing.best_fit(sizes.tolist()))
        after = packing.improve(sizes, before)
        fill = lambda b: np.bincount(b, weights=sizes)
        assert fill(after).max() <= 2048 and (fill(after) ** 2).sum() >= (fill(before) ** 2).sum() and len(set(after)) <= len(set(before))


def test_licenses(docs, rows, empty):
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.op7(docs).collect()}
    want = set()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hits = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in hits]
        want.add((i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == want
    assert licenses.op7(empty).collect() == []


def test_license_rules(spark):
    cases = [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"), ("SPDX-License-Identifier: MPL-2.0 Mozilla Public License 2.0", "mpl-2"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("released into the public domain", "public-domain"), ("We permit licensed premises", ""), ("BSD 3-Clause License; all rights reserved", "bsd-3,proprietary"),
    ]
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    assert [r.labels for r in licenses.op7(d).orderBy("doc_id").collect()] == [x for _, x in cases]
    found = licenses.detections(d).where("doc_id = 1").first().found
    assert [x.label for x in found] == ["cc-by-nc-sa"]  # what lies inside is suppressed
    assert len(licenses.rules()) > 300


def texts_of(pattern):
    """One text for each choice of alternatives and options of a regex."""
    from re import _constants as c, _parser

    def one(op, arg):
        if op is c.LITERAL:
            return {chr(arg)}
        if op is c.SUBPATTERN:
            return many(arg[3])
        if op is c.BRANCH:
            return set().union(*map(many, arg[1]))
        if op in (c.MAX_REPEAT, c.MIN_REPEAT):
            return set().union(*({x * n for x in many(arg[2])} for n in {arg[0], max(1, arg[0])}))
        if op is c.IN:
            return set().union(*({chr(a[0])} if o is c.RANGE else {"7"} if o is c.CATEGORY else {chr(a)} for o, a in arg))
        return {"y"} if op is c.ANY else 1 / 0

    def many(items):
        out = {""}
        for item in items:
            out = {a + b for a in out for b in one(*item)}
        return out

    return many(_parser.parse(pattern))


def test_license_keywords_follow_from_the_regexes():
    ruled = [(regex, keyword) for _, regex, keyword in licenses.NAMES] + [(regex, keyword) for _, regex, keyword, _, _ in licenses.SIGNATURES] + [(regex, keyword) for _, regex, keyword, alone in licenses.IDENTIFIERS if alone]
    for regex, keyword in ruled:
        for text in texts_of(regex):
            assert any(f" {x} " in f" {text} " for x in keyword.split("|")), (text, keyword)
            assert re.search(licenses.PREFILTER, text), text
    for _, regex, keyword, _ in licenses.IDENTIFIERS:
        assert all(any(f" {x} " in f" {text} " for x in keyword.split("|")) for text in texts_of(regex))
    assert len(licenses.rules()) == 5 * len(licenses.NAMES) + len(licenses.IDENTIFIERS) + sum(x[3] for x in licenses.IDENTIFIERS) + len(licenses.SIGNATURES)


def test_license_alternatives(spark):
    cases = [
        ("licensed under GPL v3", "gpl-3"), ("GNU General Public License v2", "gpl-2"), ("GPL v1", "gpl-1"), ("LGPL v2", "lgpl-2"), ("LGPL v2.1", "lgpl-2.1"), ("LGPL v3", "lgpl-3"), ("AGPL v3", "agpl-3"), ("FreeBSD license", "bsd-2"), ("simplified BSD", "bsd-2"),
        ("0BSD", "bsd-0"), ("Creative Commons Zero", "cc0"), ("unauthorized copying is prohibited", "proprietary"), ("SPDX-License-Identifier: MIT", "mit"), ("Apache-2.0", "apache-2"), ("SPDX-License-Identifier: MPL-2.0", "mpl-2"), ("BSL-1.0", "bsl-1"),
        ("SPDX-License-Identifier: Apache-2.0 OR MIT", "apache-2,mit"), ("SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-3-Clause) AND ISC", "bsd-3,gpl-2,isc"), ("ich komme mit ruby", ""), ("license identifier here, come mit ruby", ""),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    assert [(cases[r.doc_id][0], r.labels) for r in licenses.op7(d).orderBy("doc_id").collect()] == cases


def test_license_words_between_underscores(spark):
    texts = ["CC_BY_NC", "CC-BY_NC", "_CC BY-NC_", "see _cc_by_nc_ here", "_CC0_", "xcc by nc", "cc by ncx", "\u00e9cc by nc"]
    got = [(r.n_base, r.first_word, r.labels) for r in licenses.op7(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert got[:5] == [(1, 0, "cc-by-nc")] * 3 + [(1, 1, "cc-by-nc"), (0, None, "cc0")]
    assert [n for n, _, _ in got[5:]] == [0, 0, 0]


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.default_tokenizer())
    t.encode_special_tokens = True
    full = lambda s: len(t.encode(s, add_special_tokens=False).ids)

    def want(i, s):
        s = s or ""
        out = s
        for start, delete, insert in token_counts.sample_edits(s):
            out = out[:start] + insert + out[min(len(out), start + delete) :]
        return i, len(s), full(s), len(out), full(out)

    assert sorted((tuple(r)[:5] for r in token_counts.op9(docs).collect()), key=repr) == sorted((want(i, s) for i, s in rows), key=repr)
    assert token_counts.op9(empty).collect() == []
    # a table of edits on kept trees gives the trees of the edited texts
    numbered = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    trees = token_counts.token_trees(numbered)
    r = random.Random(9)
    table = [(r_.doc_id, k, r.randrange(-2, 200), r.choice([0, 1, 30]), r.choice(["", " x", "don't", "\n"])) for r_ in numbered.select("doc_id").collect() if r_.doc_id % 3 for k in range(3)]
    edits = docs.sparkSession.createDataFrame(table, "doc_id bigint, ordinal int, start int, delete int, insert string")
    after = {x.doc_id: x for x in token_counts.edit_trees(token_counts.with_edits(trees, edits)).collect()}
    for x in numbered.collect():
        out = x.text or ""
        for _, _, start, delete, insert in sorted(e for e in table if e[0] == x.doc_id):
            start = max(0, min(start, len(out)))
            out = out[:start] + insert + out[min(len(out), start + delete) :]
        y = after[x.doc_id]
        assert (y.text, y.n_chars, y.n_tokens) == (out, len(out), full(out)) and sum(token_counts.unpack(y.lengths)) == len(out) and sum(token_counts.unpack(y.tokens)) == full(out)
        assert not out or (token_counts.unpack(y.sum_chars)[1], token_counts.unpack(y.sum_tokens)[1]) == (len(out), full(out))
    assert len(after) == numbered.count()
    count = token_counts.counter(token_counts.default_tokenizer())
    r = random.Random(1)
    for text in ("", "it's", "a  b\n\n c", " ".join(words_of(r, 500))):
        tree = token_counts.TokenTree(text, count)
        for _ in range(60):
            tree.edit(r.randint(-2, len(tree.text) + 2), r.choice([0, 1, 5, 300]), "".join(r.choices(["'", "re", " ", "\n", "x", "'s", "0", "é", "<|endoftext|>"], k=r.randrange(6))))
            assert tree.tokens == full(tree.text)


@pytest.fixture(scope="module")
def pages(spark):
    long, r = "p" * 150, random.Random(2)
    rows = [(5, "http://a/1", long), (3, "http://a/2", long), (4, None, "short"), (1, "u", "short"), (2, "u\r\nx", None), (6, "u", ""), (None, "u", long), (7, "u", "é" * 50), (8, "u", "é" * 50), (8, "u", "é" * 50), (9, "http://a/9", "".join(chr(r.randrange(32, 127)) for _ in range(300_000))), (10, "u", "WARC/1.1\r\n\r\n" * 20)]
    return rows, spark.createDataFrame([(*x, 1) for x in rows], "page_id bigint, url string, html string, payload int").repartition(3)


@pytest.mark.parametrize("broadcast,hot", [(100_000, 2_000), (0, 2)])
def test_warc(spark, pages, broadcast, hot, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)
    monkeypatch.setattr(common, "HOT", hot)
    rows, df = pages
    got = sorted((tuple(r)[:5] for r in warc.op1(df).collect()), key=repr)
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    groups = defaultdict(int)
    for _, _, h in rows:
        groups[(h or "").encode()] += 1
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in first and groups[b] > 1 and i != first[b]
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    assert got == sorted(want, key=repr)
    assert warc.op1(df.limit(0)).collect() == []


def test_warc_pushdown_and_plain_files(spark, pages, tmp_path):
    import gzip

    path = "file://" + str(tmp_path / "w")
    warc.archive(pages[1], path)
    d = spark.read.format("warc").load(path)
    assert d.where("record_type = 'revisit'").count() == 4 and d.where("target_uri like 'http://a/%' and record_type = 'response'").count() == 2
    assert d.where("refers_to is null").count() == 8 and d.where("record_id in ('<urn:page:9>', '<urn:page:4>')").count() == 2
    assert d.where("length(payload) > 1000").select("record_id").first()[0] == "<urn:page:9>"
    reader = warc.WarcReader({"path": path, "payload": "false"})
    reader.filters = [("eq", "record_type", "response")]
    read = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(read) == 8 and all(r[-1] is None for r in read)
    plain = tmp_path / "p"
    plain.mkdir()
    for k, f in enumerate((tmp_path / "w").glob("*.gz")):
        (plain / f"{k}.warc").write_bytes(gzip.decompress(f.read_bytes()))
    rows = lambda p: sorted(map(repr, spark.read.format("warc").load(p).collect()))
    assert rows("file://" + str(plain)) == rows(path)
    assert spark.read.format("warc").load("file://" + str(plain)).where("record_type = 'revisit'").count() == 4
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"a failed task's file")
    assert spark.read.format("warc").load(path).count() == 12


def test_quality(spark, docs, empty):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(["the", "of", "and", *words_of(r, 6)]) for _ in range(120)) + "."
    junk = [lambda: " ".join(w + r.choice(["###", "%%%", "&&&"]) for w in words_of(r, 80)), lambda: "SAME " * 200, lambda: (" ".join(words_of(r, 60)) + "!! ").upper(), lambda: " | ".join(words_of(r, 90))]
    rows = [(i, good() if i % 8 else junk[i // 8 % 4](), i % 8 != 0) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, truth boolean")
    out = d.join(quality.op8(d), "doc_id").toPandas()
    assert ((out.keep == 1) == out.truth).mean() > 0.97
    kept = quality.keep_good(d)
    assert kept.columns == d.columns and kept.where("truth").count() >= 690
    assert quality.op8(docs).count() == docs.count() and quality.keep_good(docs).columns == docs.columns
    assert quality.op8(empty).collect() == [] and quality.keep_good(empty).collect() == []


def test_quality_model_does_not_depend_on_the_order_of_rows(spark):
    r = random.Random(6)
    rows = [(i, " ".join(words_of(r, 60)) + r.choice(["", "###"])) for i in range(300)] + [(7, "alike " * 30)] * 50
    one, other = (quality.fit(spark.createDataFrame(x, "doc_id bigint, text string").repartition(n), 100) for x, n in ((rows, 2), (rows[::-1], 5)))
    assert np.array_equal(one[0], other[0]) and one[1] == other[1]


def test_expectation_maximisation_against_a_loop():
    r = random.Random(8)
    patterns = np.array([quality.pattern([r.randrange(3) for _ in quality.LABELLERS]) for _ in range(12)])
    counts = np.array([r.randrange(1, 9) for _ in patterns], float)
    prior, p = quality.expectation_maximisation(patterns, counts, 5)
    votes = [quality.unpack(int(x)) for x in patterns]
    bad = [0.9 if 2 in v else 0.1 for v in votes]
    for _ in range(5):
        n = sum(counts)
        share = (sum(b * c for b, c in zip(bad, counts)) + 1) / (n + 20)
        table = [[[0.0] * 3 for _ in (0, 1)] for _ in quality.LABELLERS]
        for i in range(len(quality.LABELLERS)):
            for cls in (0, 1):
                weight = [(b if cls else 1 - b) * c for b, c in zip(bad, counts)]
                for x in range(3):
                    table[i][cls][x] = (sum(w for w, v in zip(weight, votes) if v[i] == x) + 0.5) / (sum(weight) + 1.5)
        fresh = []
        for v in votes:
            odds = [1 - share, share]
            for i, x in enumerate(v):
                if x:
                    odds = [o * table[i][cls][x] / (1 - table[i][cls][0]) for cls, o in enumerate(odds)]
            fresh.append(odds[1] / sum(odds))
        bad = fresh
    assert abs(prior - share) < 1e-9 and np.allclose(p, np.array(table))


def test_toxicity_scores_against_loops():
    """The batched scorer against one word, one window and one filter at a time."""
    net = toxicity.Network(3)
    net.b[:] = np.linspace(-0.3, 0.2, len(net.b))
    docs = [b"one two three four", b"", b"single", b"repeat repeat repeat"]
    got = net.scorer()([toxicity.words(d) for d in docs])
    for text, z in zip(docs, got):
        vectors = [np.mean([net.e[s] for s in toxicity.grams(w)], axis=0) for w in toxicity.words(text)]
        pooled, column = [], 0
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                best = -np.inf
                for start in range(max(1, len(vectors))):
                    total = 0.0
                    for j in range(width):
                        if start + j < len(vectors):
                            total += float(vectors[start + j] @ net.w[:, (column + j) * toxicity.FILTERS + f])
                    best = max(best, total)
                pooled.append(best)
            column += width
        want = sum(max(x + b, 0) * v for x, b, v in zip(pooled, net.b, net.v)) + net.c[0]
        assert abs(float(z) - float(want)) < 1e-4, text


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables are not here")
def test_toxicity_ranks_held_out_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.op2(d, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    bad, good = out.score[out.toxic == 1].to_numpy(), out.score[out.toxic == 0].to_numpy()
    assert len(bad) and (bad[:, None] > good[None]).mean() + 0.5 * (bad[:, None] == good[None]).mean() > 0.8


def test_toxicity(spark, docs, empty):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(1500):
        w, bad = words_of(r, r.randrange(20, 120), 3000), r.random() < 0.2
        for _ in range(r.randrange(1, 4) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    d = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id bigint, text string")
    truth = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = toxicity.op2(d, truth).toPandas().merge(truth.toPandas(), on="doc_id", how="left")
    assert out.score.between(0, 1).all() and len(out) == 1502
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out & out.toxic.notna()]
    assert (held.predicted == held.toxic).mean() > 0.95
    assert toxicity.op2(docs, truth.limit(0)).where("score > 0").count() == 0
    assert toxicity.op2(empty, truth).collect() == []
