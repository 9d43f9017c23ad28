"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` splits the documents into blocks and stores, per block, the postings (term -> word positions) of
every term that a benchmark can look up. ``search_index`` intersects, per benchmark window, the offset-adjusted
posting lists starting from the window's rarest term in that block: a place stays if the next rarest term's sorted list
holds the place that it must stand at. The benchmark meets the stored index in parts of bounded size. Blocks are independent, so no key is hot, no
document leaves its block, and a lost executor costs its own blocks only.

Null text has no words; repeated rows are separate documents; an empty benchmark hits nothing; null item ids take
part in matching but are left out of the id list; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_bytes, blocks, map_arrow, materialise, plain_words, row_hash, without

WINDOW = 13
#: Text bytes of a block of the index.
BLOCK_BYTES = 6_000_000
#: Benchmark text bytes searched at a time; a larger benchmark is searched in several blocks over the same stored index.
BENCHMARK_BYTES = 4_000_000
#: Candidate places looked at together.
CANDIDATES = 2_000_000

INDEX = "block string, doc_ids array<bigint>, rows array<bigint>, starts array<int>, n_words array<int>, terms binary, offsets binary, positions binary"
HITS = "doc_id bigint, row bigint, n_words bigint, hit_from array<int>, hit_to array<int>, items array<string>, n_near bigint, block string, ordinal int"


def _term(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) or 1


def windows_of(items: list[tuple], size: int = WINDOW) -> dict[int, tuple[np.ndarray, list[list[str]]]]:
    """By length: the different windows of term hashes [n, length], and the ids (sorted strings, without null) that hold each."""
    found: dict[int, list[tuple[np.ndarray, object]]] = {}
    for item, text in items:
        t = np.fromiter(map(_term, plain_words(text or b"")), np.uint64)
        if len(t):
            found.setdefault(min(size, len(t)), []).append((np.lib.stride_tricks.sliding_window_view(t, min(size, len(t))), item))
    out = {}
    for length, parts in found.items():
        rows = np.concatenate([w for w, _ in parts])
        owner = np.repeat(np.arange(len(parts)), [len(w) for w, _ in parts])
        order = np.lexsort((owner, *rows.T))
        fresh = np.concatenate([[True], (rows[order][1:] != rows[order][:-1]).any(1)])
        bounds = [*np.flatnonzero(fresh).tolist(), len(order)]
        ids = [sorted({str(parts[o][1]) for o in owner[order[x:y]].tolist() if parts[o][1] is not None}) for x, y in zip(bounds, bounds[1:])]
        out[length] = (rows[order[fresh]], ids)
    return out


def build_index(documents: DataFrame, vocabulary: set[int] | None) -> DataFrame:
    """Postings by block. ``vocabulary``: term hashes worth storing (bounded by the benchmark); None stores all terms."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda w: t if (t := _term(w)) and (vocabulary is None or t in vocabulary) else 0)
        for table in blocks(batches, BLOCK_BYTES):
            ids, lengths, parts = table.column("doc_id").to_pylist(), [], []
            rows = table.column("row").to_pylist()
            for text in table.column("text").to_pylist():
                words = plain_words(text)
                lengths.append(len(words))
                parts.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
                parts.append(np.zeros(1, np.uint64))  # documents never touch
            tokens = np.concatenate(parts)
            starts = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + 1)[:-1]])
            at = np.flatnonzero(tokens)
            order = at[np.argsort(tokens[at], kind="stable")]
            terms, first = np.unique(tokens[order], return_index=True)
            first = np.append(first, len(order))
            yield pa.RecordBatch.from_pydict(
                {"block": [xxhash.xxh64_hexdigest(repr((ids[0], len(ids), ids[-1])).encode() + order.tobytes())], "doc_ids": [ids], "rows": [rows], "starts": [starts.tolist()], "n_words": [lengths], "terms": [terms.tobytes()], "offsets": [first.astype(np.int32).tobytes()], "positions": [order.astype(np.int32).tobytes()]},
                schema=pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()), ("offsets", pa.binary()), ("positions", pa.binary())]),
            )

    return map_arrow(documents.select("doc_id", row_hash().alias("row"), as_bytes().alias("text")), index, INDEX)


class _Lists:
    """All posting lists of a block as one sorted array: term * span + place."""

    def __init__(self, offsets: np.ndarray, positions: np.ndarray, span: int):
        self.span = span
        self.all = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets)) * span + positions

    def hold(self, term: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether a term's list holds a place from ``first`` to ``last``."""
        base = term * self.span
        return (term >= 0) & (first <= last) & (np.searchsorted(self.all, base + first) < np.searchsorted(self.all, base + last, "right"))


def _exact(lists, offsets, positions, rows, windows):
    """(window, start) of every place where all terms of a window stand consecutively; ``windows``: [n, k] indices into terms."""
    df = np.diff(offsets)
    freq = df[windows]
    order = np.argsort(freq, axis=1, kind="stable")
    n = np.take_along_axis(freq, order[:, :1], 1)[:, 0]
    found_w, found_at = [], []
    for part in np.array_split(np.arange(len(windows)), max(1, int(n.sum()) // CANDIDATES)):
        if not len(part):
            continue
        w = np.repeat(part, n[part])
        anchor = order[part, 0]
        begin = offsets[windows[part, anchor]]
        shift = np.repeat(begin - np.concatenate([[0], np.cumsum(n[part])[:-1]]), n[part])
        at = positions[np.arange(len(w)) + shift].astype(np.int64) - np.repeat(anchor, n[part])
        keep = (at >= 0) & (at + windows.shape[1] <= lists.span)
        w, at = w[keep], at[keep]
        for j in range(1, windows.shape[1]):  # the next rarest list, adjusted by its offset
            off = order[w, j]
            keep = lists.hold(windows[w, off], at + off, at + off)
            w, at = w[keep], at[keep]
            if not len(w):
                break
        found_w.append(rows[w])
        found_at.append(at)
    return (np.concatenate(found_w), np.concatenate(found_at)) if found_w else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _near(lists, offsets, positions, starts, n_words, windows, slop: int, share: float):
    """Proximity matches: places where at least ``share`` of a window's terms stand within ``slop`` places of theirs, and one in its own.

    A match lacks at most ``allowed`` terms, so it holds one of any ``allowed + 1``: each of the rarest so many (absent
    terms first) is an anchor in turn. The anchor itself may be ``slop`` off. All terms are of the anchor's document, so
    what is found does not depend on the block. Returns document and place as one number, once per place."""
    k = windows.shape[1]
    allowed = k - int(np.ceil(share * k))
    df = np.where(windows >= 0, np.diff(offsets)[np.maximum(windows, 0)], 0)
    order = np.argsort(df, axis=1, kind="stable")
    hopeless = (df == 0).sum(1) > allowed
    out = []
    for rank in range(allowed + 1):
        n = np.where(hopeless, 0, np.take_along_axis(df, order[:, rank : rank + 1], 1)[:, 0])
        cuts = np.searchsorted(np.cumsum(n), np.arange(CANDIDATES, int(n.sum()), CANDIDATES))
        for part in np.split(np.arange(len(windows)), cuts):
            places = np.repeat(part, n[part])
            if not len(places):
                continue
            anchor = order[part, rank]
            begin = offsets[np.maximum(windows[part, anchor], 0)]
            shift = np.repeat(begin - np.concatenate([[0], np.cumsum(n[part])[:-1]]), n[part])
            stands = positions[np.arange(len(places)) + shift].astype(np.int64)
            doc = np.searchsorted(starts, stands, "right") - 1
            for off in range(-slop, slop + 1):
                out.append(_verified(lists, starts, n_words, windows, order, places, doc, stands - np.repeat(anchor, n[part]) + off, slop, allowed))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _verified(lists, starts, n_words, windows, order, w, doc, at, slop: int, allowed: int):
    """Document and place, as one number, of those places ``at`` of the windows ``w`` that are proximity matches."""
    missed, placed = np.zeros(len(w), np.int16), np.zeros(len(w), bool)
    for j in range(windows.shape[1]):
        off = order[w, j]
        want, own = windows[w, off], at + off
        low, high = starts[doc], starts[doc] + n_words[doc] - 1
        seen = lists.hold(want, np.maximum(own - slop, low), np.minimum(own + slop, high))
        placed |= lists.hold(want, np.maximum(own, low), np.minimum(own, high))
        missed += ~seen
        keep = missed <= allowed
        w, doc, at, missed, placed = w[keep], doc[keep], at[keep], missed[keep], placed[keep]
        if not len(w):
            break
    return np.unique((doc[placed] << 32) + at[placed] - starts[doc[placed]] + (1 << 16))


def search_index(index: DataFrame, windows: dict[int, tuple[np.ndarray, list[list[str]]]], slop: int = 2, share: float = 0.8) -> DataFrame:
    """Per document: merged word spans under exact windows, the items found, and the number of proximity places."""
    items, by_size = [], {}
    for size, (hashes, ids) in windows.items():
        by_size[size] = (np.arange(len(items), len(items) + len(ids)), hashes)
        items += ids

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                terms, offsets, positions = np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["offsets"], np.int32).astype(np.int64), np.frombuffer(r["positions"], np.int32)
                starts, n_words = np.array(r["starts"], np.int64), np.array(r["n_words"], np.int64)
                lists = _Lists(offsets, positions, int(starts[-1] + n_words[-1]) + 1)
                got_w, got_a, got_n, near = [], [], [], []
                for size, (rows, hashes) in by_size.items():
                    if not len(terms):
                        continue
                    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                    at = np.where(terms[at] == hashes, at, -1)
                    whole = (at >= 0).all(1)
                    w, a = _exact(lists, offsets, positions, rows[whole], at[whole])
                    got_w.append(w)
                    got_a.append(a)
                    got_n.append(np.full(len(w), size))
                    if slop and size > 4:
                        near.append(_near(lists, offsets, positions, starts, n_words, at, slop, share))
                w, a, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (got_w, got_a, got_n))
                near = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
                doc = np.searchsorted(starts, a, "right") - 1
                near_of = np.bincount(near >> 32, minlength=len(starts))
                order = np.lexsort((a, doc))
                w, a, n, doc = w[order], a[order], n[order], doc[order]
                bounds = np.searchsorted(doc, np.arange(len(starts) + 1))
                out = {k: [] for k in ("hit_from", "hit_to", "items")}
                for d in range(len(starts)):
                    lo, hi = bounds[d], bounds[d + 1]
                    spans: list[list[int]] = []
                    for s, e in zip((a[lo:hi] - starts[d]).tolist(), (a[lo:hi] + n[lo:hi] - starts[d]).tolist()):
                        if spans and s <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], e)
                        else:
                            spans.append([s, e])
                    out["hit_from"].append([s for s, _ in spans])
                    out["hit_to"].append([e for _, e in spans])
                    out["items"].append(sorted({i for x in np.unique(w[lo:hi]).tolist() for i in items[x]}))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": r["doc_ids"], "row": r["rows"], "n_words": r["n_words"], **out, "n_near": near_of.tolist(), "block": [r["block"]] * len(starts), "ordinal": list(range(len(starts)))},
                    schema=pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("hit_from", pa.list_(pa.int32())), ("hit_to", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("n_near", pa.int64()), ("block", pa.string()), ("ordinal", pa.int32())]),
                )

    return map_arrow(index, search, HITS)


def decontaminate(documents: DataFrame, benchmark: DataFrame, slop: int = 2, share: float = 0.8, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """doc_id, row (its hash), n_words, spans of hit words, items found, n_hit, n_near (proximity places) of every document.

    The benchmark is read to the driver only in blocks of about ``benchmark_bytes`` of text."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), as_bytes().alias("text"))
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // benchmark_bytes) or 1
    if n == 1:
        found = windows_of([(r.item_id, bytes(r.text)) for r in bench.collect()])
        index = materialise(build_index(documents, {t for hashes, _ in found.values() for t in np.unique(hashes).tolist()}), "postings")
        out = search_index(index, found, slop, share).drop("block", "ordinal")
    else:
        index, parts = materialise(build_index(documents, None), "postings"), None
        for i in range(n):
            one = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
            part = search_index(index, windows_of([(r.item_id, bytes(r.text)) for r in one.collect()]), slop, share)
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("block", "ordinal").agg(
            F.first("doc_id").alias("doc_id"), F.first("row").alias("row"), F.first("n_words").alias("n_words"), F.sum("n_near").alias("n_near"),
            F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_from", "hit_to")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        merged = merged.withColumn(
            "spans",
            F.aggregate(
                "spans",
                F.expr("cast(array() as array<struct<hit_from:int,hit_to:int>>)"),
                lambda acc, x: F.when((F.size(acc) > 0) & (x["hit_from"] <= F.element_at(acc, -1)["hit_to"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["hit_from"].alias("hit_from"), F.greatest(F.element_at(acc, -1)["hit_to"], x["hit_to"]).alias("hit_to"))))).otherwise(F.concat(acc, F.array(x))),
            ),
        )
        out = merged.select("doc_id", "row", "n_words", F.col("spans.hit_from").alias("hit_from"), F.col("spans.hit_to").alias("hit_to"), "items", "n_near")
    return out.withColumn("n_hit", F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y))


def contaminated():
    """At least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` less those that the contamination rule judges contaminated (exact windows only)."""
    return without(documents, decontaminate(documents, benchmark, slop=0).where(contaminated()))


def op10(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(documents, benchmark, slop=0).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def proximity_matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents with exact or proximity places of benchmark windows, and how many."""
    return decontaminate(documents, benchmark).where("n_near > 0 or n_hit > 0").select("doc_id", "n_words", "n_hit", "n_near")


ORACLE = r"""
with d as (select row_number() over () as k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark),
bw as (select distinct item_id, len(w[i:i+12]) as n, array_to_string(w[i:i+12], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select k, i, n, array_to_string(w[i:i+n-1], ' ') as g from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select dw.k, dw.i, dw.n, bw.item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
words as (select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + n)) as p from hit) group by k),
its as (select k, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct k, item_id::varchar as s from hit) group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (k) left join its using (k)
"""
