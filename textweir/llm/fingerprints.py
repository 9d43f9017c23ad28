"""Document fingerprints as Merkle trees over chunks, paragraphs and sections.

Paragraphs are lines; a paragraph's bytes are cut into chunks where a rolling hash of eight bytes says so, so an edit
moves few boundaries; sections are runs of paragraphs that end where a paragraph's hash says so. A leaf is a chunk's
hash of 16 bytes, a node the hash of its children, the root that of the sections: roots are equal if and only if the
texts are. The fingerprint is the root and the tree as text, a leaf as four bytes of its hash and its length (up to 255).
Equal texts have equal fingerprints; different roots mean different texts, and differing branches locate the edit.
Likeness is the share of leaf bytes (by chunk, with multiplicity) that two fingerprints have in common.

Null text is empty; an empty text is a root without sections; two empty texts are alike (1). Rows that repeat a doc_id
follow each other in the order of their texts' hashes; null ids come first; other columns are ignored; an empty table
gives no rows. Texts travel once, to the range of ids that they belong to; a range's first text also goes to the range
before, as the text that follows there.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_arrow, shuffle_parts

#: Chunks average 8 bytes in the first SHORT bytes of a paragraph and 32 after them; sections average 8 paragraphs. The place of
#: a cut never depends on what follows it, and the cuts of the larger mask are cuts of the smaller one too.
CHUNK_MASK, SHORT_MASK, SHORT, SECTION_MASK = 31, 7, 256, 7
#: Leaves that a task keeps (some 200 bytes each).
KNOWN_LEAVES = 100_000
_FACTORS = [np.uint32(x | 1) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646C, 0xFD7046C5, 0xB55A4F09)]


def _cuts(data: bytes) -> list[int]:
    """Chunk ends of a text: after every line feed and where the rolling hash of the last eight bytes is 0."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = a * _FACTORS[0]
    for j in range(1, min(8, len(a))):
        h[j:] += a[:-j] * _FACTORS[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    lines = np.flatnonzero(a == 10) + 1
    starts = np.concatenate([[0], lines])
    into = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    mask = np.where(into < SHORT, np.uint32(SHORT_MASK), np.uint32(CHUNK_MASK))
    ends = np.flatnonzero(((h & mask) == 0) | (a == 10)) + 1
    return ends.tolist() if len(ends) and ends[-1] == len(a) else [*ends.tolist(), len(a)]


def _leaf(chunk: bytes) -> tuple[bytes, int]:
    return hashlib.blake2b(chunk, digest_size=16).digest(), len(chunk)


def tree(data: bytes, leaf: Callable[[bytes], tuple[bytes, int]] = _leaf) -> list[list[list[tuple[bytes, int]]]]:
    """Sections of paragraphs of (leaf hash, bytes)."""
    sections: list = [[]]
    paragraph: list[tuple[bytes, int]] = []
    start = 0
    if not data:
        return []
    for end in _cuts(data):
        chunk = data[start:end]
        paragraph.append(leaf(chunk))
        start = end
        if chunk[-1] == 10:
            sections[-1].append(paragraph)
            if not paragraph[-1][0][0] & SECTION_MASK:
                sections.append([])
            paragraph = []
    if paragraph:
        sections[-1].append(paragraph)
    return [s for s in sections if s]


def fingerprint(nodes: list) -> str:
    """root|section;section with section = hash:paragraph,paragraph and paragraph = its leaves, five bytes each, in base 64."""
    digest = lambda *parts: hashlib.blake2b(b"".join(parts), digest_size=16).digest()
    parts, tops = [], []
    for section in nodes:
        below = [digest(b"p", *(leaf for leaf, _ in p)) for p in section]
        tops.append(digest(b"s", *below))
        parts.append(tops[-1][:8].hex() + ":" + ",".join(base64.b64encode(b"".join(leaf[:4] + bytes((min(n, 255),)) for leaf, n in p)).decode().rstrip("=") for p in section))
    return digest(b"r", *tops).hex() + "|" + ";".join(parts)


def leaves(nodes: list) -> Counter:
    """A tree's leaves as its fingerprint holds them."""
    return Counter((leaf[:4], min(n, 255)) for s in nodes for p in s for leaf, n in p)


def leaves_of(print_: str) -> Counter:
    """The leaves that a fingerprint holds."""
    out: Counter = Counter()
    for section in filter(None, print_.split("|")[1].split(";")):
        for paragraph in section.split(":")[1].split(","):
            raw = base64.b64decode(paragraph + "=" * (-len(paragraph) % 4))
            out.update((raw[i : i + 4], raw[i + 4]) for i in range(0, len(raw), 5))
    return out


def likeness(a: Counter, b: Counter) -> float:
    """Share of leaf bytes in common; leaves are (hash, bytes)."""
    both = sum(leaf[1] * min(n, b[leaf]) for leaf, n in a.items() if leaf in b)
    total = sum(leaf[1] * n for leaf, n in a.items()) + sum(leaf[1] * n for leaf, n in b.items())
    return 2 * both / total if total else 1.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of ``a``'s fingerprint whose branch is not in ``b``'s."""
    if a.split("|")[0] == b.split("|")[0]:
        return []
    split = lambda f: [s.split(":") for s in f.split("|")[1].split(";") if s]
    there = split(b)
    sections, paragraphs = {s for s, _ in there}, {p for _, ps in there for p in ps.split(",")}
    return [(i, j) for i, (s, ps) in enumerate(split(a)) if s not in sections for j, p in enumerate(ps.split(",")) if p not in paragraphs]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


class Text:
    """A text with its tree and its leaves, which both its own row and that of the text before use."""

    def __init__(self, text: str, leaf: Callable[[bytes], tuple[bytes, int]]):
        self.text, self.nodes = text, tree(text.encode(), leaf)
        self.leaves = leaves(self.nodes)


def compare(own: Text, following: Text, leaf: Callable[[bytes], tuple[bytes, int]]) -> tuple:
    changed = edited(own.text, following.text).encode()
    other = tree(changed, leaf)
    return len(own.text), hashlib.sha256(changed).hexdigest(), fingerprint(own.nodes), fingerprint(other), likeness(own.leaves, leaves(other)), likeness(own.leaves, following.leaves)


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order, each with its follower; a range's last row is the first of the next range, which only follows."""
    held, leaf = None, Memo(_leaf, KNOWN_LEAVES).__getitem__  # nearly all chunks of an edited text are in the two that it is made of
    for batch in batches:
        out = []
        for part, ahead, doc, text in zip(*(batch.column(c).to_pylist() for c in ("_part", "_ahead", "doc_id", "text"))):
            own = Text(text, leaf)
            if held and held[0] == part:
                out.append((held[1], *compare(held[2], own, leaf)))
            held = None if ahead else (part, doc, own)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def _range_starts(keys: DataFrame) -> list[tuple[int, int]]:
    """The first (id, text hash) of each of as many ranges as there are shuffle partitions, with about as many rows each."""
    dealt = keys.repartitionByRange(shuffle_parts(keys.sparkSession), "_id", "_hash").groupBy(F.spark_partition_id().alias("p"))
    return sorted((r.k["_id"], r.k["_hash"]) for r in dealt.agg(F.min(F.struct("_id", "_hash")).alias("k")).collect())


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, in ascending doc_id."""
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = {"_id": F.coalesce("doc_id", F.lit(-(2**63))), "_hash": F.xxhash64("text")}
    starts = _range_starts(d.select(*(c.alias(n) for n, c in key.items())))
    if not starts:
        return map_arrow(d.withColumns({"_part": F.lit(0), "_ahead": F.lit(False)}), _chain, _RESULT)
    dtype = np.dtype([("id", np.int64), ("hash", np.int64)])
    bounds = np.array(starts, dtype)

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        rows = np.empty(len(ids), dtype)
        rows["id"], rows["hash"] = ids, hashes
        at = np.searchsorted(bounds, rows, "right") - 1
        first = bounds[at] == rows
        return pd.Series([[p, (p - 1) % len(bounds)] if f else [p] for p, f in zip(at.tolist(), first.tolist())])

    dealt = d.withColumns(key).withColumn("_ranges", ranges("_id", "_hash")).select("*", F.posexplode("_ranges").alias("_copy", "_part")).withColumn("_ahead", F.col("_copy") > 0)
    dealt = dealt.repartitionById(len(bounds), "_part").sortWithinPartitions("_part", "_ahead", "_id", "_hash")
    return map_arrow(dealt.select("_part", "_ahead", "doc_id", "text"), _chain, _RESULT)


def op4(documents: DataFrame) -> DataFrame:
    return fingerprints(documents)
