"""Word shingles as sorted arrays of 64-bit hashes, and connected components over verified links."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, materialise, space_words

#: Odd multipliers of the shingle hash, one a word.
_M = [np.uint64(m | 1) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_S1, _S2 = np.uint64(32), np.uint64(29)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S1)) * _M[0]
    return h ^ (h >> _S2)


def word_memo() -> Memo:
    return Memo(xxhash.xxh64_intdigest, limit=400_000)


def shingle_set(text: bytes, memo: Memo, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; a text of fewer words is one shingle, one without words has none."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h) if len(h) < k else k, np.uint64)
    for j in range(min(k, len(h))):
        out = mix(out + h[j : j + n] * _M[j % len(_M)])
    return np.unique(out)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node of its component.

    Each round every node takes the smallest of itself and its neighbours, and the edges are rewritten to those: the
    graph shrinks by a factor, so rounds are logarithmic in the longest path. Rounds are tables in the shared folder;
    hubs are pre-aggregated, and the joins read plain tables on both sides, so large keys are split."""
    maps = []
    e = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        p = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "parents")
        maps.append(p)
        e = e.join(p.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(p.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        e = materialise(e.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not maps:
        return edges.sparkSession.createDataFrame([], "node bigint, label bigint")
    out = maps[-1].select(F.col("u").alias("node"), F.col("p").alias("label"))
    for p in reversed(maps[:-1]):
        up = out.select(F.col("node").alias("p"), F.col("label").alias("_up"))
        out = materialise(p.join(up, "p", "left").select(F.col("u").alias("node"), F.coalesce("_up", "p").alias("label")), "labels")
    return out
