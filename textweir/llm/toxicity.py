"""Convolutional toxicity classifier in numpy.

A word's vector is the mean of hashed embeddings of the word, its prefixes and its suffixes. Filters of widths 1 to 3
slide over the whole text, each filter's maximum is kept, and a logistic layer scores them. Training rows are a bounded
sample (``train_rows``) of labelled documents; a fifth of it is held back to calibrate: per language *as guessed from
the text* the logit is shifted so that 0.5 is the best threshold. Labels, lang, source and doc_id never reach a score.

Null and empty texts are one padded window and get that window's score; repeated rows score alike; without labels of
both classes every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow

#: Labelled documents used at most: half of them toxic if there are as many.
TRAIN_ROWS = 6000
SLOTS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 10, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 32, 0.02
#: Documents of each class that every slot is taken to have been seen in.
PRIOR_COUNT = 4.0
#: Words scored together, and distinct words kept by a worker.
CHUNK_WORDS, VOCABULARY = 150_000, 200_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Language cues: frequent function words (fixed values).
CUES = {
    "en": "the of and to is that it for was with by this from".split(),
    "fr": "le les des et une du qui dans pour pas est avec".split(),
    "de": "der die und den von mit ist im für auf ein eine nicht".split(),
    "es": "el los del y por con para su una como pero se".split(),
}
_CUE = {w.encode(): i for i, k in enumerate(CUES) for w in CUES[k]}
COLUMNS = [(w, j) for w in WIDTHS for j in range(w)]  # (width, place) blocks of FILTERS columns


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def grams(word: bytes) -> list[int]:
    """Hashed slots of the word, its prefixes and its suffixes."""
    out = [b"<" + word + b">"] + [b"<" + word[:k] for k in range(3, min(len(word), 10))] + [word[-k:] + b">" for k in range(3, min(len(word), 6))]
    return [zlib.crc32(g) % SLOTS for g in out]


def language(found: list[bytes]) -> int:
    """Index of the language with most cues, or len(CUES) if none."""
    n = [0] * (len(CUES) + 1)
    for w in map(_CUE.get, found):
        if w is not None:
            n[w] += 1
    best = max(range(len(CUES)), key=n.__getitem__)
    return best if n[best] else len(CUES)


class Network:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.02, (SLOTS, DIM)).astype(np.float32)
        self.w = r.normal(0, 0.2, (DIM, len(COLUMNS) * FILTERS)).astype(np.float32)
        self.w[0] = np.abs(self.w[0])
        self.b = np.full(len(WIDTHS) * FILTERS, -0.1, np.float32)
        self.v = np.abs(r.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32)
        self.c = np.full(1, -1, np.float32)
        self.shift = np.zeros(len(CUES) + 1)
        self.scale = 1.0

    def vectors(self, lists: list[list[int]]) -> np.ndarray:
        n = np.array([len(x) for x in lists])
        flat = np.fromiter((g for x in lists for g in x), np.int64, int(n.sum()))
        return np.add.reduceat(self.e[flat], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]

    def convolve(self, z: np.ndarray) -> np.ndarray:
        """z: [t, columns] word products -> [t, widths * filters] window sums; rows past the end are zero words."""
        out, k = [], 0
        for w in WIDTHS:
            s = z[:, k : k + FILTERS].copy()
            for j in range(1, w):
                s[:-j] += z[j:, k + j * FILTERS : k + (j + 1) * FILTERS]
            out.append(s)
            k += w * FILTERS
        return np.concatenate(out, 1)

    def head(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.b, 0) @ self.v + self.c

    def fit(self, docs: list[list[bytes]], y: np.ndarray, epochs: int = EPOCHS) -> None:
        ids: dict[bytes, int] = {}
        seqs = [np.array([ids.setdefault(w, len(ids)) for w in d], np.int64) for d in docs]
        slots = [grams(w) for w in ids]
        seen = np.full((2, SLOTS), PRIOR_COUNT)  # the first dimension starts as a slot's smoothed log odds of standing in a toxic text
        for seq, t in zip(seqs, y):
            seen[int(t), np.unique(np.fromiter((g for w in np.unique(seq) for g in slots[w]), np.int64))] += 1
        n = np.array([(y == 0).sum(), (y == 1).sum()]) + 2 * PRIOR_COUNT
        self.e[:, 0] = np.log(seen[1] / n[1]) - np.log(seen[0] / n[0])
        acc = {k: np.full_like(getattr(self, k), 1e-4) for k in "ewbvc"}
        r = np.random.default_rng(1)

        def descend(name: str, grad: np.ndarray, at=slice(None)) -> None:
            acc[name][at] += grad * grad
            getattr(self, name)[at] -= RATE * grad / np.sqrt(acc[name][at])

        for _ in range(epochs):
            for part in np.array_split(r.permutation(len(seqs)), max(1, len(seqs) // BATCH)):
                u, inverse = np.unique(np.concatenate([seqs[i] for i in part] or [np.zeros(0, np.int64)]), return_inverse=True)
                vec = np.vstack([self.vectors([slots[x] for x in u]) if len(u) else np.zeros((0, DIM)), np.zeros((1, DIM))]).astype(np.float32)
                z, pooled, arg, rows, k = vec @ self.w, [], [], [], 0
                for i in part:
                    own = np.concatenate([inverse[k : k + len(seqs[i])], np.full(2, len(u))])
                    k += len(seqs[i])
                    c = self.convolve(z[own])[: max(1, len(own) - 2)]
                    arg.append(c.argmax(0))
                    pooled.append(c[arg[-1], np.arange(c.shape[1])])
                    rows.append(own)
                pooled = np.array(pooled)
                h = np.maximum(pooled + self.b, 0)
                d = (1 / (1 + np.exp(-np.clip(h @ self.v + self.c, -30, 30))) - y[part]).astype(np.float32) / len(part)
                dh = d[:, None] * self.v * (h > 0)
                dw, dvec, col = np.zeros_like(self.w), np.zeros_like(vec), 0
                for wi, w in enumerate(WIDTHS):
                    block = dh[:, wi * FILTERS : (wi + 1) * FILTERS]
                    for j in range(w):
                        at = np.array([own[np.minimum(a[wi * FILTERS : (wi + 1) * FILTERS] + j, len(own) - 1)] for own, a in zip(rows, arg)])
                        cols = slice(col * FILTERS, (col + 1) * FILTERS)
                        dw[:, cols] = np.einsum("df,dfk->kf", block, vec[at])
                        np.add.at(dvec, at.ravel(), (block[:, :, None] * self.w[:, cols].T[None]).reshape(-1, DIM))
                        col += 1
                descend("v", h.T @ d)
                descend("c", d.sum(keepdims=True))
                descend("b", dh.sum(0))
                descend("w", dw)
                touched = [x for x in np.flatnonzero(np.abs(dvec[:-1]).sum(1)).tolist()]
                if touched:
                    n = np.array([len(slots[u[x]]) for x in touched])
                    flat = np.fromiter((g for x in touched for g in slots[u[x]]), np.int64, int(n.sum()))
                    g, where = np.unique(flat, return_inverse=True)
                    grad = np.zeros((len(g), DIM), np.float32)
                    np.add.at(grad, where, np.repeat(dvec[touched] / n[:, None], n, axis=0))
                    descend("e", grad, g)

    def scorer(self):
        """words of several texts -> their logits; a worker's vocabulary is bounded."""
        known: dict[bytes, int] = {}
        table = [np.zeros((1, self.w.shape[1]), np.float32)]

        def logits(docs: list[list[bytes]]) -> np.ndarray:
            if len(known) > VOCABULARY:
                known.clear()
                table[:] = [table[0][:1]]
            fresh = list(dict.fromkeys(w for d in docs for w in d if w not in known))
            if fresh:
                for k in range(0, len(fresh), 20_000):
                    new = fresh[k : k + 20_000]
                    known.update(zip(new, range(len(known) + 1, len(known) + 1 + len(new))))
                    table.append((self.vectors([grams(w) for w in new]) @ self.w).astype(np.float32))
                table[:] = [np.concatenate(table)]
            n = np.array([max(len(d), 1) + 2 for d in docs])  # an empty text is one zero word
            flat = np.zeros(int(n.sum()), np.int64)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            for s, d in zip(starts.tolist(), docs):
                flat[s : s + len(d)] = np.fromiter(map(known.__getitem__, d), np.int64, len(d))
            c = self.convolve(table[0][flat])
            ends = starts + np.maximum(n - 2, 1)
            pooled = np.maximum.reduceat(c, np.stack([starts, ends], 1).ravel())[::2]
            return self.head(pooled)

        return logits

    def probability(self, logit: np.ndarray, langs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (logit - self.shift[langs]), -30, 30)))

    def calibrate(self, logit: np.ndarray, y: np.ndarray, langs: np.ndarray) -> None:
        """Per guessed language, the threshold with the best F1 (the middle of the best gap); all texts' where a class is missing."""

        def best(z: np.ndarray, t: np.ndarray) -> float:
            order = np.argsort(-z, kind="stable")
            z, t = z[order], t[order]
            hit = np.cumsum(t)
            f1 = 2 * hit / (np.arange(1, len(t) + 1) + t.sum())
            at = int(np.argmax(f1))
            return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at] - 1)

        self.shift[:] = best(logit, y) if 0 < y.sum() < len(y) else 0.0
        for g in range(len(CUES) + 1):
            own = langs == g
            if y[own].sum() >= 5 and (1 - y[own]).sum() >= 5:
                self.shift[g] = best(logit[own], y[own])


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Network | None:
    """Train on a sample of ``labels`` (doc_id, toxic): the first ids by hash, half of them toxic if there are as many."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda t: known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows // 2)
    chosen = pick(1).unionAll(pick(0)).collect()
    sample = documents.sparkSession.createDataFrame([(r.doc_id, int(r.toxic)) for r in chosen], "doc_id bigint, toxic int")
    got = documents.select("doc_id", as_bytes().alias("text")).join(F.broadcast(sample), "doc_id").collect()
    got.sort(key=lambda r: (zlib.crc32(bytes(r.text)), r.toxic))
    y = np.array([r.toxic for r in got], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    docs = [words(bytes(r.text)) for r in got]
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    net = Network()
    net.fit([d for d, h in zip(docs, held) if not h], y[~held])
    use = held if 0 < y[held].sum() < held.sum() else ~held
    chosen_docs = [d for d, h in zip(docs, use) if h]
    logits = net.scorer()
    z = np.concatenate([logits(chosen_docs[i : i + 50]) for i in range(0, len(chosen_docs), 50)])
    net.calibrate(z, y[use], np.array([language(d) for d in chosen_docs]))
    return net


def score(documents: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score and the guessed language of every whole text."""
    names = [*CUES, "none"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits = net.scorer() if net else None
        for batch in batches:
            docs = [words(t) for t in batch.column("text").to_pylist()]
            langs = np.array([language(d) for d in docs], np.int64)
            z, part, size = [], [], 0
            for d in docs if net else ():
                part.append(d)
                size += len(d) + 2
                if size >= CHUNK_WORDS:
                    z.append(logits(part))
                    part, size = [], 0
            if part:
                z.append(logits(part))
            got = net.probability(np.concatenate(z), langs) if net and docs else np.zeros(len(docs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.astype(np.float64)), pa.array([names[i] for i in langs], pa.string())], names=["doc_id", "score", "guessed_lang"])

    return map_arrow(documents.select("doc_id", as_bytes().alias("text")), run, "doc_id bigint, score double, guessed_lang string")


def held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op2(documents: DataFrame, labels: DataFrame) -> DataFrame:
    net = fit(documents, labels.where(~held_out()))
    return score(documents, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "guessed_lang")
