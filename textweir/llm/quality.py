"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Vote patterns are counted over all documents (a
native pre-aggregated count, at most 3^m rows), expectation-maximisation on those counts estimates each heuristic's
accuracies and the class prior, and the posteriors label a bounded sample (about ``train_rows`` documents, chosen by hash, at most twice as many) on
which a hashed linear scorer is trained in numpy. The scorer rates every whole text. No gold label is used.

Null, empty and blank texts have no evidence: every heuristic abstains and the score is the prior's. Repeated rows and
ties score alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_bytes, map_arrow

#: Documents on which the scorer is trained.
TRAIN_ROWS = 6000
#: Hashed feature space.
DIMENSIONS = 1 << 14
EM_ROUNDS = 60
#: The most frequent function words of the corpora's languages (fixed values).
FUNCTION_WORDS = frozenset("the of and to a in is that it for was on are with as be by this an not or from at which but have had his they you de la le les des et en un une du que qui dans pour pas est par au sur der die das und zu den von mit ist im für auf ein eine nicht als auch es sich dem el los las del y por con para su lo una al se no mas o".encode().split())
_UPPER, _LOWER, _SYMBOL = bytes(range(65, 91)), bytes(range(97, 123)), b"#%&*$@^~<>{}[]\\|=_+"

#: Heuristics: name, statistic, bad from, good up to (bad below, good from where ``low_is_bad``), low_is_bad.
LABELLERS = [
    ("symbols", "symbols", 0.08, 0.03, False),
    ("marked_words", "marked", 0.3, 0.05, False),
    ("upper_case", "upper", 0.5, 0.2, False),
    ("pipes", "pipes", 0.15, 0.02, False),
    ("few_distinct", "distinct", 0.25, 0.4, True),
    ("runs", "runs", 0.15, 0.05, False),
    ("function_words", "function", 0.02, 0.08, True),
]


def statistics(text: bytes) -> tuple[dict[str, float], Counter, int]:
    words = text.split()
    n = len(words)
    if not n:
        return {}, Counter(), 0
    lower = text.lower()
    counts = Counter(words)
    letters_up, letters_low = len(text) - len(text.translate(None, _UPPER)), len(text) - len(text.translate(None, _LOWER))
    marked = sum(c for w, c in counts.items() if w[-1] in _MARKS and len(w) > 2 and w[-2] in _MARKS)
    return (
        {
            "symbols": (len(text) - len(text.translate(None, _SYMBOL))) / len(text),
            "marked": marked / n,
            "upper": letters_up / max(1, letters_up + letters_low),
            "pipes": counts[b"|"] / n,
            "distinct": len(counts) / min(n, 400) if n >= 20 else 1.0,
            "runs": sum(map(bytes.__eq__, words, words[1:])) / n if n >= 20 else 0.0,
            "function": sum(map(FUNCTION_WORDS.__contains__, lower.split())) / n if n >= 50 else 0.05,
        },
        counts,
        n,
    )


_MARKS = frozenset(b"!#$%&*")


def votes(stats: dict[str, float]) -> list[int]:
    """1 good, 2 bad, 0 nothing, by labeller."""
    out = []
    for _, key, bad, good, low_is_bad in LABELLERS:
        x = stats.get(key)
        if x is None:
            out.append(0)
        elif low_is_bad:
            out.append(2 if x < bad else 1 if x >= good else 0)
        else:
            out.append(2 if x >= bad else 1 if x <= good else 0)
    return out


def pattern(v: list[int]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


def unpack(p: int) -> list[int]:
    return [p // 3**i % 3 for i in range(len(LABELLERS))]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray]:
    """(share of bad documents, P(vote | class) [labeller, class good/bad, vote]) from pattern counts."""
    v = np.array([unpack(int(p)) for p in patterns]).reshape(-1, len(LABELLERS))
    bad = np.where((v == 2).sum(1) > 0, 0.9, 0.1)  # start: any bad vote is a hint
    for _ in range(rounds):
        w = np.stack([(1 - bad) * counts, bad * counts])
        prior = (w[1].sum() + 1) / (w.sum() + 20)
        p = np.stack([[[(w[c][v[:, i] == x].sum() + 0.5) / (w[c].sum() + 1.5) for x in range(3)] for c in (0, 1)] for i in range(len(LABELLERS))])
        bad = posterior(v, prior, p)
    return float(prior), p


def posterior(v: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    """P(bad | votes); an abstention says nothing."""
    log = np.log([[1 - prior], [prior]]) + sum(np.where(v[:, i] == 0, 0.0, np.log(p[i][:, v[:, i]] / (1 - p[i][:, :1]))) for i in range(len(LABELLERS)))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


_DIGITS, _UPPERS, _LOWERS = re.compile(rb"[0-9]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+")


def _shape(word: bytes) -> int:
    return zlib.crc32(_LOWERS.sub(b"a", _UPPERS.sub(b"A", _DIGITS.sub(b"0", word)))) % DIMENSIONS


def features(stats: dict[str, float], counts: Counter, n: int, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes, and each statistic's bin."""
    if not n:
        return np.array([zlib.crc32(b"empty") % DIMENSIONS]), np.ones(1)
    at = np.fromiter(map(memo.__getitem__, counts), np.int64, len(counts))
    shapes, inverse = np.unique(at, return_inverse=True)
    share = np.sqrt(np.bincount(inverse, weights=np.fromiter(counts.values(), np.float64, len(counts))) / n)
    bins = [zlib.crc32(f"{k}:{min(int(x * 20), 20)}".encode()) % DIMENSIONS for k, x in stats.items()]
    return np.concatenate([shapes, bins]), np.concatenate([share, np.ones(len(bins))])


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 12, rate: float = 0.3) -> np.ndarray:
    """Logistic regression on soft labels by Adagrad; weight [0] of the extra slot is the bias."""
    w, g = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-6)
    order = np.random.default_rng(7)
    weight = np.where(target > 0.5, 0.5 / max(target.mean(), 0.02), 1.0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            z = w[at] @ x + w[-1]
            d = (1 / (1 + np.exp(-z)) - target[i]) * weight[i]
            step = d * x
            np.add.at(g, at, step * step)
            w[at] -= rate * step / np.sqrt(g[at])
            g[-1] += d * d
            w[-1] -= rate * d / np.sqrt(g[-1])
    return w


def _each(documents: DataFrame, schema: str, names: list[str], make):
    """Map whole texts: ``make(memo)`` gives a function of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make(Memo(_shape, 200_000))
        for batch in batches:
            got = [one(t) for t in batch.column("_tw_text").to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "_tw_text"]
            kept = [x for x in batch.schema.names if x != "_tw_text"]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([g[i] for g in got], pa.int64() if i == 1 else pa.float64()) for i in range(len(names)))], names=[*kept, *names])

    return map_arrow(documents, run, schema)


def fit(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float, np.ndarray]:
    """(scorer weights, prior, labeller accuracies)."""
    d = documents.select(as_bytes().alias("_tw_text"))
    counted = _each(d, "score double, pattern bigint", ["score", "pattern"], lambda memo: lambda t: (0.0, pattern(votes(statistics(t)[0]))))
    seen = counted.groupBy("pattern").count().collect()  # at most 3^m rows
    if not seen:
        return np.zeros(DIMENSIONS + 1), 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)
    prior, p = expectation_maximisation(np.array([r["pattern"] for r in seen]), np.array([r["count"] for r in seen], float))
    share = min(1.0, train_rows / sum(r["count"] for r in seen))
    # by hash, alike rows once, in the order of the hashes: the same model however the rows are dealt out
    chosen = documents.select(F.xxhash64("doc_id", "text").alias("_tw_hash"), as_bytes().alias("text")).where(F.pmod("_tw_hash", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).dropDuplicates(["_tw_hash"])
    sample = map_arrow(chosen, _features_of, "hash bigint, pattern bigint, slots array<bigint>, shares array<double>").orderBy("hash").limit(2 * train_rows).collect()
    v = np.array([unpack(r["pattern"]) for r in sample]).reshape(-1, len(LABELLERS))
    return train([(np.array(r["slots"], np.int64), np.array(r["shares"])) for r in sample], posterior(v, prior, p)), prior, p


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Memo(_shape, 200_000)
    for batch in batches:
        got = []
        for text in batch.column("text").to_pylist():
            stats, counts, n = statistics(text)
            got.append((pattern(votes(stats)), *(x.tolist() for x in features(stats, counts, n, memo))))
        columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())))]
        yield pa.RecordBatch.from_arrays([batch.column("_tw_hash"), *columns], names=["hash", "pattern", "slots", "shares"])


def score(documents: DataFrame, model: tuple[np.ndarray, float, np.ndarray], prefix: str = "") -> DataFrame:
    """``documents`` (its columns, each once) with <prefix>quality_score (1 good), <prefix>votes and <prefix>posterior (weak label, 1 good)."""
    weights, prior, p = model

    def make(memo):
        def one(text: bytes):
            stats, counts, n = statistics(text)
            v = votes(stats)
            at, x = features(stats, counts, n, memo)
            z = float(np.clip(weights[at] @ x + weights[-1], -50, 50)) if n else float(np.log(prior / (1 - prior)))
            return 1 / (1 + np.exp(z)), pattern(v), 1 - float(posterior(np.array([v]), prior, p)[0])

        return one

    names = [f"{prefix}quality_score", f"{prefix}votes", f"{prefix}posterior"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return _each(documents.withColumn("_tw_text", as_bytes()), f"{schema}, {names[0]} double, {names[1]} bigint, {names[2]} double", names, make)


def op8(documents: DataFrame) -> DataFrame:
    model = fit(documents)
    return score(documents.select("doc_id", "text"), model).select("doc_id", "quality_score", "posterior", "votes", (F.col("quality_score") >= 0.5).cast("int").alias("keep"))


def keep_good(documents: DataFrame) -> DataFrame:
    """Documents that the scorer does not reject, unchanged."""
    model = fit(documents)
    return score(documents, model, "_tw_").where("_tw_quality_score >= 0.5").select(documents.columns)
