"""What the near-duplicate join does per row: joins by node, pairs that are verified."""

import random
import re

import pyarrow as pa
import pytest

from textweir.llm import ngram_jaccard


def _made(spark, since: int, name: str, desc: str) -> tuple[int, int]:
    """Rows that the plan nodes of executions after ``since`` have made, and the last execution."""
    store, seen, rows, last = spark._jsparkSession.sharedState().statusStore(), set(), 0, since
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for i in range(store.executionsList().size()):
        e = store.executionsList().apply(i).executionId()
        last = max(last, e)
        if e <= since:
            continue
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for x in (node.metrics().apply(j) for j in range(node.metrics().size())):
                value = values.get(x.accumulatorId())
                if x.name() == "number of output rows" and re.search(name, node.name()) and re.search(desc, node.desc()) and x.accumulatorId() not in seen and value.isDefined():
                    seen.add(x.accumulatorId())
                    rows += int(value.get().replace(",", ""))
    return rows, last


def test_labels_are_joined_to_nodes_not_to_their_large_keys(spark, monkeypatch):
    """80 near copies of one text and 3 of another one: every node has some dozens of large keys."""
    monkeypatch.setattr(ngram_jaccard, "SMALL_KEY", 4)
    rng, rows = random.Random(3), []
    for group, size in ((0, 80), (1000, 3)):
        words = [f"w{group}x{i}" for i in range(300)]
        for i in range(size):
            own = list(words)
            own[rng.randrange(300)] = f"own{group + i}"
            rows.append((group + i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    since = _made(spark, -1, "Join", "x^")[1]
    got = {r.doc_id: r.component_id for r in ngram_jaccard.op3(docs).collect()}
    assert got == {i: i // 1000 * 1000 for i, _ in rows}
    assert _made(spark, since, "Join", r"node#.*LeftOuter")[0] <= 6 * len(rows)


def test_long_texts_that_share_a_passage_are_not_verified(spark, monkeypatch):
    """The sketch's distance ends at 512 and so tells no sets of more than some 2,300 shingles; the number of shared keys does."""
    rng, seen = random.Random(5), []
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(300)]
    rows = [(i, " ".join([*(word() for _ in range(1500)), *passage, *(word() for _ in range(1500))])) for i in range(6)]
    rows += [(10 + i, t + " end" * i) for i, (_, t) in enumerate(rows[:2], 1)]
    verified = ngram_jaccard._verified
    monkeypatch.setattr(ngram_jaccard, "_verified", lambda pairs, *a: (seen.append(pairs.select("a", "b").distinct().count()), verified(pairs, *a))[1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in ngram_jaccard.op3(docs).collect()} == {i: i for i in range(6)} | {11: 0, 12: 1}
    assert sum(seen) == 2


@pytest.mark.parametrize("similarity", [60, 80, 95])
def test_linked_sets_share_as_many_keys_as_is_asked(spark, similarity):
    import numpy as np

    rng = np.random.default_rng(similarity)
    bands = ngram_jaccard.size_bands(similarity)
    at_limit = 0
    for n in [5, 6, 9, 17, 40, 130, 700, 3000] * 8:
        total = rng.integers(0, 2**64, 2 * n, np.uint64, endpoint=False)
        common = int(rng.integers(n * similarity // 100, n + 1))
        more = int(rng.integers(0, n - common + 1))
        x, y = np.unique(total[:n]), np.unique(np.concatenate([total[:common], total[n : n + more]]))
        if 100 * common < similarity * (n + more):
            continue
        found = [ngram_jaccard.part_keys(s, bands, similarity) for s in (x, y)]
        keys = [set(np.concatenate([np.zeros(0, np.uint64), *k]).tolist()) for k, _ in found]
        band = np.searchsorted(bands, [max(len(x), len(y))])
        allowed = np.array([ngram_jaccard.most_apart(2 * bands[band[0]], similarity)])
        parts = max(int(ngram_jaccard._parts(pa.array([s], pa.list_(pa.int32())), band, allowed)[0]) for _, s in found)
        least = parts - ngram_jaccard.most_apart(len(x) + len(y), similarity)
        assert len(keys[0] & keys[1]) >= least
        at_limit += least > 0
    assert at_limit > 10
