"""How often a text is read for its fingerprint."""

import pyarrow as pa

from textweir.llm import fingerprints


def test_a_text_is_read_once(monkeypatch):
    """Its own row and that of the text before share its tree; the edited text has the only other one."""
    trees, tree = [], fingerprints.tree
    monkeypatch.setattr(fingerprints, "tree", lambda data, *a: (trees.append(data), tree(data, *a))[1])
    texts = [f"{'word ' * i}\nline {i}" for i in range(20)]
    batch = pa.RecordBatch.from_pydict({"_part": [0] * 20, "_ahead": [False] * 19 + [True], "doc_id": list(range(20)), "text": texts})
    (out,) = fingerprints._chain(iter([batch]))
    assert len(trees) == 20 + 19 and out.num_rows == 19
    assert out.column("fingerprint").to_pylist() == [fingerprints.fingerprint(tree(t.encode())) for t in texts[:-1]]
    assert out.column("near_next").to_pylist() == [fingerprints.likeness(*(fingerprints.leaves(tree(t.encode())) for t in pair)) for pair in zip(texts, texts[1:])]
