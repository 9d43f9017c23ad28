"""Edit-aware token counts with a segment tree of pre-tokens per document.

A byte-level BPE encodes each pre-token by itself, so a document's count is the sum over its pre-tokens. The tree keeps
their lengths and counts in blocks, and sums of lengths and counts over the blocks. An edit re-splits the text from the
last pre-token that its first character can influence (pre-tokens look at most ``CONTEXT`` characters past their end)
up to the first old boundary behind the edit where old and new splits meet again; only those pre-tokens are encoded,
and only their blocks' path of sums is updated.

``token_trees`` keeps a tree per document in a table, ``edit_trees`` takes trees with their edits (a column, or a table that
``with_edits`` joins) and gives the trees after them: old leaves are neither split nor encoded again.

Strings of special tokens are ordinary text. Null text is empty and has no tokens; repeated rows are counted apart;
edits outside the text are clipped to it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_arrow, materialise

#: How the tokenizer splits text into pre-tokens (fixed value of the public vocabulary).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters past its end that decide where a pre-token ends.
CONTEXT = 2
#: Pre-tokens a block.
BLOCK = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def counter(path: str):
    """pre-tokens -> their numbers of tokens; a worker keeps it from task to task."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    memo = Memo(lambda w: len(tokenizer.encode(w, add_special_tokens=False).ids), limit=500_000)

    def counts(found: list[str]) -> list[int]:
        return list(map(memo.__getitem__, found))

    return counts


def pack(numbers: Iterable[int]) -> bytes:
    return array("q", numbers).tobytes()


def unpack(packed: bytes) -> list[int]:
    return array("q", packed).tolist()


class TokenTree:
    """Leaves are pre-tokens (characters, tokens) in blocks; ``sums`` is a binary tree of (characters, tokens) over blocks."""

    def __init__(self, text: str, counts):
        self.text, self.counts = text, counts
        found = SPLIT.findall(text)
        lengths, tokens = list(map(len, found)), counts(found)
        self.blocks = [(lengths[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(found), BLOCK)]
        self._grow()

    @classmethod
    def kept(cls, row: dict, counts) -> TokenTree:
        """The tree of a table's row."""
        tree = cls.__new__(cls)
        tree.text, tree.counts = row["text"], counts
        lengths, tokens, at, tree.blocks = unpack(row["lengths"]), unpack(row["tokens"]), 0, []
        for n in unpack(row["blocks"]):
            tree.blocks.append((lengths[at : at + n], tokens[at : at + n]))
            at += n
        tree.sums = list(zip(unpack(row["sum_chars"]), unpack(row["sum_tokens"])))
        tree.size = len(tree.sums) // 2
        return tree

    def row(self) -> tuple:
        """The tree as values of the columns TREE."""
        flat = lambda i: pack(chain.from_iterable(block[i] for block in self.blocks))
        return self.text, len(self.text), self.tokens, flat(0), flat(1), pack(len(a) for a, _ in self.blocks), pack(a for a, _ in self.sums), pack(b for _, b in self.sums)

    def _grow(self) -> None:
        """The sums over all blocks, from the leaves' sums up; done when the number of blocks changes."""
        self.size = 1 << max(0, len(self.blocks) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.size)
        for i, (a, b) in enumerate(self.blocks):
            self.sums[self.size + i] = (sum(a), sum(b))
        for i in range(self.size - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a + c, b + d)

    @property
    def tokens(self) -> int:
        return self.sums[1][1] if self.blocks else 0

    def _block_at(self, position: int) -> tuple[int, int]:
        """(block, characters before it) of the block that holds ``position``, the last one at the end."""
        i, before = 1, 0
        while i < self.size:
            left = self.sums[2 * i][0]
            if before + left > position or not self.sums[2 * i + 1][0]:
                i = 2 * i
            else:
                before, i = before + left, 2 * i + 1
        return i - self.size, before

    def edit(self, start: int, delete: int, insert: str) -> int:
        """Replace ``delete`` characters from ``start``; returns how many characters were split and encoded again."""
        start = max(0, min(start, len(self.text)))
        stop = min(len(self.text), start + max(0, delete))
        new = self.text[:start] + insert + self.text[stop:]
        shift = len(new) - len(self.text)
        if not self.blocks:
            self.__init__(new, self.counts)
            return len(new)
        first, at = self._block_at(max(0, start - CONTEXT - 1))
        lengths, leaf = self.blocks[first][0], 0
        while leaf < len(lengths) - 1 and at + lengths[leaf] + CONTEXT < start:
            at += lengths[leaf]
            leaf += 1
        block, index, end, found, begin = first, leaf, at, [], at  # (block, index): first old leaf that ends past ``end``
        position = begin
        for m in SPLIT.finditer(new, begin):
            if position - shift >= stop and position > begin:
                while block < len(self.blocks) and end < position - shift:
                    if index == len(self.blocks[block][0]):
                        block, index = block + 1, 0
                        continue
                    end += self.blocks[block][0][index]
                    index += 1
                if end == position - shift:
                    break
            found.append(m.group())
            position = m.end()
        else:
            block, index = len(self.blocks) - 1, len(self.blocks[-1][0])
        if block == len(self.blocks):
            block, index = block - 1, len(self.blocks[-1][0])
        fresh = self.counts(found)
        a = self.blocks[first][0][:leaf] + list(map(len, found)) + self.blocks[block][0][index:]
        b = self.blocks[first][1][:leaf] + fresh + self.blocks[block][1][index:]
        self.text = new
        if a and block == first and len(a) <= 2 * BLOCK:
            self.blocks[first] = (a, b)
            i = self.size + first
            self.sums[i] = (sum(a), sum(b))
            while i > 1:
                i //= 2
                self._add(i)
        else:
            self.blocks[first : block + 1] = [(a[i : i + BLOCK], b[i : i + BLOCK]) for i in range(0, len(a), BLOCK)]
            self._grow()
        return position - begin


#: The lists are packed, eight bytes a number: lists of Arrow cost more than the tokenizer to read and write.
TREE = "text string, n_chars bigint, n_tokens bigint, lengths binary, tokens binary, blocks binary, sum_chars binary, sum_tokens binary"
_FIELDS = [(c.split(" ")[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split(" ")[1]]) for c in TREE.split(", ")]
EDITS = "array<struct<start:int,delete:int,insert:string>>"


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)]


def token_trees(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and the columns TREE: text, its numbers of characters and tokens, the leaves' lengths and tokens, leaves a block, and
    the sums of the binary tree over the blocks (root at 1)."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            rows = [TokenTree(text, counts).row() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_columns(rows)], names=["doc_id", *(n for n, _ in _FIELDS)])

    return map_arrow(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, f"doc_id bigint, {TREE}")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with the column ``edits`` from a table (doc_id, ordinal, start, delete, insert), in the order of ordinal; a
    document without edits keeps its tree, null ids have none."""
    of = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "delete", "insert"))).alias("e"))
    of = of.select("doc_id", F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["delete"].alias("delete"), x["insert"].alias("insert"))).cast(EDITS).alias("edits"))
    return trees.join(of, "doc_id", "left")


COUNTS = ["n_chars", "n_tokens", "n_edited_chars", "n_edited_tokens", "n_reencoded"]


def edit_trees(trees: DataFrame, tokenizer: str | None = None, counts_only: bool = False) -> DataFrame:
    """Trees (doc_id, TREE) after their ``edits``, applied one after another; with ``counts_only`` doc_id and COUNTS: the numbers
    before and after, and the characters that were split and encoded again."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                tree = TokenTree.kept(r, counts)
                again = sum(tree.edit(e["start"] or 0, e["delete"] or 0, e["insert"] or "") for e in r["edits"] or ())
                rows.append((r["n_chars"], r["n_tokens"], len(tree.text), tree.tokens, again) if counts_only else tree.row())
            if counts_only:
                out, names = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))], COUNTS
            else:
                out, names = _columns(rows), [n for n, _ in _FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], names=["doc_id", *names])

    return map_arrow(trees.select("doc_id", *(n for n, _ in _FIELDS), "edits"), run, "doc_id bigint, " + (", ".join(f"{n} bigint" for n in COUNTS) if counts_only else TREE))


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits that ``op9`` counts: from the middle on, 40 code points become the text's first 24; then the first 10 go."""
    n = len(text)
    return [(n // 2, 40, text[:24]), (0, 10, "")]


def sample_edits_of_trees():
    """``sample_edits`` as a column over trees."""
    first = F.struct((F.col("n_chars") / 2).cast("int").alias("start"), F.lit(40).alias("delete"), F.substring("text", 1, 24).alias("insert"))
    return F.array(first, F.struct(F.lit(0).alias("start"), F.lit(10).alias("delete"), F.lit("").alias("insert"))).cast(EDITS)


def token_counts(documents: DataFrame, tokenizer: str | None = None, edits=sample_edits_of_trees) -> DataFrame:
    """doc_id and COUNTS of every document: its tree is kept in a table, then edited from there (``edits()``: a column over trees)."""
    kept = materialise(token_trees(documents, tokenizer), "trees")
    return edit_trees(kept.withColumn("edits", edits()), tokenizer, counts_only=True)


def op9(documents: DataFrame) -> DataFrame:
    return token_counts(documents)
