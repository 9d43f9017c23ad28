"""Best-fit packing of tokenised documents with a swap-based local search.

Documents are cut into pieces of at most ``capacity`` tokens; pieces (ids and lengths only, no text) are dealt by hash
into shards of about ``shard_items`` pieces. A shard is packed by best-fit decreasing, then improved: pieces of the
emptiest bins are moved, or exchanged one for one or two for one with pieces of fuller underfull bins, whenever that
raises the sum of squared fills, until the bins empty or no exchange helps.

Null text is empty (only the closing id 0); repeated rows are packed apart; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import functools
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_bytes, map_arrow, materialise, parts_for

CAPACITY = 2048
#: Pieces a shard; its bins waste less than one sequence.
SHARD_ITEMS = 40_000

#: Marks that may close a chunk; no apostrophe, which the tokenizer joins with letters.
CLOSING = ".,;:!?#%&*$|"

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Texts -> their ids as little-endian uint32 bytes.

    The tokenizer drops white space and never looks across it, so space-separated chunks are encoded once and kept. It
    also splits letters from marks and lower-cases, so a chunk of letters and closing marks is put together from its
    lower-cased letters and its marks. A block's chunks are found and told apart in numpy, by a 64-bit hash; only its
    different chunks are looked up. The store empties itself at ``limit`` entries."""

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.known: dict[bytes, bytes] = {}
        self.marks = Memo(self.whole, 10_000)
        self.powers = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))

    def whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, cores: list[bytes]) -> None:
        """Lower-cased words of letters only: each is one pre-token, which the model takes by its bytes' symbols."""
        tokenize, known = self.tokenizer.model.tokenize, self.known
        for core in cores:
            symbols = core.decode("latin-1")
            ids = [t.id for t in tokenize(symbols if core.isascii() else symbols.translate(_SYMBOLS))]
            known[core] = struct.pack(f"<{len(ids)}I", *ids)

    def prepare(self, fresh: list[bytes]) -> None:
        known = self.known
        split: list[tuple[bytes, bytes, str]] = []
        new = []
        for raw in fresh:
            if raw.isalpha() and raw.islower():  # ASCII letters
                new.append(raw)
                continue
            chunk = raw.decode()
            letters = chunk.rstrip(CLOSING)
            core = letters.lower() if letters.isascii() else unicodedata.normalize("NFC", letters).lower()
            if core.isalpha() and (letters.isascii() or _SPECIAL.isdisjoint(letters)):
                split.append((raw, core.encode(), chunk[len(letters) :]))
            else:
                known[raw] = self.whole(chunk)
        new = list({core for _, core, _ in split if core not in known}.union(new))
        if new:
            self.learn(new)
        known.update((raw, known[core] + self.marks[mark] if mark else known[core]) for raw, core, mark in split if raw != core)

    def _hashes(self, letters: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A hash of each chunk; ``letters``: the chunks' bytes without what separates them."""
        place = np.arange(len(letters)) - np.repeat(begins, lengths)
        weight = self.powers[place & 0xFFFF]
        if int(lengths.max()) > len(self.powers):
            weight += (place >> 16).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * weight, begins)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        data = b"\n".join([*texts, b""])
        if not any(x in data for x in _CASED):
            data = data.lower()
        b = np.frombuffer(data, np.uint8)
        gap = (b == 32) | (b == 10)
        # a comma or full stop at the end of a chunk stands by itself, unless it belongs to a run of marks, which is one pre-token
        mark = (b == 44) | (b == 46)
        mark[1:] &= _LETTERS[b[:-1]]
        mark[:-1] &= gap[1:]
        mark[0] = False
        breaks = gap | mark
        starts = np.flatnonzero(~gap & (mark | np.append(True, gap[:-1])))
        ends = np.flatnonzero(~gap & np.append(breaks[1:], True)) + 1
        if not len(starts):
            return [b""] * len(texts)
        lengths = ends - starts
        begins = np.cumsum(lengths) - lengths
        _, first, inverse = np.unique(self._hashes(b[~gap], begins, lengths), return_index=True, return_inverse=True)
        words = [data[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())]
        ids = list(map(self.known.get, words))
        if None in ids:
            fresh = [w for w, v in zip(words, ids) if v is None]
            if len(self.known) + len(fresh) > self.limit:
                self.known.clear()
                fresh = words
            self.prepare(fresh)
            ids = list(map(self.known.__getitem__, words))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, at = np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(size) - size)[inverse]
        n = size[inverse]
        total = np.cumsum(n)
        out = table[np.repeat(at - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        cuts = np.append(0, total)[cuts]
        return [out[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


#: Symbols of bytes in byte-level vocabularies: printable Latin-1 characters stand for themselves, the others follow from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SYMBOLS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
#: Letters whose lower case depends on their neighbours or grows.
_SPECIAL = frozenset("Σİ")
#: Bytes of a text whose ASCII letters keep their case: perhaps a special token, or marks that compose with a letter.
_CASED = (b"<|", b"\xcc", b"\xcd")
#: Bytes of ASCII letters and digits.
_LETTERS = np.array([c < 128 and chr(c).isalnum() for c in range(256)])


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    """A worker's encoder, kept from task to task."""
    return ChunkEncoder(path)


def encode_blocks(encode: ChunkEncoder, texts: list[bytes], size: int = 2_000_000) -> Iterator[bytes]:
    """Encode so much text at a time that its chunks fit in memory."""
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= size:
            yield from encode(held)
            held, total = [], 0
    if held:
        yield from encode(held)


def pieces(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: where it starts in its document's ids, its length and the CRC-32 of its ids."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode_blocks(encode, batch.column("text").to_pylist())):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(start)
                    out["length"].append(min(capacity, n - start))
                    out["ids_crc32"].append(zlib.crc32(ids[4 * start : 4 * (start + capacity)]))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return map_arrow(documents.select("doc_id", as_bytes().alias("text")), cut, PIECES)


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin of each item; ``sizes`` descend. The fullest bin that still has room takes the item."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []  # sorted distinct free sizes that have bins
    out, bins = [], 0
    for size in sizes:
        i = bisect.bisect_left(free, size)
        if i < len(free):
            at = free[i]
            b = room[at].pop()
            if not room[at]:
                free.pop(i)
        else:
            b, at, bins = bins, capacity, bins + 1
        left = at - size
        if left:
            if not room[left]:
                bisect.insort(free, left)
            room[left].append(b)
        out.append(b)
    return out


def improve(sizes: np.ndarray, bins: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Local search over underfull bins: move, one-for-one, then two-for-one, each only if the squared fill grows. It ends when
    no bin has an exchange left, or when there are no more bins than the tokens fill."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    of: list[list[int]] = [[] for _ in fill]
    loose = np.flatnonzero(fill[bins] < capacity)
    for i in loose:
        of[bins[i]].append(int(i))
    tried: set[int] = set()  # bins without an exchange in this pass, unless they changed since; a pass without any is the last
    again = False
    least = -(-int(sizes.sum()) // capacity)

    def shift(item: int, to: int) -> None:
        of[bins[item]].remove(item)
        fill[bins[item]] -= sizes[item]
        bins[item] = to
        of[to].append(item)
        fill[to] += sizes[item]
        tried.discard(to)

    open_bins = np.flatnonzero((fill < capacity) & (fill > 0))
    while len(open_bins) > 1 and int((fill > 0).sum()) > least:
        live = [b for b in open_bins.tolist() if b not in tried and 0 < fill[b] < capacity]
        if not live:
            if not again:
                break
            tried, again = set(), False
            continue
        source = min(live, key=lambda b: (fill[b], b))
        changed = False
        for item in sorted(of[source], key=lambda i: -sizes[i]):
            if bins[item] != source:
                continue
            size = int(sizes[item])
            room = capacity - fill[open_bins]
            room[open_bins == source] = -1
            fits = np.flatnonzero((room >= size) & (fill[open_bins] > 0) & (fill[open_bins] + size > fill[source]))
            if len(fits):  # a move to the fullest bin with room
                shift(item, int(open_bins[fits[np.argmin(room[fits])]]))
                changed = True
                continue
            there = loose[bins[loose] != source]
            mine, free = sizes[there], capacity - fill[bins[there]]
            swap = np.flatnonzero((mine < size) & (mine + free >= size) & (fill[bins[there]] + size - mine > fill[source]))
            if len(swap):  # one for one: the pair that leaves the least room
                other = int(there[swap[np.argmin((mine + free - size)[swap])]])
                to = int(bins[other])
                shift(other, source)
                shift(item, to)
                changed = True
                continue
            for second in of[source]:  # two for one
                if second == item:
                    continue
                both = size + int(sizes[second])
                swap = np.flatnonzero((mine < both) & (mine + free >= both) & (fill[bins[there]] + both - mine > fill[source]))
                if len(swap):
                    other = int(there[swap[np.argmin((mine + free - both)[swap])]])
                    to = int(bins[other])
                    shift(item, to)
                    shift(second, to)
                    shift(other, source)
                    changed = True
                    break
        again |= changed
        if not changed:
            tried.add(source)
        open_bins = open_bins[fill[open_bins] > 0]
    return bins


def pack_shard(shard: int, rows, capacity: int = CAPACITY):
    rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    sizes = rows["length"].to_numpy(np.int64)
    bins = improve(sizes, np.array(best_fit(sizes.tolist(), capacity), np.int64), capacity)
    order = np.lexsort((np.arange(len(bins)), bins))
    before = np.cumsum(sizes[order]) - sizes[order]
    first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
    offset = np.empty(len(bins), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    return rows.assign(sequence_id=(int(shard) << 32) + bins, offset=offset)


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every piece with the sequence it goes to and its place there."""
    cut = materialise(pieces(documents, tokenizer, capacity), "pieces")
    shards = parts_for(cut.count(), shard_items)
    names = [c.split(" ")[0] for c in PIECES.split(", ")]

    def packed(key, rows):
        return pack_shard(key[0], rows[names], capacity)

    return cut.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(shards))).groupBy("_shard").applyInPandas(packed, PACKED)


def op6(documents: DataFrame) -> DataFrame:
    return pack(documents)
