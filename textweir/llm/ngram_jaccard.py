"""Exact n-gram Jaccard join by parity sketches.

A document is the set of hashes of its five-word shingles. A *parity sketch* XORs hashed tokens into fixed bits or
words; the Hamming distance of two sketches never exceeds the sets' symmetric difference d, and similarity s bounds
d <= (n + m)(1 - s) / (1 + s).

* Candidates: per size band the shingle space is cut into P parts, more than the largest allowed d. A part's sketch is
  the XOR of its hashes; at most d parts differ, so two linked sets agree on some non-empty part (pigeonhole). Sets
  with fewer non-empty parts than that also emit single shingles, so no link is missed.
* Keys travel as packed arrays by bucket and are matched by sorting in numpy. Equal sets are one node. A key with few
  nodes gives its pairs. A key with many nodes is *large*: nodes that keep enough small keys to be found there leave it
  (same pigeonhole), and the rest are compared by 1024-bit sketches, only across components found so far, in blocks.
  Nodes that crowd a key inside one map block are stashed outside the key's bucket, so no task gathers a hot key.
* A pair's shared small keys are counted: linked sets share at least so many as the larger number of parts exceeds their
  largest allowed d, less the large keys that they may share. Sets of any size are told apart by this; the sketch, whose
  distance ends at 512, tells only those of up to some 2,300 shingles.
* Pairs that share enough keys and are within the Hamming bound are verified on the whole sets; links give connected
  components.

Documents with the same doc_id are one node's rows and share a component; null ids take part as the smallest id; null,
empty and blank texts have no shingles and no links; other columns are ignored; an empty table gives no rows. Sets are
64-bit hashes of shingles and documents, so two different ones coincide with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, map_arrow, materialise, reclaim, row_hash, shuffle_parts, without
from .shingles import components, mix, shingle_set, word_memo

SIMILARITY = 80  # per cent
SHINGLE = 5
#: 64-bit words of the comparison sketch.
SKETCH = 16
#: A key with more nodes is large.
SMALL_KEY = 32
#: Nodes of one key in one map block that go to the stash.
CROWD = 64
#: Text bytes of a map block; bytes of estimated input a bucket of keys, and the fewest bits of a bucket's number, so that a
#: block's keys travel in rows of some kilobytes; nodes of a block of a large key; entries of a row of the stash.
BLOCK_BYTES, BUCKET_BYTES, BUCKET_BITS, BLOCK_NODES, STASH = 6_000_000, 4_000_000, 12, 8192, 4096
#: Pairs of one hub that are compared in one place.
HUB_PAIRS = 500
#: Bytes of estimated input whose keys (about twice as many bytes) are matched in one task. A pair goes out once a task.
PARTITION_BYTES = 32_000_000
#: Rows of whole texts in an Arrow batch, sets that a worker keeps, pairs that it hands on at once, pairs that it holds to drop
#: repeated ones.
SET_ROWS, KEPT_SETS, PAIRS_AT_ONCE, PAIRS_HELD = 100, 32, 100_000, 3_000_000
NULL_ID = -(2**63)
#: Nodes (16 bytes each) that may be broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000

_SCHEMA = "kind int, bucket bigint, doc_id bigint, row bigint, node bigint, n bigint, surplus array<int>, sketch binary, keys binary, nodes binary"
_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("surplus", pa.list_(pa.int32())), ("sketch", pa.binary()), ("keys", pa.binary()), ("nodes", pa.binary())])
NODE, PAIRS, LARGE, KEYS = 0, 1, 2, 3


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _ARROW], schema=_ARROW)


def size_bands(similarity: int) -> list[int]:
    """Upper set size of each band; a pair's band is that of its larger set."""
    out = [4]
    while out[-1] < 2**40 and len(out) < 200:
        out.append(max(out[-1] + 1, out[-1] * 100 // similarity))
    return out


def most_apart(total: int, similarity: int) -> int:
    """Largest symmetric difference of two linked sets whose sizes sum to ``total``."""
    return (100 - similarity) * total // (100 + similarity)


def parts_of(high: int, similarity: int) -> int:
    allowed = most_apart(2 * high, similarity)
    return -(-115 * (allowed + 1) // 100) + 2


def sketch_of(tokens: np.ndarray) -> bytes:
    """1024 parities: each token flips one bit."""
    bits = np.bincount((mix(tokens) >> np.uint64(54)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def part_keys(tokens: np.ndarray, bands: list[int], similarity: int) -> tuple[list[np.ndarray], list[int]]:
    """Keys of a sorted set in each band where its partner may be the larger or the equal, and (band, surplus) pairs:
    how many keys the set can lose and still be found."""
    n = len(tokens)
    first = int(np.searchsorted(bands, n))
    last = int(np.searchsorted(bands, n * 100 // similarity))
    keys, surplus = [], []
    for j in range(first, last + 1):
        allowed = most_apart(2 * bands[j], similarity)
        if not allowed:
            continue
        part = ((tokens >> np.uint64(32)) * np.uint64(parts_of(bands[j], similarity))) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        xor = np.bitwise_xor.reduceat(tokens, starts)
        salt = np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)
        own = (mix(mix(xor + salt) + part[starts]) & ~np.uint64(255)) | np.uint64(j)
        surplus += [j, len(own) - allowed - 1]
        if len(own) <= allowed:  # too few parts for the pigeonhole: single shingles find such sets
            own = np.concatenate([own, (mix(mix(tokens) + ~salt) & ~np.uint64(255)) | np.uint64(j)])
        keys.append(own)
    return keys, surplus


def _packed(key: np.ndarray) -> bytes:
    """Keys of one bucket, five bytes each: 32 bits below the bucket's and the band. Keys that coincide in these only propose more."""
    return ((key >> np.uint64(64 - BUCKET_BITS - 32)) & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (key & np.uint64(255)).astype(np.uint8).tobytes()


def _unpacked(bucket: int, packed: bytes) -> np.ndarray:
    """The keys again, told apart across buckets by the bucket's bits (the lower ones where it has more than BUCKET_BITS)."""
    n = len(packed) // 5
    low = np.frombuffer(packed, "<u4", n).astype(np.uint64) << np.uint64(8) | np.frombuffer(packed, np.uint8, n, 4 * n)
    return low | np.uint64(bucket) << np.uint64(40)


def _shortened(key: np.ndarray, bucket_bits: int) -> np.ndarray:
    """Whole keys as ``_unpacked`` gives them."""
    low = ((key >> np.uint64(64 - BUCKET_BITS - 32)) & np.uint64(0xFFFFFFFF)) << np.uint64(8) | key & np.uint64(255)
    return low | (key >> np.uint64(64 - bucket_bits)) << np.uint64(40)


def _signed(a: np.ndarray) -> list[int]:
    return a.view(np.int64).tolist()


def _map_blocks(bucket_bits: int, similarity: int, k: int):
    bands = size_bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for table in blocks(batches, BLOCK_BYTES):
            seen: dict[int, None] = {}
            ids, nodes, sizes, room, sketches, keys, own = table.column("doc_id").to_pylist(), [], [], [], [], [], []
            for text in table.column("text").to_pylist():
                s = shingle_set(text, memo, k)
                node = (xxhash.xxh3_64_intdigest(s.tobytes()) or 1) if len(s) else 0
                nodes.append(node)
                sizes.append(len(s))
                sketch, surplus = None, []
                if len(s) and node not in seen:
                    seen[node] = None
                    sketch = sketch_of(s)
                    found, surplus = part_keys(s, bands, similarity)
                    keys += found
                    own.append((node, sum(map(len, found))))
                sketches.append(sketch)
                room.append(surplus)
            at = np.array(nodes, np.uint64)
            yield _rows(kind=[NODE] * len(ids), bucket=(at % np.uint64(1 << 20)).astype(np.int64).tolist(), doc_id=ids, row=table.column("row").to_pylist(), node=_signed(at), n=sizes, surplus=room, sketch=sketches)
            if not keys:
                continue
            key = np.concatenate(keys)
            node = np.repeat(np.array([x for x, _ in own], np.uint64), [c for _, c in own])
            order = np.argsort(key, kind="stable")
            key, node = key[order], node[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(starts, len(key)))
            crowd = np.repeat(count > CROWD, count)
            if crowd.any():
                crowded = _shortened(key[crowd], bucket_bits)
                parts = [(crowded[i : i + STASH], node[crowd][i : i + STASH]) for i in range(0, int(crowd.sum()), STASH)]
                yield _rows(kind=[LARGE] * len(parts), bucket=[int(n[0] % np.uint64(1 << 20)) for _, n in parts], keys=[k.tobytes() for k, _ in parts], nodes=[n.tobytes() for _, n in parts])
                marks = key[starts[count > CROWD]]  # node 0 tells the bucket that the key is large
                key, node = np.concatenate([key[~crowd], marks]), np.concatenate([node[~crowd], np.zeros(len(marks), np.uint64)])
                order = np.argsort(key, kind="stable")
                key, node = key[order], node[order]
            bucket = (key >> np.uint64(64 - bucket_bits)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(starts[1:], len(key))
            yield _rows(kind=[KEYS] * len(starts), bucket=bucket[starts].tolist(), keys=[_packed(key[a:b]) for a, b in zip(starts, ends)], nodes=[node[a:b].tobytes() for a, b in zip(starts, ends)])

    return run


def _small_pairs(starts: np.ndarray, count: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = [], []
    for size in np.unique(count).tolist():
        at = starts[count == size][:, None] + np.arange(size)
        i, j = np.triu_indices(size, 1)
        a.append(node[at[:, i]].ravel())
        b.append(node[at[:, j]].ravel())
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


def _in_rows(kind: int, a: np.ndarray, b: np.ndarray, shared: np.ndarray | None = None) -> pa.RecordBatch:
    cuts = range(0, len(a), STASH)
    counts = {} if shared is None else {"sketch": [shared[i : i + STASH].tobytes() for i in cuts]}
    return _rows(kind=[kind] * len(cuts), keys=[a[i : i + STASH].tobytes() for i in cuts], nodes=[b[i : i + STASH].tobytes() for i in cuts], **counts)


def _once(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with the sum of its counts."""
    a, b, shared = (np.concatenate(x) for x in zip(*pairs))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[fresh], b[fresh], np.add.reduceat(shared[order], fresh)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by bucket: other rows pass; a bucket's keys become pairs of small keys and memberships of large ones.
    Two alike sets share nearly all their keys: of the buckets that a task has at hand each pair goes out once, with the
    number of keys that it shares there."""
    held, at = [], None
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        nonlocal size
        if not held:
            return
        key, node = np.concatenate([_unpacked(at, k) for k, _ in held]), np.concatenate([np.frombuffer(n, np.uint64) for _, n in held])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node = key[fresh], node[fresh]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(starts, len(key)))
        large = (count > SMALL_KEY) | (node[starts] == 0)
        a, b = _small_pairs(starts[~large & (count > 1)], count[~large & (count > 1)], node)
        if len(a):
            waiting.append((a, b, np.ones(len(a), np.int64)))
            size += len(a)
        keep = np.repeat(large, count) & (node != 0)
        if keep.any():
            yield _in_rows(LARGE, key[keep], node[keep])
        if size >= PAIRS_HELD:
            waiting[:] = [_once(waiting)]
            size = len(waiting[0][0])
            if size >= PAIRS_HELD // 2:
                yield _in_rows(PAIRS, *waiting.pop())
                size = 0

    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        if (kinds != KEYS).any():
            yield batch.filter(pa.array(kinds != KEYS))
        for r in batch.filter(pa.array(kinds == KEYS)).select(["bucket", "keys", "nodes"]).to_pylist():
            if r["bucket"] != at:
                yield from flush()
                held, at = [], r["bucket"]
            held.append((r["keys"], r["nodes"]))
    yield from flush()
    if waiting:
        yield _in_rows(PAIRS, *_once(waiting))


def _unpack(df: DataFrame, **names: str) -> DataFrame:
    """The packed numbers of the columns ``names.values()`` as columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names.values())):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in row], names=list(names))

    return map_arrow(df.select(*names.values()), run, ", ".join(f"{c} bigint" for c in names))


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _parts(surplus: pa.Array, band: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """How many parts each set has in ``band``; 0 where it has no keys there."""
    at, values = surplus.offsets.to_numpy()[:-1].astype(np.int64), surplus.values.to_numpy()
    size = np.diff(surplus.offsets.to_numpy())
    first = np.where(size > 0, values[np.minimum(at, max(len(values) - 1, 0))] if len(values) else 0, 0)
    there = (band >= first) & (2 * (band - first) < size)
    out = np.zeros(len(band), np.int64)
    out[there] = values[at[there] + 2 * (band[there] - first[there]) + 1] + allowed[there] + 1
    return out


def _share_enough(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b, shared) whose sizes and numbers of shared small keys allow a link. ``nodes`` has the columns n, surplus and
    lost, the number of large keys. Two keys of a set coincide about once in 2^20 sets, so two keys are allowed for that."""
    bands = np.array(size_bands(similarity), np.int64)
    apart_in = np.array([most_apart(2 * x, similarity) for x in bands.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb, shared, la, lb = (batch.column(c).to_numpy() for c in ("na", "nb", "shared", "la", "lb"))
            band = np.searchsorted(bands, np.maximum(na, nb))
            parts = np.maximum(*(_parts(batch.column(c), band, apart_in[band]) for c in ("ra", "rb")))
            least = parts - (100 - similarity) * (na + nb) // (100 + similarity) - np.minimum(la, lb) - 2
            keep = pa.array((shared >= least) & (100 * np.minimum(na, nb) >= similarity * np.maximum(na, nb)))
            yield batch.select(["a", "b"]).filter(keep)

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("surplus").alias(f"r{c}"), F.col("lost").alias(f"l{c}"))
    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a bigint, b bigint")


def _within_sketch(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link, and the sketches' distance (apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
                apart = _apart(_bits(batch.column("sa")), _bits(batch.column("sb")))
                keep = pa.array(apart * (100 + similarity) <= (100 - similarity) * n)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart)], names=["a", "b", "apart"]).filter(keep)

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a bigint, b bigint, apart bigint")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: int, k: int) -> DataFrame:
    """Pairs whose whole sets are similar enough: 100 * both >= similarity * either. Compressed texts travel, a third of the size
    of their sets; sets are made where they are compared, those of the last few nodes are kept.

    Of a pair, the end that is in fewer pairs travels with it to the other, the hub, whose text goes out once for every
    ``HUB_PAIRS`` of its pairs: a group that grows around one document costs what its members' texts do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        sets: dict[int, np.ndarray] = {}

        def set_of(node: int, packed: bytes) -> np.ndarray:
            if node not in sets:
                if len(sets) >= KEPT_SETS:
                    sets.clear()
                sets[node] = shingle_set(zlib.decompress(packed), memo, k)
            return sets[node]

        for batch in batches:
            keep = []
            for other, hub, x, y in zip(*(batch.column(c).to_pylist() for c in ("other", "hub", "x", "y"))):
                y, x = set_of(hub, y), set_of(other, x)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.select("a", "b")
    small = (lambda df: F.broadcast(df)) if pairs.count() <= BROADCAST_NODES else (lambda df: df)
    number = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("c"))
    of = lambda c: number.select(F.col("node").alias(c), F.col("c").alias(f"c{c}"))
    turned = F.col("ca") > F.col("cb")
    oriented = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.when(turned, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("ca", "cb").alias("c"))
    oriented = materialise(oriented.withColumn("salt", F.pmod(F.xxhash64("other"), F.ceil(F.col("c") / HUB_PAIRS))).drop("c"), "oriented")
    others = texts.select(F.col("node").alias("other"), F.col("packed").alias("x")).join(small(oriented), "other")
    hubs = texts.select(F.col("node").alias("hub"), F.col("packed").alias("y")).join(small(oriented.select("hub", "salt").distinct()), "hub")
    both = others.join(hubs.hint("merge"), ["hub", "salt"])
    return map_arrow(both.select("a", "b", "other", "hub", "x", "y"), run, "a bigint, b bigint")


def _texts_of(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, packed) of the wanted nodes: the compressed text of one document each (node, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in batches:
            nodes, packed = [], []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                s = shingle_set(text, memo, k)
                if len(s) and np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()) or 1).view(np.int64) == node:
                    nodes.append(node)
                    packed.append(zlib.compress(text, 6))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], names=["node", "packed"])

    d = documents.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), as_bytes().alias("text"))
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = materialise(map_arrow(d.join(wanted, "doc_id").select("node", "text"), run, "node bigint, packed binary"), "texts")
    if texts.groupBy("node").count().where("count > 1").isEmpty():
        return texts
    return materialise(texts.dropDuplicates(["node"]), "texts")  # rows that repeat a doc_id


def _propose(similarity: int, forest: bool):
    """Rows sorted by (key, block): pairs across components within the Hamming bound. With ``forest`` only the pairs, closest
    first, that join the key's members if all of them are links; else all of them, some at a time."""

    def group(a: np.ndarray, n: np.ndarray, label: np.ndarray, minor: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        root = {int(x): int(x) for x in label} if forest else {}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i in np.flatnonzero(minor):
            close = (label != label[i]) & (~minor | (a > a[i]))
            close &= np.minimum(n, n[i]) * 100 >= similarity * np.maximum(n, n[i])
            j = np.flatnonzero(close)
            if not len(j):
                continue
            apart = _apart(sketch[j], sketch[i])
            within = apart * (100 + similarity) <= (100 - similarity) * (n[j] + n[i])
            j = j[within][np.argsort(apart[within], kind="stable")]
            if forest:
                joins = []
                for x in j.tolist():
                    one, other = top(int(label[i])), top(int(label[x]))
                    if one != other:
                        root[max(one, other)] = min(one, other)
                        joins.append(x)
                j = np.array(joins, np.int64)
            if len(j):
                yield np.minimum(a[i], a[j]), np.maximum(a[i], a[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for pair in group(*(t.column(c).to_numpy() for c in ("node", "n", "label")), t.column("minor").to_numpy(zero_copy_only=False), _bits(t.column("sketch"))):
                out.append(pair)
                size += len(pair[0])
                if size >= PAIRS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if at not in (None, (key[lo], block[lo])):
                    yield from flush()
                    held = []
                at = (key[lo], block[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from flush()

    return run


def _open(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the large keys' members (node, keys: a row a node) those of the keys that lie in several components: a row a node and
    key, with the key's largest component (major) and its number of blocks; and a row a node again, for the next look.

    Labels are joined to nodes, not to each of their keys."""
    m = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    m = materialise(m.select("node", "label", F.explode("keys").alias("key")), "memberships")
    per = m.groupBy("key", "label").agg(F.count("*").alias("c"))
    keys = per.groupBy("key").agg(F.sum("c").alias("members"), F.count("*").alias("labels"), F.max(F.struct("c", "label")).alias("most")).where("labels > 1")
    keys = materialise(keys.select("key", F.col("most.label").alias("major"), F.ceil(F.col("members") / BLOCK_NODES).cast("int").alias("n_blocks")), "keys")
    m = materialise(m.join(keys, "key"), "open")
    return m, _by_node(m)


def _by_node(memberships: DataFrame) -> DataFrame:
    return materialise(memberships.groupBy("node").agg(F.collect_list("key").alias("keys")), "members")


def _large_pairs(m: DataFrame, nodes: DataFrame, similarity: int, forest: bool) -> DataFrame:
    """Candidate pairs of the large keys across components, of ``_open`` memberships. A key's members outside its largest
    component go to all of its blocks, the others to one: the work is members times strays, never all pairs."""
    m = m.join(nodes.select("node", "n", "sketch"), "node")
    m = m.withColumn("minor", F.col("label") != F.col("major")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    m = m.withColumn("block", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array("own"))))
    m = m.select("key", "block", "node", "n", "label", "minor", "sketch").repartition("key", "block").sortWithinPartitions("key", "block", "node")
    return map_arrow(m, _propose(similarity, forest), "a bigint, b bigint").distinct()


def _all_large_pairs(large: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """All candidate pairs of the large keys: a key's members are dealt into ranges, each two of which meet in one tile."""
    keys = materialise(large.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("n_blocks")), "keys")
    m = large.join(keys, "key").join(nodes.select("node", "n", "sketch"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    m = m.withColumns({"label": F.col("node"), "minor": F.col("own") <= F.col("other"), "block": F.least("own", "other").cast("bigint") * F.col("n_blocks") + F.greatest("own", "other")})
    m = m.select("key", "block", "node", "n", "label", "minor", "sketch").repartition("key", "block").sortWithinPartitions("key", "block", "node")
    return map_arrow(m, _propose(similarity, False), "a bigint, b bigint").distinct()


def _candidates(documents: DataFrame, similarity: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    """rows (doc_id, row, node, n), nodes, pairs of small keys within the Hamming bound, large keys' members, their texts, whether there are large keys."""
    spark = documents.sparkSession
    size = int(str(documents.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = min(max((size // BUCKET_BYTES).bit_length(), BUCKET_BITS), 24)
    d = documents.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), row_hash().alias("row"), as_bytes().alias("text"))
    tasks = max(spark.sparkContext.defaultParallelism, size // PARTITION_BYTES) if size < 1 << 50 else shuffle_parts(spark)  # else unknown
    keyed = map_arrow(d, _map_blocks(bits, similarity, k), _SCHEMA).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    found = materialise(map_arrow(keyed, _match, _SCHEMA), "found")
    reclaim(spark)
    rows = found.where(F.col("kind") == NODE).select("doc_id", "row", "node", "n")
    nodes = found.where((F.col("kind") == NODE) & F.col("sketch").isNotNull())
    nodes = materialise(nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("surplus").alias("surplus"), F.first("sketch").alias("sketch")), "nodes")
    large = materialise(_unpack(found.where(F.col("kind") == LARGE), key="keys", node="nodes").distinct(), "large")
    any_large = not large.isEmpty()
    sized = nodes.select("node", "n", "surplus")
    if any_large:
        sized = materialise(sized.join(large.groupBy("node").agg(F.count("*").alias("lost")), "node", "left").fillna(0, "lost"), "sized")
    else:
        sized = sized.withColumn("lost", F.lit(0).cast("bigint"))
    pairs = _unpack(found.where(F.col("kind") == PAIRS), a="keys", b="nodes", shared="sketch").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    pairs = materialise(_share_enough(pairs, sized, similarity), "enough")
    pairs = materialise(_within_sketch(pairs, nodes, similarity), "pairs")
    if any_large:  # nodes that keep enough small keys are found by those
        heavy = large.groupBy("node", F.col("key").bitwiseAND(255).cast("int").alias("band")).agg(F.count("*").alias("lost"))
        room = nodes.select("node", F.expr("transform(filter(surplus, (x, i) -> i % 2 = 0), (x, i) -> struct(x as band, surplus[2 * i + 1] as room))").alias("r")).select("node", F.inline("r"))
        bound = heavy.join(room, ["node", "band"]).where("lost > room").select("node", "band")
        large = materialise(large.withColumn("band", F.col("key").bitwiseAND(255).cast("int")).join(bound, ["node", "band"]).select("key", "node"), "large")
        any_large = not large.isEmpty()
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).unionAll(large.select("node")).distinct()
    texts = _texts_of(documents, materialise(wanted.join(nodes.select("node", "doc_id"), "node"), "wanted"), k)
    reclaim(spark)
    return rows, nodes, pairs, large, texts, any_large


def links(documents: DataFrame, similarity: int = SIMILARITY, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, row, node, n; links: a, b): every document's node, and every link between different nodes, a < b. Rows of
    one node (with n > 0) are linked too, as are their copies to those of a linked node; these are not written out."""
    rows, nodes, pairs, large, texts, any_large = _candidates(documents, similarity, k)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if any_large:
        pairs = materialise(pairs.unionAll(_all_large_pairs(large, nodes, similarity)).distinct(), "proposed")
    return rows, materialise(_verified(pairs, texts, similarity, k), "links", SET_ROWS)


def link_counts(documents: DataFrame, similarity: int = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, n_links (other rows that are linked to it, copies included) of every row."""
    rows, found = links(documents, similarity, k)
    rows = materialise(rows, "rows")
    copies = rows.where("n > 0").groupBy("node").agg(F.count("*").alias("c"))
    both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(copies.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("c").alias("others"))
    per = copies.join(others, "node", "left").select("node", (F.col("c") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.join(per, "node", "left")
    return out.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def linked(documents: DataFrame, similarity: int = SIMILARITY, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, row, node, n; labels: node, label): every document's node, and the component of each node with links."""
    spark = documents.sparkSession
    rows, nodes, pairs, large, texts, any_large = _candidates(documents, similarity, k)
    # a node's closest pair first; what then still lies across components is verified in full
    ends = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "apart").unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "apart"))
    closest = ends.groupBy("u").agg(F.min_by("v", "apart").alias("v")).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    links = materialise(_verified(materialise(closest, "closest"), texts, similarity, k), "links", SET_ROWS)
    labels = components(links)
    reclaim(spark)
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    across = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    across = materialise(across.select("a", "b"), "across")
    if not across.isEmpty():
        links = links.unionAll(materialise(_verified(across, texts, similarity, k), "links", SET_ROWS))
        labels = components(links)
    if any_large:  # keys of several blocks: their members against one of them, so that few are strays afterwards
        vast = materialise(large.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("a")).where(F.col("c") > BLOCK_NODES), "vast")
        if not vast.isEmpty():
            stars = materialise(large.join(vast, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "stars")
            links = links.unionAll(materialise(_verified(stars, texts, similarity, k), "links", SET_ROWS))
            labels = components(links)
    members = _by_node(large) if any_large else None
    for forest in (True, False) if any_large else ():  # a spanning choice of pairs; then all that still lie across components
        m, members = _open(members, labels)  # keys that lie in one component stay there
        found = materialise(_large_pairs(m, nodes, similarity, forest), "proposed")
        more = materialise(_verified(found, texts, similarity, k), "links", SET_ROWS)
        reclaim(spark)
        if not more.isEmpty():
            links = links.unionAll(more)
            labels = components(links)
    return rows, labels


def _null(c: str):
    return F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)


def _labelled(documents: DataFrame, similarity: int, k: int) -> DataFrame:
    """rows with the label of their component."""
    rows, labels = linked(documents, similarity, k)
    return materialise(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")


def near_duplicates(documents: DataFrame, similarity: int = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included) of every row."""
    rows = _labelled(documents, similarity, k)
    many = materialise(rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c"), "components")
    out = rows.join(many, "label", "left").withColumn("component_id", F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), "doc_id"))
    return out.select(_null("doc_id"), F.col("n").alias("n_shingles"), _null("component_id"))


def one_of_each(documents: DataFrame, similarity: int = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """``documents`` with one row of each component: that with the smallest doc_id (null first), of several such rows that with
    the smallest text hash, of alike ones any. Rows that share an id but no link stay."""
    rows = _labelled(documents, similarity, k).where("n > 0")
    many = rows.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("c")).where("c > 1")
    many = materialise(many.select("label", F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_row")), "components")
    members = materialise(rows.join(many, "label").select(_null("doc_id"), "row", ((F.col("doc_id") == F.col("_id")) & (F.col("row") == F.col("_row"))).alias("stays")), "members")
    out = without(documents, members.where("not stays"))
    twice = materialise(members.where("stays").groupBy("doc_id", "row").count().where("count > 1"), "twice")
    if twice.isEmpty():
        return out
    alike = out.withColumn("_tw_row", row_hash())
    alike = alike.join(twice.select(F.col("doc_id").alias("_tw_id"), F.col("row").alias("_tw_twice")), F.col("doc_id").eqNullSafe(F.col("_tw_id")) & (F.col("_tw_row") == F.col("_tw_twice")), "left_semi")
    return without(out, twice).unionByName(alike.dropDuplicates(["doc_id", "_tw_row"]).select(documents.columns))


def op3(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents)


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i+4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 80 * (na.n + nb.n - common)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as node from n union select r.doc_id, e.b from r join e on e.a = r.node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.c, d.doc_id) as component_id
from documents d left join n using (doc_id) left join (select doc_id, min(node) as c from r group by doc_id) c using (doc_id)
"""
