"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

Documents with equal shingle sets form one class first; the join is between classes, so copies never meet as pairs.

1. Each class keeps, of its shingles ordered from rare to frequent, only the prefix that any partner must share one
   shingle with. Frequencies come from a table of counters over all shingles, its size following their number; any
   fixed order gives whole results, a better one shorter lists.
2. Postings travel as columns of bytes, a block for each map task and hash bucket. Those of shingles that only one
   class holds end there, as do those that pass the length and positional filters with no other of their list. Lists
   that are known to be long are dealt out in parts, and all their parts meet.
3. Within each list, pairs that pass the length, positional and suffix filters are candidates. A task hands on no
   pairs but a spanning forest of its candidates: as many rows as classes, however many pairs. Connected candidates are a
   cluster; all links lie inside clusters.
4. A cluster's whole sets meet in units of bounded size, a pair of blocks of classes each. The pairs that share a prefix
   shingle there and pass the length filter are verified, once, as a pair of classes lies in one unit only. A unit hands on
   each class's number of links and a spanning forest of them, which gives the components.

So a group of near copies costs rows as it has members, not as it has links, and no step writes pairs down.

The suffix filter bounds the symmetric difference from below: each shingle flips one bit of a parity vector, so two
sets differ in at least as many shingles as their vectors differ in bits. A vector has about as many bits as the set has
shingles, up to PARITY_BITS; a longer one is folded onto a shorter one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from linkfold.llm.common import Scratch, bounded_batches, free_name, map_batches, materialise, mix64, release_memory, shingle_sets, slices, text_buffer

WIDTH = 5
#: Similarity as a fraction of whole numbers: a link has NUMERATOR * union <= DENOMINATOR * intersection.
NUMERATOR, DENOMINATOR = 4, 5
#: Shingles for one counter of the frequency table, and its least and largest size: 16 MB of levels at most.
SHINGLES_A_COUNTER, COUNTERS_LOG2 = 32, (12, 24)
#: Bits of the membership filter for one id, and its largest size, 16 MB: with more ids it lets more through, never less.
BITS_AN_ID, FILTER_LOG2 = 12, 27
#: Lists estimated longer than this are dealt out in parts.
LONG_LIST = 50_000
#: Lists up to this length have all their pairs looked at together; longer ones are searched from class to class.
SHORT_LIST = 32
#: Classes of one block of a cluster.
BLOCK = 512
#: Classes in clusters, up to which each task has them all, 48 bytes each; with more, their sets are shuffled once more.
HELD_MEMBERS = 1 << 20
#: Classes that one task remembers, to emit a class once; beyond it a class may be emitted again, which is dropped later.
SEEN = 200_000
#: Postings that a map task holds before it sends them.
HELD = 1_000_000
#: Least and largest size of a parity vector.
PARITY_BITS = (64, 2048)
_CHUNK_LOG2 = 12
#: Stands for a null id where texts are read again.
_NAMELESS = -(2**63)
_SALT = np.uint64(0xA0761D6478BD642F)
_POSTINGS = (("token", "<u8"), ("class", "<i8"), ("n", "<u4"), ("pos", "<u4"), ("parts", "<u4"))


def overlap_needed(n_a, n_b):
    """Smallest intersection of sets of these sizes that makes a link: ceil(t / (1 + t) * (n_a + n_b))."""
    total = NUMERATOR + DENOMINATOR
    return (NUMERATOR * (n_a + n_b) + (total - 1)) // total


def prefix_length(n):
    """Shingles of a set of n (a number or an array) of which any partner shares one."""
    return n + -NUMERATOR * n // DENOMINATOR + 1


def class_keys(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set; of no meaning for empty sets."""
    n = np.diff(ends).astype(np.uint64)
    a, b = _sums(mix64(flat), ends), _sums(mix64(flat ^ _SALT), ends)
    return mix64(a + n).view(np.int64), mix64(b ^ n).view(np.int64)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of stretches, empty ones too, modulo 2^64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


def parities(flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The parity vector of each set; bit i counts the shingles whose hash is i modulo the vector's size."""
    n = np.diff(ends)
    low, high = PARITY_BITS
    size = np.int64(1) << np.ceil(np.log2(np.clip(n, low, high))).astype(np.int64)
    base = np.r_[0, np.cumsum(size)]
    at = (mix64(flat) & np.repeat(size - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(base[:-1], n)
    raw = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8)).tobytes()
    return [raw[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def _sets(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of rows, with their sets one after the other and the offsets between them."""
    raw, off = text_buffer(batch.column(column))
    for i, j in slices(off):
        yield i, j, *shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], WIDTH)


def _fresh(keys: np.ndarray, ends: np.ndarray, seen: set[int]) -> np.ndarray:
    """Numbers of the sets that aren't empty and weren't seen; remembers SEEN of them."""
    out = []
    for i, (k, n) in enumerate(zip(keys.tolist(), np.diff(ends).tolist(), strict=True)):
        if n and k not in seen:
            out.append(i)
            if len(seen) < SEEN:
                seen.add(k)
    return np.array(out, np.int64)


def _stretches(ends: np.ndarray, rows: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the given stretches' entries (the first `most` of each) one after the other, and their sizes."""
    sizes = np.diff(ends)[rows] if most is None else most
    return np.arange(int(sizes.sum())) + np.repeat(ends[rows] - np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64), sizes), sizes


# Tables gathered from all partitions --------------------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Compressed, bytes of one significance together: counts are mostly small."""
    return pa.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, dtype: str, length: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(data, length * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, length).T).view(dtype).reshape(length)


def _chunks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A table in compressed chunks, those that are not all 0."""
    parts = table.reshape(-1, min(len(table), 1 << _CHUNK_LOG2))
    used = np.flatnonzero(parts.any(axis=1))
    for a in range(0, len(used), 64):
        some = used[a : a + 64]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_pack(parts[i]) for i in some], pa.binary())], names=["chunk", "data"])


def _gather(chunks: DataFrame, size_log2: int, dtype: str, merge: Callable, last: Callable, levels: int = 2) -> np.ndarray:
    """Merges chunks by number, in two steps so that no task reads a chunk from all partitions, into one table of bytes
    on the driver; `last` makes them of the merged values."""
    width = min(1 << size_log2, 1 << _CHUNK_LOG2)

    def step(end: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    new = _unpack(data, dtype, width)
                    found[k] = merge(found[k], new) if k in found else new
            for k, data in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(last(data) if end else data)], pa.binary())], names=["chunk", "data"])
            release_memory()

        return run

    for level in range(levels):
        spread = [F.pmod(F.spark_partition_id(), F.lit(16))] if level + 1 < levels else []
        chunks = chunks.repartition("chunk", *spread).mapInArrow(step(level + 1 == levels), "chunk int, data binary")
    out = np.zeros(1 << size_log2, np.uint8)
    for r in chunks.toLocalIterator():
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = _unpack(r["data"], "u1", width)
    return out


def frequency_levels(docs: DataFrame, shingles: int) -> np.ndarray:
    """Estimated frequency by hash slot, as 8 * log2, over all classes (about `shingles` in all): a byte for each counter.
    docs: id, text."""
    low, high = COUNTERS_LOG2
    log2 = min(high, max(low, math.ceil(math.log2(max(1, shingles / SHINGLES_A_COUNTER)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.zeros(1 << log2, np.uint32), set()
        for batch in batches:
            for _, _, flat, ends in _sets(batch):
                rows = _fresh(class_keys(flat, ends)[0], ends, seen)
                at, _ = _stretches(ends, rows)
                np.add.at(table, (flat[at] >> np.uint64(64 - log2)).astype(np.int64), np.uint32(1))
        yield from _chunks(table)
        release_memory()

    chunks = bounded_batches(docs.select(F.lit(0).alias("id"), "text")).mapInArrow(run, "chunk int, data binary")
    add = lambda a, b: np.minimum(a.astype(np.uint64) + b, 2**32 - 1).astype("<u4")
    return _gather(chunks, log2, "<u4", add, lambda x: np.minimum(255, np.round(8 * np.log2(x + 1.0))).astype(np.uint8))


def membership(ids: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the ids in the first column, about `count` of them."""
    log2 = min(FILTER_LOG2, max(10, math.ceil(math.log2(max(1, count) * BITS_AN_ID))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (log2 - 3), np.uint8)
        for batch in batches:
            for at in _probes(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), log2):
                np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield from _chunks(bits)
        release_memory()

    return _gather(ids.mapInArrow(run, "chunk int, data binary"), log2 - 3, "u1", np.bitwise_or, lambda x: x)


def _probes(ids: np.ndarray, log2: int) -> list[np.ndarray]:
    h = mix64(ids.view(np.uint64))
    return [(mix64(h + np.uint64(k)) >> np.uint64(64 - log2)).astype(np.int64) for k in range(4)]


def _passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    log2 = (8 * len(bits)).bit_length() - 1
    for at in _probes(ids, log2):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


# Stages of the join -----------------------------------------------------------------------------------------------


def signatures(docs: DataFrame) -> DataFrame:
    """For each row: id, class (null without words), its check hash, n, and the parity vector."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, flat, ends in _sets(batch):
            n = np.diff(ends)
            key, check = class_keys(flat, ends)
            columns = [batch.column(0)[i:j], pa.array(key, mask=n == 0), pa.array(check, mask=n == 0), pa.array(n), pa.array(parities(flat, ends), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "class", "check", "n", "parity"])

    return map_batches(docs, run, "id long, class long, check long, n long, parity binary")


def postings(docs: DataFrame, levels: np.ndarray, shingles: int, buckets: int) -> DataFrame:
    """Prefix shingles of each class, rare ones first, as blocks of bytes by bucket. docs: id, text.

    A token is a shingle's level and its first 56 bits: equal tokens of different shingles only add candidates. The
    number of parts of a list follows from its token alone, the part of a class from its key.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 16 MB at most
    log2 = len(levels).bit_length() - 1
    noise, long_list, held = 1.5 * shingles / len(levels), LONG_LIST, HELD

    def send(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        token, key, parts = columns[0], columns[1], columns[4]
        part = (key & 0xFFFF).astype(np.uint32) % parts
        bucket = (mix64(token ^ (part.astype(np.uint64) * _SALT)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        blocks = [pa.array([c[a:b].tobytes() for a, b in spans], pa.binary()) for c in (x[order] for x in columns)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cut[:-1]]), *blocks], names=["bucket", *(name for name, _ in _POSTINGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen, found, have = shared.value, set(), [], 0
        for batch in batches:
            for _, _, flat, ends in _sets(batch):
                keys = class_keys(flat, ends)[0]
                rows = _fresh(keys, ends, seen)
                if not len(rows):
                    continue
                token = level[(flat >> np.uint64(64 - log2)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | flat >> np.uint64(8)
                for a, b in zip(ends[rows].tolist(), ends[rows + 1].tolist(), strict=True):
                    token[a:b].sort()
                sizes = np.diff(ends)[rows]
                at, taken = _stretches(ends, rows, prefix_length(sizes))
                token = token[at]
                expected = np.exp2((token >> np.uint64(56)).astype(np.float64) / 8) - noise
                parts = np.maximum(1, np.ceil(expected / long_list)).astype(np.uint32)
                found.append((token, np.repeat(keys[rows], taken), np.repeat(sizes, taken).astype(np.uint32), (at - np.repeat(ends[rows], taken)).astype(np.uint32), parts))
                have += len(token)
                if have >= held:
                    yield from send(found)
                    found, have = [], 0
        if have:
            yield from send(found)
        release_memory()

    return bounded_batches(docs).mapInArrow(run, "bucket int, token binary, class binary, n binary, pos binary, parts binary")


def partnered(token: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which postings, sorted by token and then by n, pass the size filters with another posting of their token.

    Both filters of a pair together say no more than 4 n_b <= v_a and 4 n_a <= v_b for v = 5 n - 9 pos. So a posting has
    a partner if, among those of its list with few enough shingles, another one's v is large enough: the largest v is
    kept up to each place, and the second largest for postings that are among those themselves."""
    total, n = NUMERATOR + DENOMINATOR, n.astype(np.int64)
    v = DENOMINATOR * n - total * pos.astype(np.int64)
    # Lists are told apart by their number in the upper bits, so one running maximum serves all; v is from 1 to 2^35.
    base = np.cumsum(np.r_[0, token[1:] != token[:-1]][: len(token)]).astype(np.int64) << 35
    largest = np.maximum.accumulate(base + v)
    second = np.maximum.accumulate(np.maximum(base, np.minimum(base + v, np.r_[0, largest[:-1]][: len(token)])))
    last = np.searchsorted(base + n, base + v // NUMERATOR, side="right") - 1
    itself = v >= NUMERATOR * n
    best = np.where(itself, second[last], largest[np.maximum(last, 0)])
    return (last >= 0) & (best >= base + NUMERATOR * n)


def shared_postings(blocks: DataFrame, buckets: int) -> DataFrame:
    """Postings that have a partner in their list, by their sizes and places, or whose list is in parts.

    A task holds the postings of its buckets, whose number follows that of the shuffle's partitions; a list beyond
    LONG_LIST is in parts, in buckets of their own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[] for _ in _POSTINGS]
        for batch in batches:
            for at, (column, (_, dtype)) in enumerate(zip(batch.columns[1:], _POSTINGS, strict=True)):
                found[at] += [np.frombuffer(x.as_buffer(), dtype).copy() for x in column]
        if not found[0]:
            return
        token, key, n, pos, parts = (np.concatenate(c) for c in found)
        found.clear()
        order = np.lexsort((key, n, token))
        token, key = token[order], key[order]
        # Copies in several tasks give equal rows, next to each other here.
        keep = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])]
        order, token, key = order[keep], token[keep], key[keep]
        keep = partnered(token, n[order], pos[order]) | (parts[order] > 1)
        order, token, key = order[keep], token[keep], key[keep]
        columns = [token.view(np.int64), parts[order].astype(np.int32), key, n[order].astype(np.int32), pos[order].astype(np.int32)]
        for a in range(0, len(token), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in columns], names=["token", "parts", "class", "n", "pos"])
        release_memory()

    return blocks.repartition(buckets, "bucket").mapInArrow(run, "token long, parts int, class long, n int, pos int")


class Candidates:
    """Classes in lists, with their set sizes, places in the list's prefix, and parity vectors; tells which pairs pass the filters."""

    def __init__(self, n: np.ndarray, pos: np.ndarray, parity: pa.Array) -> None:
        self.n, self.pos = n.astype(np.int64), pos.astype(np.int64)
        parity = parity.cast(pa.large_binary())
        off = np.frombuffer(parity.buffers()[1], np.int64)[parity.offset : parity.offset + len(parity) + 1] // 8
        self.words, self.at, self.size = np.frombuffer(parity.buffers()[2], "<u8"), off[:-1], np.diff(off)

    def size_filters(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length filter, and positional filter: after this first common shingle, enough of both must be left."""
        a, b = self.n[i], self.n[j]
        left = np.minimum(a - self.pos[i], b - self.pos[j])
        return (DENOMINATOR * np.minimum(a, b) >= NUMERATOR * np.maximum(a, b)) & (left >= overlap_needed(a, b))

    def suffix_filter(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        i, j = np.where(self.size[i] <= self.size[j], i, j), np.where(self.size[i] <= self.size[j], j, i)
        for small, large in set(zip(self.size[i].tolist(), self.size[j].tolist(), strict=True)):
            some = np.flatnonzero((self.size[i] == small) & (self.size[j] == large))
            for k in range(0, len(some), 20_000):
                part = some[k : k + 20_000]
                x, y = i[part], j[part]
                words = self.words[self.at[x][:, None] + np.arange(small)]
                for fold in range(0, large, small):
                    words ^= self.words[self.at[y][:, None] + (fold + np.arange(small))]
                a, b = self.n[x], self.n[y]
                out[part] = np.bitwise_count(words).sum(axis=1, dtype=np.int64) <= a + b - 2 * overlap_needed(a, b)
        return out

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = self.size_filters(i, j)
        out[out] = self.suffix_filter(i[out], j[out])
        return out

    def reach(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Passing pairs that connect what all passing pairs between `low` and `high` rows connect, found from row to
        row: a row is compared with those alone that nothing has reached yet."""
        rest = np.ones(len(rows), bool)
        stack: list[int] = []
        while rest.any():
            if not stack:
                stack = [int(np.argmax(rest))]
                rest[stack[0]] = False
            i = stack.pop()
            others = np.flatnonzero(rest & ((low[i] & high) | (high[i] & low)))
            hit = others[self.passing(np.full(len(others), rows[i]), rows[others])] if len(others) else others
            if len(hit):
                yield np.full(len(hit), rows[i]), rows[hit]
                rest[hit] = False
                stack += hit.tolist()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the nodes that the pairs connect to the least node of each component, the nodes themselves being numbers."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all() and (new[u] == new[v]).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def candidate_edges(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs a, b of classes that connect all classes which a pair of candidates connects, within each task's lists."""
    dealt = shared.withColumn("part", F.pmod(F.col("class").bitwiseAND(0xFFFF), F.col("parts")).cast("int"))
    # Each part of a list meets all parts, two at a time.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("token", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "class", "n", "pos").join(classes.select("class", "parity"), "class")
    short = SHORT_LIST

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nothing here is beyond a task's share of postings: long lists are in parts.
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        token, low, high, part, key, n, pos = (table.column(c).to_numpy() for c in ("token", "low", "high", "part", "class", "n", "pos"))
        order = np.lexsort((key, high, low, token))
        found = Candidates(n, pos, table.column("parity").combine_chunks())
        change = (np.diff(token[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
        cut = np.flatnonzero(np.r_[True, change, True])
        start, length = cut[:-1], np.diff(cut)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for size in range(2, short + 1):
            lists = start[length == size]
            i, j = np.triu_indices(size, 1)
            for a in range(0, len(lists), 1 + 500_000 // len(i)):
                at = lists[a : a + 1 + 500_000 // len(i), None]
                x, y = order[(at + i).ravel()], order[(at + j).ravel()]
                some = (low[x] == high[x]) | (part[x] != part[y])
                x, y = x[some], y[some]
                ok = found.passing(x, y)
                pairs.append((key[x[ok]], key[y[ok]]))
        for a, size in zip(start[length > short].tolist(), length[length > short].tolist(), strict=True):
            rows = order[a : a + size]
            pairs += [(key[x], key[y]) for x, y in found.reach(rows, part[rows] == low[rows[0]], part[rows] == high[rows[0]])]
        if pairs:
            a, b = forest(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        release_memory()

    return dealt.repartition("token", "low", "high").mapInArrow(run, "a long, b long")


def sets_of(members: DataFrame, docs: DataFrame) -> DataFrame:
    """The members (first, class and more) with their shingles; the texts of the first documents are read again. A row
    may come more than once where a row of docs is repeated."""
    count = members.count()
    if count <= HELD_MEMBERS:
        return _sets_of_few(members, docs)
    bits = docs.sparkSession.sparkContext.broadcast(membership(members.select("first"), count))  # 16 MB at most

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).fill_null(_NAMELESS).to_numpy(zero_copy_only=False).astype(np.int64)
        batch = batch.filter(pa.array(_passes(bits.value, ids)))
        for i, j, flat, ends in _sets(batch):
            keys = pa.array(class_keys(flat, ends)[0], mask=np.diff(ends) == 0)
            sets = [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].fill_null(_NAMELESS), keys, pa.array(sets, pa.binary())], names=["first", "class", "shingles"])

    # A repeated id may come with other texts: first and class together tell the right row.
    return map_batches(docs, run, "first long, class long, shingles binary").join(members, ["first", "class"])


def _sets_of_few(members: DataFrame, docs: DataFrame) -> DataFrame:
    """The same, with the members found where the texts are read, so that sets are shuffled by their clusters alone."""
    table = members.toArrow().sort_by("class").combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast((table, np.unique(table.column("first").to_numpy())))
    names = [*members.columns, "shingles"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table, firsts = shared.value
        if not len(firsts):
            return
        own, first = table.column("class").to_numpy(), table.column("first").to_numpy()
        ids = batch.column(0).fill_null(_NAMELESS).to_numpy(zero_copy_only=False).astype(np.int64)
        some = firsts[np.minimum(np.searchsorted(firsts, ids), len(firsts) - 1)] == ids
        batch, ids = batch.filter(pa.array(some)), ids[some]
        for i, j, flat, ends in _sets(batch):
            key = class_keys(flat, ends)[0]
            at = np.minimum(np.searchsorted(own, key), len(own) - 1)
            hit = np.flatnonzero((own[at] == key) & (first[at] == ids[i:j]) & (np.diff(ends) > 0))
            sets = pa.array([flat[a:b].tobytes() for a, b in zip(ends[hit].tolist(), ends[hit + 1].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.take(pa.array(at[hit])).columns), sets], names=names)

    return map_batches(docs, run, StructType([*members.schema.fields, StructField("shingles", BinaryType())]))


def components(links: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars: node and root (the least node) for each linked node.
    The rounds grow with the logarithm of the longest path; if `most` do not settle them, it is an error."""
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    state = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, scratch.keep(small.where("u != v").distinct(), "edges")  # u is the larger in all of them
        scratch.drop(before)
        r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (r["n"], r["h"]) == state:
            break
        state = (r["n"], r["h"])
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("v").agg(F.count("*")).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def unit_links(sizes: np.ndarray, flat: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the sets `left` link with which of `right`, as a matrix; sets lie one after the other in flat.

    Prefixes are by frequency within the unit, rare shingles first; pairs that share a prefix shingle and pass the
    length filter are verified by their whole intersection. A set does not link with itself.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, token, counts = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((token, counts[token], owner))
    start = np.r_[0, np.cumsum(sizes)]
    prefix = order[_stretches(start, np.arange(len(sizes)), prefix_length(sizes))[0]]
    prefix = prefix[counts[token[prefix]] > 1]
    prefix = prefix[np.argsort(token[prefix], kind="stable")]
    in_left, in_right = np.full(len(sizes), -1), np.full(len(sizes), -1)
    in_left[left], in_right[right] = np.arange(len(left)), np.arange(len(right))
    pairs = np.zeros((len(left), len(right)), bool)
    cut = np.flatnonzero(np.r_[True, np.diff(token[prefix]) != 0, True]) if len(prefix) else np.zeros(1, int)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a > 1:
            some = owner[prefix[a:b]]
            x, y = in_left[some], in_right[some]
            pairs[np.ix_(x[x >= 0], y[y >= 0])] = True
    n_a, n_b = sizes[left][:, None], sizes[right][None, :]
    pairs &= (DENOMINATOR * np.minimum(n_a, n_b) >= NUMERATOR * np.maximum(n_a, n_b)) & (left[:, None] != right[None, :])
    # Whole intersections, some shingles at a time; counts are whole numbers that float32 holds.
    both = np.zeros(pairs.shape, np.float32)
    common = np.flatnonzero(counts > 1)
    number = np.full(len(counts), -1)
    number[common] = np.arange(len(common))
    of = number[token]
    for a in range(0, len(common), 4096):
        here = np.flatnonzero((of >= a) & (of < a + 4096))
        held = np.zeros((len(sizes), min(4096, len(common) - a)), np.float32)
        held[owner[here], of[here] - a] = 1
        both += held[left] @ held[right].T
    return pairs & (DENOMINATOR * both >= NUMERATOR * (n_a + n_b - both))


def cluster_links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links of the classes in clusters. members: class, first, copies, cluster. Two kinds of rows: class and linked, rows of
    other classes that it links with, in parts to be summed; and class and other, a forest that connects what links connect.

    A cluster of many classes is dealt out in blocks by hash; each pair of blocks is a unit, handled in one task."""
    blocks = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    named = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = sets_of(named, docs).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["cluster", "low", "high"]
    dealt = dealt.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "class", "block", "copies", "shingles")

    def unit(low: int, high: int, rows: list[tuple]) -> pa.RecordBatch:
        block, key, copies = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:3])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        links = unit_links(np.array([len(s) for s in sets]), np.concatenate(sets), left, right)
        linked = np.zeros(len(rows), np.int64)
        linked[left] += links @ copies[right]
        if low != high:
            linked[right] += copies[left] @ links
        i, j = np.nonzero(links)
        a, b = forest(key[left[i]], key[right[j]])
        none = np.arange(len(key) + len(a)) < len(key)
        return pa.RecordBatch.from_arrays([pa.array(np.r_[key, a]), pa.array(np.r_[linked, a], mask=~none), pa.array(np.r_[key, b], mask=none)], names=["class", "linked", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            head = zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
            for (cluster, low, high, key, block, copies), data in zip(head, batch.column(6), strict=True):
                if (cluster, low, high) != now:
                    if rows:
                        yield unit(now[1], now[2], rows)
                    now, rows = (cluster, low, high), []
                if not rows or rows[-1][1] != key:  # a class comes once for each repeated row
                    rows.append((block, key, copies, data.as_py()))
        if rows:
            yield unit(now[1], now[2], rows)
        release_memory()

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "class").mapInArrow(run, "class long, linked long, other long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: id, n_shingles, component_id (the least id reachable by links), its number of rows with equal sets,
    class_id (the least id of those) and links, the number of other rows it links with, those with equal sets among them.

    Null texts and texts without words have no shingles and link with nothing, not even each other; they are their own
    component. Rows with one id and different texts are judged each by its text; a null id gives no component its name
    unless all its ids are null. Texts of any length are taken whole. Columns other than the two are not looked at,
    whatever their names. An empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _near_duplicates(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")), scratch)


def _near_duplicates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    spark: SparkSession = rows.sparkSession
    signed = scratch.keep(signatures(rows), "signatures")
    grouped = signed.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.min("check").alias("check"), F.max("check").alias("check_b"), F.min("n").alias("n"), F.first("parity").alias("parity"))
    classes = scratch.keep(grouped, "classes")
    totals = classes.agg(F.sum("n").alias("shingles"), F.coalesce(F.max(F.col("check") != F.col("check_b")), F.lit(False)).alias("clash")).first()
    if totals["clash"]:
        raise RuntimeError("two shingle sets share a 64-bit hash: change the salt of class_keys")
    shingles = totals["shingles"] or 0
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels = frequency_levels(rows, shingles)
    shared = scratch.keep(shared_postings(postings(rows, levels, shingles, 2 * buckets), buckets), "postings")
    clusters = components(candidate_edges(shared, classes), scratch)
    members = scratch.keep(clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster")).join(classes.select("class", F.coalesce("first", F.lit(_NAMELESS)).alias("first"), "copies"), "class"), "members")
    scratch.drop(shared)
    found = scratch.keep(cluster_links(members, rows), "links")
    final = components(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")), scratch)

    named = classes.select("class", "first", "copies").join(final.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = found.where("linked is not null").groupBy("class").agg(F.sum("linked").alias("linked"))
    named = named.join(least, "root").join(linked, "class", "left").select("class", "first", "component_id", "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    columns = ["id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("first", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")]
    return materialise(signed.select("id", "class", "n").join(named, "class", "left").select(*columns), "near-duplicates")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: that with the least id. Repeated rows count as one; rows with
    one id and different texts stay if the id is their group's least. Rows without an id stay, as do null and empty
    texts. All columns are kept, whatever their names.

    Only rows that may have to go are joined with the decisions, so most texts are not shuffled."""
    found = near_duplicates(docs, id_column, text_column)
    name, count, least = (free_name(x, docs.columns) for x in ("id", "rows", "least"))
    by_id = found.where("id is not null").groupBy(F.col("id").alias(name)).agg(F.count("*").alias(count), F.max(F.col("id") == F.col("component_id")).alias(least))
    doubtful = materialise(by_id.where((F.col(count) > 1) | ~F.col(least)), "doubtful")
    bits = docs.sparkSession.sparkContext.broadcast(membership(doubtful.select(name), doubtful.count()))  # 16 MB at most
    at = docs.columns.index(id_column)

    def choose(doubt: bool) -> Callable:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            column = batch.column(at).cast(pa.int64())
            may = _passes(bits.value, column.fill_null(0).to_numpy(zero_copy_only=False)) & column.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(may == doubt))

        return run

    # Ids that only seem to be doubtful have no row there, and stay.
    joined = map_batches(docs, choose(True), docs.schema).join(doubtful, F.col(id_column).cast("long") == F.col(name), "left")
    once = joined.where(F.col(count).isNull() | ((F.col(count) == 1) & F.col(least))).select(*docs.columns)
    out = map_batches(docs, choose(False), docs.schema).unionByName(once)
    if doubtful.where((F.col(count) > 1) & F.col(least)).limit(1).count():
        out = out.unionByName(joined.where((F.col(count) > 1) & F.col(least)).select(*docs.columns).dropDuplicates([id_column, text_column]))
    return out
