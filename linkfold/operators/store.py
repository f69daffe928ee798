"""The short-key store as tables: allocation, put, get, expand, layout and cache replay."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkfold.functions import kernels
from linkfold.functions.fixed import ANCHOR_HEADER, ANCHOR_SIMILARITY, ANCHORS, DELTA_HEADER, FRAME_BYTES

LENGTHS = range(5, 12)


class KeysExhausted(RuntimeError):
    """A link has found every key of its up to 11 characters taken."""


def sha_key(url: Column, length: int) -> Column:
    """A key of `length` from SHA-256, for stores that SQL engines check; BLAKE3 keys come from `blake3_key`."""
    return F.substring(F.sha2(F.encode(url, "UTF-8"), 256), 1, length)


def blake3_keys(links: DataFrame) -> DataFrame:
    """links with k5 ... k11, the keys of each length; one pass through Python."""
    cols = [f"k{n}" for n in LENGTHS]

    @F.pandas_udf(", ".join(f"{c} string" for c in cols))
    def run(urls: pd.Series) -> pd.DataFrame:
        digests = kernels.blake3([u.encode() for u in urls])
        return pd.DataFrame([[kernels.shortcut(d, n) for n in LENGTHS] for d in digests], columns=cols)

    return links.withColumn("__k", run("url")).select(*links.columns, "__k.*")


def allocate(links: DataFrame, store: DataFrame, key=sha_key, code_length: Column | None = None, lengths=LENGTHS, carry: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Keys for links in order of seq: each takes the shortest key that is free or already its own.

    Equal to one link after the other: keys of different lengths never meet, so at each length the earliest of those
    that lost all shorter ones takes a free key. A link whose stateless code is not longer than a key goes without
    (key null). store: key, url. carry: url and further columns for `key` and `code_length`. Returns seq, url, key; raises KeysExhausted where all lengths are taken, or without `strict`
    has no row for such a link.
    """
    own = Window.partitionBy("url").orderBy("seq")
    first = links.withColumn("__nth", F.row_number().over(own)).where("__nth = 1").select("seq", "url")
    if carry is not None:
        first = first.join(carry, "url")
    left = first.withColumn("__code", code_length if code_length is not None else F.lit(1000))
    columns = left.columns
    done = None
    for n in lengths:
        short = left.where(F.col("__code") <= n).select("seq", "url", F.lit(None).cast("string").alias("key"))
        tried = left.where(F.col("__code") > n).withColumn("key", key(F.col("url"), n))
        held = store.select("key", F.col("url").alias("__held"))
        tried = tried.join(held, "key", "left")
        # A held key blocks all but its own link; of the rest the earliest wins.
        order = Window.partitionBy("key").orderBy("seq")
        tried = tried.withColumn("__rank", F.row_number().over(order))
        wins = F.when(F.col("__held").isNotNull(), F.col("__held") == F.col("url")).otherwise(F.col("__rank") == 1)
        won = tried.where(wins).select("seq", "url", "key")
        left = tried.where(~wins).select(*columns)
        part = won.unionByName(short)
        done = part if done is None else done.unionByName(part)
    if strict:
        # The error depends on the row's columns: a later filter on key, pushed down, raises for no other row.
        taken = F.when(~wins, F.raise_error(F.lit("all keys of this link are taken")).cast("string"))
        done = done.unionByName(tried.where(~wins).select("seq", "url", taken.alias("key")))
    return links.select("seq", "url").join(done.select("url", "key"), "url").select("seq", "url", "key")


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that a put adds: keys that the store does not hold, the first of each."""
    first = Window.partitionBy("key").orderBy("seq")
    fresh = new.where(F.col("key").isNotNull()).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return fresh.join(store, "key", "left_anti")


def get(store: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(store.select("key", "url"), "key", "left")


def expand(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored link of a key, or else what it decodes to."""
    found = get(store, keys)
    decoded = kernels.resolve_udf()(F.when(F.col("url").isNull(), F.col("key")))
    return found.withColumn("__d", decoded).select(*keys.columns, F.coalesce("url", "__d.url").alias("url"), F.when(F.col("url").isNull(), F.col("__d.error")).alias("error"))


def route(digest_hex: Column, shards: int) -> Column:
    """The shard of a digest: its first byte modulo the number of shards."""
    return (F.conv(F.substring(digest_hex, 1, 2), 16, 10).cast("int") % shards).cast("int")


def log_offsets(records: DataFrame, size: str = "size") -> DataFrame:
    """Byte offset of each record in its shard's log."""
    before = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(F.col(size) + FRAME_BYTES).over(before), F.lit(0)).cast("long"))


def sealed_bytes(n: Column) -> Column:
    """Bytes of the sealed index of n keys: pilots of 2 bytes for a third of them, 9 bytes for each of 1.25 n slots."""
    slots = n + F.greatest(F.floor(n / 4), F.lit(16))
    return F.when(n == 0, F.lit(0)).otherwise(2 * F.greatest(F.floor(n / 3), F.lit(1)) + 9 * slots).cast("long")


def elias_fano(values: DataFrame, *by: str) -> DataFrame:
    """Low part and high position of each value of an ascending sequence, or of one for each value of by, by the usual width."""
    bounds = values.groupBy(*by).agg(F.count("*").alias("n"), F.max("v").alias("m"))
    width = F.when(F.col("m") > F.col("n"), F.floor(F.log2(F.floor(F.col("m") / F.col("n")) + 0.0000001))).otherwise(0).cast("int")
    bounds = bounds.select(*by, width.alias("w"))
    # One row, or one for each sequence.
    out = values.join(bounds, list(by)) if by else values.crossJoin(F.broadcast(bounds))
    return out.select(*by, "i", "v", F.expr("v & (shiftleft(1L, w) - 1)").alias("low"), F.expr("i + shiftright(v, w)").alias("high"))


def nearest_anchor(links: DataFrame, anchors: DataFrame, similarity) -> DataFrame:
    """The most similar of at most ANCHORS given anchors (of equals the first), if similar enough. anchors: idx, anchor."""
    # At most 255 rows: the set of one shard.
    pairs = links.crossJoin(F.broadcast(anchors.limit(ANCHORS))).withColumn("sim", similarity(F.col("anchor"), F.col("url")))
    best = pairs.groupBy("seq").agg(F.max(F.struct("sim", (-F.col("idx")).alias("neg"))).alias("b"))
    return best.select("seq", (-F.col("b.neg")).alias("idx"), F.col("b.sim").alias("sim")).where(F.col("sim") >= ANCHOR_SIMILARITY)


def cluster(links: DataFrame) -> DataFrame:
    """Leader clustering of each shard in order of seq, for links with shard: seq, shard, idx, new, stored bytes.

    Order decides, so a shard is one fold over its rows, with at most 255 anchors in memory; more shards are more tasks.
    """

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        anchors: list[bytes] = []
        out = []
        for r in frame.sort_values("seq").itertuples():
            data = r.url.encode()
            best, at = 0.0, 0
            for i, a in enumerate(anchors):
                s = sum(x == y for x, y in zip(a, data, strict=False)) / max(len(a), len(data)) if a and data else 0.0
                if s > best:
                    best, at = s, i
            if best < ANCHOR_SIMILARITY and len(anchors) < ANCHORS:
                anchors.append(data)
                out.append((r.seq, r.shard, len(anchors) - 1, True, len(data) + ANCHOR_HEADER))
            else:
                same = sum(x == y for x, y in zip(anchors[at][:256], data[:256], strict=False))
                out.append((r.seq, r.shard, at, False, DELTA_HEADER + len(data) - same))
        return pd.DataFrame(out, columns=["seq", "shard", "idx", "new", "size"])

    return links.select("seq", "shard", "url").groupBy("shard").applyInPandas(group, "seq long, shard int, idx int, new boolean, size long")


class AdaptiveCache:
    """Adaptive replacement cache: recent and frequent keys, and the ghosts of those that left."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.target = capacity, 0
        self.recent, self.frequent, self.recent_gone, self.frequent_gone = (OrderedDict() for _ in range(4))

    def access(self, key) -> bool:
        """Whether the key was cached; it is afterwards."""
        if key in self.recent:
            del self.recent[key]
            self.frequent[key] = None
            return True
        if key in self.frequent:
            self.frequent.move_to_end(key)
            return True
        a, b = len(self.recent_gone), len(self.frequent_gone)
        if key in self.recent_gone:
            self.target = min(self.capacity, self.target + max(1, b // a))
            self._make_room(False)
            del self.recent_gone[key]
            self.frequent[key] = None
        elif key in self.frequent_gone:
            self.target = max(0, self.target - max(1, a // b))
            self._make_room(True)
            del self.frequent_gone[key]
            self.frequent[key] = None
        else:
            seen = len(self.recent) + a
            total = seen + len(self.frequent) + b
            if seen == self.capacity and len(self.recent) < self.capacity:
                self.recent_gone.popitem(last=False)
                self._make_room(False)
            elif seen == self.capacity:
                self.recent.popitem(last=False)
            elif total >= self.capacity:
                if total == 2 * self.capacity:
                    self.frequent_gone.popitem(last=False)
                self._make_room(False)
            self.recent[key] = None
        return False

    def _make_room(self, ghost_of_frequent: bool) -> None:
        n = len(self.recent)
        if n and (n > self.target or ghost_of_frequent and n == self.target):
            self.recent_gone[self.recent.popitem(last=False)[0]] = None
        elif self.frequent:
            self.frequent_gone[self.frequent.popitem(last=False)[0]] = None


def replay_cache(accesses: DataFrame, capacity: int) -> DataFrame:
    """Hits and accesses of each shard's cache. accesses: shard, seq, key. Shards are independent folds."""

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        cache = AdaptiveCache(capacity)
        hits = sum(cache.access(k) for k in frame.sort_values("seq")["key"])
        return pd.DataFrame([(int(frame["shard"].iloc[0]), len(frame), int(hits))], columns=["shard", "accesses", "hits"])

    return accesses.select("shard", "seq", "key").groupBy("shard").applyInPandas(group, "shard int, accesses long, hits long")
