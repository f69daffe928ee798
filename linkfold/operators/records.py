"""Stored records of links: byte payloads against anchors, the sealed index of a shard, and dictionary compression.

A web link is stored as its packed bytes, any other as it is. Within a shard, in order of arrival, a link is either a
new anchor (symbol-compressed) or a positional difference from the nearest one. Anchors are rows of the same table, so
any reader can join them; nothing depends on a process that stays open.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.functions import kernels
from linkfold.functions.fixed import ANCHOR_SIMILARITY, ANCHORS, SYMBOLS

RAW_ANCHOR, RAW_DELTA, PACKED_ANCHOR, PACKED_DELTA = 0, 1, 4, 5

_SYMBOL_RE = re.compile(b"|".join([b"\xff", *(re.escape(s.encode()) for s in SYMBOLS)]))
_SYMBOL_CODE = {b"\xff": b"\xff\xfe"} | {s.encode(): bytes([0xFF, i]) for i, s in enumerate(SYMBOLS)}
_SYMBOL_TEXT = {v: k for k, v in _SYMBOL_CODE.items()}


def symbol_pack(data: bytes) -> bytes:
    return _SYMBOL_RE.sub(lambda m: _SYMBOL_CODE[m[0]], data)


def symbol_unpack(data: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        if m[0] not in _SYMBOL_TEXT:
            raise kernels.CodecError("unknown symbol")
        return _SYMBOL_TEXT[m[0]]

    return re.sub(rb"\xff.?", one, data, flags=re.DOTALL)


def rle_pack(data: bytes) -> bytes:
    """Runs of 3 to 255 as FF n b, FF as FF 00 FF, behind 01; or 00 and the bytes if that is not shorter."""

    def run(m: re.Match) -> bytes:
        n, b = len(m[0]), m[0][:1]
        return bytes([0xFF, n]) + b if n >= 3 else (b"\xff\x00\xff" if b == b"\xff" else b) * n

    packed = re.sub(rb"(.)\1{0,254}", run, data, flags=re.DOTALL)
    return b"" if not data else b"\x01" + packed if len(packed) < len(data) else b"\x00" + data


def rle_unpack(data: bytes) -> bytes:
    if not data:
        return b""
    if data[0] == 0:
        return data[1:]
    if data[0] != 1:
        raise kernels.CodecError("unknown run-length mode")

    def one(m: re.Match) -> bytes:
        if len(m[0]) < 3:
            raise kernels.CodecError("run cut short")
        return b"\xff" if m[0][1] == 0 else m[0][2:] * m[0][1]

    return re.sub(rb"\xff.{0,2}", one, data[1:], flags=re.DOTALL)


def body(url: str) -> tuple[bytes, bool]:
    """The bytes that are stored for a link, and whether they are packed: ASCII web links are."""
    if url.startswith(("http://", "https://")) and url.isascii():
        return rle_pack(kernels.trans_pack(kernels.tokenize(url.encode()))), True
    return url.encode(), False


def unbody(data: bytes, packed: bool) -> str:
    return kernels.detokenize(kernels.trans_unpack(rle_unpack(data))) if packed else data.decode()


def _delta(anchor: bytes, data: bytes) -> tuple[bytes, bytes]:
    """32 bytes of mask, and what differs."""
    a, b = np.frombuffer(anchor, np.uint8), np.frombuffer(data, np.uint8)
    n = min(len(a), len(b), 256)
    same = np.zeros(256, bool)
    same[:n] = a[:n] == b[:n]
    keep = np.ones(len(b), bool)
    keep[: min(len(b), 256)] = ~same[: min(len(b), 256)]
    return np.packbits(same, bitorder="little").tobytes(), b[keep].tobytes()


def records(links: DataFrame) -> DataFrame:
    """links (seq, shard, url) as records: seq, shard, anchor (its number in the shard), mode, payload.

    Order decides what becomes an anchor, so a shard is one fold, with at most 255 anchors in memory; more shards are
    more tasks.
    """

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        anchors: dict[bool, list[tuple[int, np.ndarray, bytes]]] = {True: [], False: []}
        count, out = 0, []
        for seq, shard, url in frame.sort_values("seq")[["seq", "shard", "url"]].itertuples(index=False):
            data, packed = body(url)
            own, best, at = np.frombuffer(data, np.uint8), -1.0, None
            for number, other, raw in anchors[packed]:
                n = min(len(own), len(other))
                s = float((own[:n] == other[:n]).sum()) / max(len(own), len(other)) if n else 0.0
                if s > best:
                    best, at = s, (number, raw)
            if at is not None and (best >= ANCHOR_SIMILARITY or count >= ANCHORS) and len(data) < 1 << 16:
                mask, diffs = _delta(at[1], data)
                head = bytes([at[0]]) + len(data).to_bytes(2, "little") + mask + len(diffs).to_bytes(2, "little")
                out.append((seq, shard, at[0], PACKED_DELTA if packed else RAW_DELTA, head + diffs))
                continue
            number = count if count < ANCHORS else -1  # beyond the last anchor a record stands alone
            if count < ANCHORS:
                anchors[packed].append((count, own, data))
                count += 1
            out.append((seq, shard, number, PACKED_ANCHOR if packed else RAW_ANCHOR, symbol_pack(data)))
        return pd.DataFrame(out, columns=["seq", "shard", "anchor", "mode", "payload"])

    return links.select("seq", "shard", "url").groupBy("shard").applyInPandas(group, "seq long, shard int, anchor int, mode int, payload binary")


def read_records(stored: DataFrame) -> DataFrame:
    """seq, url and error of records; each difference is joined to its anchor's row."""
    own = stored.where(F.col("mode").isin(RAW_ANCHOR, PACKED_ANCHOR) & (F.col("anchor") >= 0)).select("shard", "anchor", F.col("payload").alias("__base"))

    @F.pandas_udf("url string, error string")
    def run(mode: pd.Series, payload: pd.Series, base: pd.Series) -> pd.DataFrame:
        out = []
        for m, p, b in zip(mode, payload, base, strict=True):
            try:
                p = bytes(p)
                if m in (RAW_ANCHOR, PACKED_ANCHOR):
                    data = symbol_unpack(p)
                elif m in (RAW_DELTA, PACKED_DELTA):
                    if b is None or len(p) < 37:
                        raise kernels.CodecError("the anchor is missing or the record cut short")
                    mask = [int.from_bytes(p[3 + 8 * i : 11 + 8 * i], "little") for i in range(4)]
                    data = kernels.delta_apply(symbol_unpack(bytes(b)), int.from_bytes(p[1:3], "little"), mask, p[37:])
                else:
                    raise kernels.CodecError("unknown mode")
                out.append((unbody(data, m in (PACKED_ANCHOR, PACKED_DELTA)), None))
            except (kernels.CodecError, UnicodeDecodeError) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["url", "error"])

    joined = stored.join(own, ["shard", "anchor"], "left")
    return joined.select("seq", run("mode", "payload", "__base").alias("r")).select("seq", "r.url", "r.error")


# Sealed index -----------------------------------------------------------------------------------------------------

_MASK = (1 << 64) - 1


def _mixed(digest: bytes, pilot: int) -> int:
    x = (int.from_bytes(digest[8:16], "little") ^ (pilot * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
    return x ^ x >> 31


def _bucket(digest: bytes, buckets: int) -> int:
    return int.from_bytes(digest[16:24], "little") % buckets  # the first bytes route to shards


def build_index(keys: dict[bytes, int]) -> tuple[np.ndarray, list[bytes | None], np.ndarray]:
    """Hash and displace: a pilot for each bucket of about three keys puts them into free slots, largest buckets first.

    Slots hold the whole digest, so an absent key is never found.
    """
    n = len(keys)
    slots, buckets = n + max(n // 4, 16), max(1, n // 3)
    by: list[list[bytes]] = [[] for _ in range(buckets)]
    for d in sorted(keys):
        by[_bucket(d, buckets)].append(d)
    pilots, held, offsets = np.zeros(buckets, np.uint16), [None] * slots, np.zeros(slots, np.uint64)
    for b in sorted(range(buckets), key=lambda b: -len(by[b])):
        for pilot in range(1 << 16):
            places = [_mixed(d, pilot) % slots for d in by[b]]
            if len(set(places)) == len(places) and all(held[p] is None for p in places):
                break
        else:
            raise kernels.CodecError("no pilot places a bucket")
        pilots[b] = pilot
        for d, p in zip(by[b], places, strict=True):
            held[p], offsets[p] = d, keys[d]
    return pilots, held, offsets


def find(index: tuple[np.ndarray, list[bytes | None], np.ndarray], digest: bytes) -> int | None:
    pilots, held, offsets = index
    p = _mixed(digest, int(pilots[_bucket(digest, len(pilots))])) % len(held)
    return int(offsets[p]) if held[p] == digest else None


def seal(entries: DataFrame) -> DataFrame:
    """Sealed index of each shard, over all its entries (digest, shard, offset): shard, keys, pilot and slot counts,
    modelled bytes (2 a pilot, 9 a slot), and whether every key is found. A shard's index is one file and one task."""

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        keys = {bytes(d): int(o) for d, o in zip(frame["digest"], frame["offset"], strict=True)}
        index = build_index(keys)
        ok = all(find(index, d) == o for d, o in keys.items())
        return pd.DataFrame([(int(frame["shard"].iloc[0]), len(keys), len(index[0]), len(index[1]), 2 * len(index[0]) + 9 * len(index[1]), ok)], columns=["shard", "keys", "pilots", "slots", "bytes", "exact"])

    return entries.select("shard", "digest", "offset").groupBy("shard").applyInPandas(group, "shard int, keys long, pilots long, slots long, bytes long, exact boolean")


# Dictionary compression -------------------------------------------------------------------------------------------


def train_dictionary(links: DataFrame, size: int = 112 << 10, sample: int = 20_000) -> bytes:
    """A zstandard dictionary from at most `sample` links by hash; empty where they are too few."""
    import zstandard

    rows = links.orderBy(F.xxhash64("url")).limit(sample).select("url").collect()
    try:
        return zstandard.train_dictionary(size, [r["url"].encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_udfs(dictionary: bytes, level: int = 3):
    """Compression and decompression with a dictionary, or without where it is empty."""

    def tools():
        import zstandard

        d = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        return zstandard.ZstdCompressor(level=level, **d), zstandard.ZstdDecompressor(**d)

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        c, _ = tools()
        return values.map(lambda v: None if v is None else c.compress(v.encode()))

    @F.pandas_udf("string")
    def unpack(values: pd.Series) -> pd.Series:
        _, d = tools()
        return values.map(lambda v: None if v is None else d.decompress(bytes(v)).decode())

    return pack, unpack
