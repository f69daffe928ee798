"""Content-addressed objects: blobs, manifests, merges, and portable containers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.functions import kernels
from linkfold.functions.fixed import MAGIC, VERSION


def manifest_id(items: Column, prereq: Column | None = None) -> Column:
    """SHA-256 id of a sorted set of hexadecimal digests, after that of its prerequisite if there is one."""
    body = F.array_join(F.array_sort(F.array_distinct(items)), "")
    return F.sha2(F.unhex(F.concat(F.coalesce(prereq, F.lit("")), body) if prereq is not None else body), 256)


def merge_sets(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def _digest(data: bytes, name: str) -> bytes:
    return kernels.blake3([data])[0] if name == "blake3" else hashlib.sha256(data).digest()


def container(prereq: bytes, blobs: list[bytes], hash_name: str = "blake3") -> bytes:
    """A container of blobs: magic, version, prerequisite, sorted manifest, blobs, and a digest of all before."""
    found = {_digest(b, hash_name): b for b in blobs}
    items = sorted(found)
    out = MAGIC + bytes([VERSION]) + prereq + len(items).to_bytes(4, "little") + b"".join(items) + len(items).to_bytes(4, "little")
    out += b"".join(h + len(found[h]).to_bytes(4, "little") + found[h] for h in items)
    return out + _digest(out, hash_name)


def open_container(data: bytes, hash_name: str = "blake3") -> tuple[bytes, list[bytes], list[tuple[bytes, bytes]]]:
    """Prerequisite, manifest and blobs; CodecError for anything damaged, also a blob that its hash does not fit and a
    manifest that names other blobs."""
    if len(data) < 77 or data[:4] != MAGIC or data[4] != VERSION:
        raise kernels.CodecError("no container of this version")
    body, at = data[:-32], 37
    if _digest(body, hash_name) != data[-32:]:
        raise kernels.CodecError("the container is damaged")

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(body):
            raise kernels.CodecError("the container is cut short")
        at += n
        return body[at - n : at]

    items = [take(32) for _ in range(int.from_bytes(take(4), "little"))]
    blobs = []
    for _ in range(int.from_bytes(take(4), "little")):
        h = take(32)
        blobs.append((h, take(int.from_bytes(take(4), "little"))))
    if at != len(body) or any(_digest(b, hash_name) != h for h, b in blobs) or {h for h, _ in blobs} != set(items):
        raise kernels.CodecError("manifest and blobs differ")
    return data[5:37], items, blobs


def verify(data: bytes, hash_name: str = "blake3") -> bool:
    try:
        open_container(data, hash_name)
    except kernels.CodecError:
        return False
    return True


def export(codes: DataFrame, group: str, code: str, hash_name: str = "blake3") -> DataFrame:
    """One container for each value of `group`, a portable file and so held whole by one task."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(frame["g"].iloc[0], container(bytes(32), [c.encode() for c in frame["c"]], hash_name))], columns=[group, "container"])

    kind = codes.schema[group].dataType.simpleString()
    return codes.select(F.col(group).alias("g"), F.col(code).alias("c")).groupBy("g").applyInPandas(pack, f"{group} {kind}, container binary")


def unpack(containers: DataFrame, column: str = "container", hash_name: str = "blake3") -> DataFrame:
    """The blobs of each container, with the columns beside it: ord, hash, data; damaged ones give one row with error."""
    kept = [c for c in containers.columns if c != column]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                head = [r[c] for c in kept]
                try:
                    rows += [(*head, i, h, d, None) for i, (h, d) in enumerate(open_container(bytes(r[column]), hash_name)[2])]
                except kernels.CodecError as e:
                    rows.append((*head, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[*kept, "ord", "hash", "data", "error"]).astype({"ord": "Int32"})

    fields = ", ".join(f"{c} {containers.schema[c].dataType.simpleString()}" for c in kept)
    return containers.select(*kept, column).mapInPandas(run, f"{fields}{', ' if fields else ''}ord int, hash binary, data binary, error string")


def dangling(manifests: DataFrame, blobs: DataFrame) -> DataFrame:
    """Manifest items without a blob. manifests: id, items (in one row or several); blobs: hash."""
    return manifests.select("id", F.explode("items").alias("hash")).join(blobs.select("hash"), "hash", "left_anti")
