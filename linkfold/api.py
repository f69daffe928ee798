"""The engine's verbs on DataFrames of links (columns seq and url) and codes (column code)."""

from __future__ import annotations

import socket
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.functions import codec, kernels
from linkfold.operators import objects, statistics, store


class UnknownProfile(LookupError):
    """No profile of this name is stored."""


@dataclass(frozen=True)
class Profile:
    """A byte profile: frequencies of 256 symbols that sum to 4096, and the first character of its codes."""

    freqs: tuple[int, ...]
    tag: str = "0"

    @property
    def id(self) -> str:
        return kernels.blake3([self.bytes])[0].hex()

    @property
    def bytes(self) -> bytes:
        """512 bytes, 16 bits for each symbol, least byte first."""
        return b"".join(f.to_bytes(2, "little") for f in self.freqs)

    @staticmethod
    def of(data: bytes, tag: str = "0") -> Profile:
        if len(data) != 512:
            raise kernels.CodecError("a profile has 512 bytes")
        return Profile(tuple(max(1, int.from_bytes(data[i : i + 2], "little")) for i in range(0, 512, 2)), tag)


def generic() -> Profile:
    return Profile(kernels.generic_frequencies())


def encode(links: DataFrame, profile: Profile | None = None) -> DataFrame:
    """links with their stateless code; null stays null, an empty link has an empty code."""
    p = profile or generic()
    return links.withColumn("code", kernels.encode_udf(p.freqs, p.tag)(F.col("url")))


def resolve(codes: DataFrame, profile: Profile | None = None, strict: bool = False) -> DataFrame:
    """codes with url and error; strict raises at the first error instead."""
    out = codes.withColumn("__r", kernels.resolve_udf(profile.freqs if profile else None)(F.col("code")))
    url = F.when(F.col("__r.error").isNotNull(), F.raise_error(F.col("__r.error"))).otherwise(F.col("__r.url")) if strict else F.col("__r.url")
    return out.withColumns({"url": url, "error": F.col("__r.error")}).drop("__r")


def batch(codes: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Lines of codes, trimmed, blank ones dropped; the first that fails raises."""
    return resolve(codes.withColumn("code", F.trim("code")).where("code != ''"), profile, strict=True).drop("error")


def shorten(links: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """links with their key: the stateless code, or the shortest free key where that is shorter."""
    spark = links.sparkSession
    held = held if held is not None else spark.createDataFrame([], "key string, url string")
    coded = encode(links.select("seq", "url"))
    wide = store.blake3_keys(coded)
    names = wide.select("url", F.length("code").alias("__code"), *[f"k{n}" for n in store.LENGTHS]).distinct()
    placed = store.allocate(wide, held, key=lambda _, n: F.col(f"k{n}"), code_length=F.col("__code"), carry=names)
    return coded.join(placed.select("seq", "key"), "seq").select("seq", "url", F.coalesce("key", "code").alias("key"), F.col("key").isNotNull().alias("stored"))


def expand(keys: DataFrame, held: DataFrame) -> DataFrame:
    return store.expand(held, keys)


def train(links: DataFrame, tag: str = "c") -> Profile:
    """A profile of a corpus; an empty corpus gives the generic one. 256 rows come to the driver."""
    if links.limit(1).count() == 0:
        return generic()
    rows = statistics.frequency_table(statistics.histogram(links)).orderBy("sym").collect()
    return Profile(tuple(r["freq"] for r in rows), tag)


def merge(profiles: Iterable[Profile]) -> Profile:
    """Frequencies added and scaled anew; none gives the generic profile, one itself."""
    found = list(profiles)
    if len(found) < 2:
        return found[0] if found else generic()
    counts = reduce(lambda a, b: [x + y for x, y in zip(a, b, strict=True)], [list(p.freqs) for p in found])
    return Profile(tuple(kernels.frequencies(counts)), found[0].tag)


def save(spark: SparkSession, profile: Profile, path: str) -> None:
    """One row under the profile's id."""
    row = spark.createDataFrame([(profile.id, profile.tag, bytearray(profile.bytes))], "id string, tag string, freqs binary")
    row.coalesce(1).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, profile_id: str) -> Profile:
    row = spark.read.parquet(path).where(F.col("id") == profile_id).first()
    if row is None:
        raise UnknownProfile(profile_id)
    return Profile.of(bytes(row["freqs"]), row["tag"])


fetch = load


def export(codes: DataFrame, group: str = "g") -> DataFrame:
    return objects.export(codes, group, "code")


def open_container(containers: DataFrame) -> DataFrame:
    """The codes of containers, decoded: the columns beside `container`, code, url, error."""
    found = objects.unpack(containers)
    out = found.withColumn("code", F.decode("data", "UTF-8")).withColumnRenamed("error", "__damage")
    return resolve(out).withColumn("error", F.coalesce("__damage", "error")).drop("__damage", "data", "hash")


def stat(events: DataFrame, key: str = "key", at: str = "ts") -> DataFrame:
    """Accesses and last access of each key."""
    return events.groupBy(key).agg(F.count("*").alias("hits"), F.max(at).alias("last"))


def verify(containers: DataFrame, column: str = "container") -> DataFrame:
    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v is not None and objects.verify(bytes(v)))

    return containers.withColumn("ok", run(F.col(column)))


def probe(url: str, seconds: float = 2.0) -> str:
    """State of one link: by its scheme, else a HEAD request over plain HTTP, or a connection only for https."""
    parts = urlsplit(url)
    if url.startswith(("mailto:", "ipfs://", "magnet:", "urn:")):
        return "Alive"
    if parts.scheme not in ("http", "https"):
        return "Unknown"
    try:
        with socket.create_connection((parts.hostname or "", parts.port or (443 if parts.scheme == "https" else 80)), seconds) as s:
            if parts.scheme == "https":
                return "Alive"
            s.settimeout(seconds)
            s.sendall(f"HEAD {parts.path or '/'} HTTP/1.1\r\nHost: {parts.hostname}\r\nConnection: close\r\n\r\n".encode())
            status = int(s.recv(64).split()[1])
    except (OSError, ValueError, IndexError):
        return "Error"
    if status in (301, 308):
        return "Changed"
    return "Alive" if 200 <= status < 300 or 302 <= status <= 307 else "Dead" if status in (404, 410) else "Error"


def check(links: DataFrame) -> DataFrame:
    """links with their state; links that the scheme does not settle are asked over the network, by task."""

    @F.pandas_udf("string")
    def run(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: None if u is None else probe(u))

    return links.withColumn("state", F.coalesce(codec.liveness_by_scheme(F.col("url")), run(F.col("url"))))


def register(spark: SparkSession) -> None:
    """SQL functions: link_encode, link_resolve, link_digest, base66_encode, base66_decode."""
    spark.udf.register("link_encode", kernels.encode_udf())
    spark.udf.register("link_resolve", kernels.resolve_udf())
    spark.udf.register("link_digest", kernels.blake3_udf)
    spark.udf.register("base66_encode", kernels.base66_udf)
    spark.udf.register("base66_decode", kernels.base66_decode_udf)
