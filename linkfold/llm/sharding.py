"""Shards with size-tiered compaction and an atomically committed, versioned manifest.

Arrivals are appended as small immutable shards. Shards whose sizes are within one tier (a power of `fanout`) are
merged, as soon as there are `fanout` of them, into files of a target size, oldest first. Every change is a new
manifest: a file of the next version, written aside and renamed into place, where a rename over an existing version
fails. Readers take the newest version and never see files of an unfinished change. Each change writes to a folder of
its own name, so a writer that fails or loses a commit leaves nothing in another's way, and appending again works.
Files are removed apart from commits, by `clean`: those that none of the newest versions names, so that readers of a
recent version still find theirs.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.llm.common import free_name


class VersionGone(RuntimeError):
    """The version was cleaned away."""


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    name: str
    files: list[str]  # in order, relative to the store
    size: int  # bytes
    first: int  # number of the first arrival in it
    last: int


class ShardStore:
    """A table of shards under `root`, a path of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, root: str, schema, target_bytes: int = 64 << 20, fanout: int = 4, base_bytes: int = 1 << 16, keep_versions: int = 2) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.fanout, self.base_bytes, self.keep_versions = target_bytes, fanout, base_bytes, keep_versions
        self.file_column = free_name("file", schema.names)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, relative: str):
        return self._hadoop.Path(f"{self.root}/{relative}" if relative else self.root)

    # Manifest -------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The newest version, 0 without any."""
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        path = self._path(f"manifest/v{version:010d}.json")
        if not self._fs.exists(path):
            raise VersionGone(f"there is no version {version} any more")
        stream = self._fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, version: int, shards: list[Shard]) -> None:
        """Puts version + 1 in place, or raises CommitConflict."""
        body = json.dumps({"version": version + 1, "shards": [asdict(s) for s in shards]})
        aside = self._path(f"manifest/.v{version + 1:010d}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(aside.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.NONE
        try:
            context.rename(aside, self._path(f"manifest/v{version + 1:010d}.json"), options)
        except Exception as e:
            self._fs.delete(aside, False)
            raise CommitConflict(f"version {version + 1} is there already") from e

    # Writing --------------------------------------------------------------------------------------------------

    def _files(self, folder: str) -> tuple[list[str], int]:
        found = [s for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")] if self._fs.exists(self._path(folder)) else []
        found.sort(key=lambda s: s.getPath().getName())
        return [f"{folder}/{s.getPath().getName()}" for s in found], sum(s.getLen() for s in found)

    def append(self, rows: DataFrame, arrivals: int, key: str, tries: int = 3) -> None:
        """Splits rows by a hash of `key` into arrivals, written by one job, committed one after the other; after
        each, tiers that are full are merged. An arrival without rows is no shard. Where another writer commits
        first, the newest version is read and the commit is tried again; what is written already is not written again."""
        batch, number = f"data/a-{uuid.uuid4().hex}", free_name("arrival", self.schema.names)
        split = F.pmod(F.xxhash64(key), F.lit(arrivals)).cast("int")
        rows.select(*self.schema.names).withColumn(number, split).write.partitionBy(number).parquet(f"{self.root}/{batch}")
        for k in range(arrivals):
            files, size = self._files(f"{batch}/{number}={k}")
            if files:
                self.add(files, size, tries)

    def add(self, files: list[str], size: int, tries: int = 3) -> None:
        """Commits written files as the next arrival, and merges what is due."""
        for left in reversed(range(tries)):
            version = self.version()
            have = self.shards(version)
            at = max((s.last for s in have), default=-1) + 1
            try:
                self.commit(version, [*have, Shard(f"arrival-{at}", files, size, at, at)])
                break
            except CommitConflict:
                if not left:
                    raise
        self.compact(version + 1)

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.base_bytes, self.fanout))) if size > self.base_bytes else 0

    def due(self, shards: list[Shard]) -> list[Shard]:
        """The lowest tier's oldest shards that are to be merged, or none."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: s.first):
            tiers.setdefault(self.tier(s.size), []).append(s)
        return next((tiers[t][: self.fanout] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self, version: int) -> int:
        """Merges until no tier is full. Returns the newest version; where another writer commits first, merging is left
        to it."""
        while group := self.due(have := self.shards(version)):
            folder = f"data/m-{uuid.uuid4().hex}"
            size = sum(s.size for s in group)
            # Each task takes files of about the target size and writes one: rows aren't shuffled.
            self._scan(group).coalesce(max(1, round(size / self.target_bytes))).write.parquet(f"{self.root}/{folder}")
            files, size = self._files(folder)
            merged = Shard(f"merged-{version}", files, size, min(s.first for s in group), max(s.last for s in group))
            gone = {s.name for s in group}
            try:
                self.commit(version, [s for s in have if s.name not in gone] + [merged])
            except CommitConflict:
                self._fs.delete(self._path(folder), True)
                return self.version()
            version += 1
            self.clean()
        return version

    def clean(self) -> None:
        """Removes the versions before the newest `keep_versions`, and the files that they alone named. Folders of
        unfinished changes stay, as their writers may still commit them."""
        newest = self.version()
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifest"))]
        old = sorted(v for n in names if n.startswith("v") and n.endswith(".json") and (v := int(n[1:-5])) <= newest - self.keep_versions)
        if not old:
            return
        named = {f for v in range(max(1, newest - self.keep_versions + 1), newest + 1) for s in self.shards(v) for f in s.files}
        gone = {f for v in old for s in self.shards(v) for f in s.files} - named
        for v in old:
            self._fs.delete(self._path(f"manifest/v{v:010d}.json"), False)
        for f in gone:
            self._fs.delete(self._path(f), False)

    # Reading --------------------------------------------------------------------------------------------------

    def _scan(self, shards: list[Shard]) -> DataFrame:
        files = [f"{self.root}/{f}" for s in shards for f in s.files]
        return self.spark.read.schema(self.schema).parquet(*files).select(*self.schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with one more column, `file_column`: the file that a row lies in, relative to the store.
        It is called `file`, with underscores after it where the schema has that name."""
        shards = sorted(self.shards(version), key=lambda s: s.first)
        if not shards:
            return self.spark.createDataFrame([], self.schema).withColumn(self.file_column, F.lit(""))
        files = [f"{self.root}/{f}" for s in shards for f in s.files]
        name = F.regexp_extract(F.replace(F.input_file_name(), F.lit("%3D"), F.lit("=")), "(data/[am]-[^/]*/.*)$", 1)
        return self.spark.read.schema(self.schema).parquet(*files).select(*self.schema.names, name.alias(self.file_column))


def shard_documents(docs: DataFrame, root: str, arrivals: int = 16, id_column: str = "doc_id", **options: int) -> ShardStore:
    """Appends docs as `arrivals` arrivals. Null ids go together in one; repeated rows stay repeated; rows are written as
    they are, with texts of any length and columns of any names; an empty table gives an empty store."""
    store = ShardStore(docs.sparkSession, root, docs.schema, **options)
    store.append(docs, arrivals, id_column)
    return store
