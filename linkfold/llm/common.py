"""Shared pieces of the corpus operators: scratch tables, Arrow text buffers, word and shingle hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space of the word definition `[^\x20\x09-\x0D]+`.
WORD_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Texts are handled in slices of about this many bytes, so that memory follows one slice and not an Arrow batch.
SLICE_BYTES = 1 << 19
#: Rows of one Arrow batch: with texts of any length, memory of JVM and worker follows the batch.
BATCH_ROWS = 2000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(WORD_SPACE)] = False
_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LANES = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018 - glibc alone has it
except (OSError, AttributeError):
    _libc = None


@functools.cache
def _own_root() -> str:
    return f"file://{tempfile.mkdtemp(prefix='linkfold-')}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder named by spark.checkpoint.dir. Where that is unset, a folder of our own serves in
    local mode, where driver and executors are one process; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_root()
    return f"{root.rstrip('/')}/linkfold-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back: lineage ends at files that outlive any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Scratch tables of one operator's run: each is removed when no later step reads it, at the latest by `close`.
    What the operator's lazy result reads is written with `materialise` instead, and stays."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            drop_path(self.spark, self.paths.pop(id(df))[1])

    def close(self) -> None:
        for _, path in self.paths.values():
            drop_path(self.spark, path)
        self.paths = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()


def free_name(base: str, *taken: Iterable[str]) -> str:
    """A column name that none of the taken ones equals, whatever their case."""
    have = {x.lower() for names in taken for x in names}
    while base.lower() in have:
        base += "_"
    return base


def release_memory() -> None:
    """Gives freed memory back to the system: workers are reused, and what one stage took stays with them otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches at most BATCH_ROWS rows; a lower setting stays. The setting is read when a plan
    runs, after the operator has returned it, so it stays with the session; it changes the size of batches alone."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; empty partitions give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        release_memory()

    return bounded_batches(df).mapInArrow(run, schema)


def filter_batches(df: DataFrame, text_column: str, mask: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows whose text passes, with all columns as they are: a scan, without a join back to the rows. Columns are found
    by place, so their names don't matter; `mask` decides about null and empty texts; an empty table stays empty."""
    at = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(mask(batch.column(at))))
        release_memory()

    return bounded_batches(df).mapInArrow(run, df.schema)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the offsets between them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes each; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 256), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, A-Z lower-cased, and the offsets of the texts' words."""
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    low = _LOWER[raw]
    is_word = _IS_WORD[low]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    begins[first] = is_word[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    place = np.arange(n, dtype=np.int64)
    place -= np.maximum.accumulate(np.where(begins, place, 0))
    powers = _power_table(int(place[is_word].max()) + 1)
    place[~is_word] = 0
    value = _BYTE_VALUE[low] * powers[place]
    value[~is_word] = 0
    return mix64(np.add.reduceat(value, starts)), np.searchsorted(starts, off)


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's `width`-word shingles, one text after the other, and the offsets
    between texts; fewer words count as one shingle, no words as none."""
    words, wo = word_hashes(raw, off)
    sizes = np.diff(wo)
    lanes = _LANES[:width]
    if len(words) >= width:
        grams = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            grams += words[j : len(words) - width + 1 + j] * lanes[j]
        grams = mix64(grams)
    else:
        grams = np.empty(0, np.uint64)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    ends = np.r_[0, np.cumsum(counts)]
    flat = np.empty(int(ends[-1]), np.uint64)
    for a, n, x, y in zip(wo[:-1].tolist(), sizes.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if n >= width:
            flat[x:y] = grams[a : a + y - x]
            flat[x:y].sort()
        elif n:
            part = words[a : a + n] * lanes[:n]
            flat[x:y] = mix64(np.add.reduce(part, keepdims=True) + np.uint64(n))
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[ends[:-1][ends[:-1] < ends[1:]]] = True
    return flat[keep], np.r_[0, np.cumsum(keep)][ends]
