"""Token ids as ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Rows are range-partitioned and sorted by document id before they are encoded, so that files and stripes hold narrow
ranges of ids: readers take stripes in parallel, and a lookup skips files, stripes and row groups by their minima,
maxima and Bloom filters. A file's rows carry their offset within the file's part; the parts' sizes, one number
each, turn it into the offset among all ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.llm.common import bounded_batches, map_batches, release_memory, slices, text_buffer
from linkfold.llm.tokens import CALL_BYTES, encoder

SCHEMA = "part int, id long, part_start long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "2000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.encoding.strategy": "SPEED",
}


def encode_sorted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = "word_bpe_49k.json", parts: int | None = None) -> DataFrame:
    """Rows of SCHEMA in ascending order of id, null first; rows with one id are in the order of their text's hash.

    A null or empty text is its end id alone. Repeated rows stay repeated: one id's rows may lie in several parts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, off = text_buffer(batch.column(1))
            for i, j in slices(off, CALL_BYTES):
                values, ends = encoder(vocabulary).encode_column(batch.column(1)[i:j])
                sizes, starts = np.diff(ends), start + ends
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view("<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, part, np.int32)), batch.column(0)[i:j], pa.array(starts[:-1]), pa.array(sizes), ids], schema=_ARROW)
                start = int(starts[-1])
        release_memory()

    return bounded_batches(ranged).mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, **encode: object) -> None:
    encode_sorted(docs, **encode).write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents with their ids and `start`, the number of ids of all documents before them: id, start, n_tokens, ids."""
    stored = spark.read.schema(SCHEMA).orc(path)
    sizes = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n")).collect())
    bases = list(accumulate((n for _, n in sizes), initial=0))
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, bases, strict=False)], "part int, base long")
    # One row for each file part: as small as the list of files that the driver holds anyway.
    return stored.join(F.broadcast(base), "part").select("id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter reaches the ORC reader's statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("id").isin(ids)).select("id", "n_tokens", "ids")


def ids_digest(stored: DataFrame) -> DataFrame:
    """Unsigned crc32 of each document's ids as little-endian unsigned 32-bit integers, in place of the ids."""

    def digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(3)
        off = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return map_batches(stored.select("id", "start", "n_tokens", "ids"), digest, "id long, start long, n_tokens long, ids_crc32 long")
