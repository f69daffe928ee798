"""Bounded-space online packing of documents into fixed-size token windows.

Each partition is one stream with a fixed number of open windows. A piece goes to the open window it fits best (the
least room left). If none has room, the fullest is filled up with the front of the piece, emitted, and a new window
opens for the rest; so a window is emitted full. At the end of the partition the open windows are merged into full
ones, and what remains is cut at powers of two, where a sequence needs no padding. No data moves between partitions
and memory is the open windows plus one document, whatever the size of the corpus; a retried task gives the same
pieces, as ids depend only on the order of rows in a partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.llm.common import bounded_batches, release_memory, slices, text_buffer
from linkfold.llm.tokens import CALL_BYTES, encoder

SCHEMA = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
#: Sequence ids of a partition begin at its number times this.
STRIDE = 1 << 36

Piece = tuple  # (document, start, length, doc_tokens, ids)


class Packer:
    """Open windows of one stream. `add` and `finish` yield finished windows as lists of pieces."""

    def __init__(self, size: int = 2048, windows: int = 16) -> None:
        self.size, self.windows = size, windows
        self.open: list[tuple[int, list[Piece]]] = []  # (tokens, pieces)

    def add(self, doc: int | None, ids: bytes) -> Iterator[list[Piece]]:
        total, start = len(ids) // 4, 0
        while start < total:
            rest = total - start
            if rest >= self.size:
                yield [self._piece(doc, ids, start, self.size, total)]
                start += self.size
                continue
            fits = [(self.size - used, i) for i, (used, _) in enumerate(self.open) if self.size - used >= rest]
            if fits:
                _, i = min(fits)
                take = rest
            elif len(self.open) < self.windows:
                self.open.append((0, []))
                i, take = len(self.open) - 1, rest
            else:
                i = max(range(len(self.open)), key=lambda j: self.open[j][0])
                take = self.size - self.open[i][0]
            used, pieces = self.open[i]
            pieces.append(self._piece(doc, ids, start, take, total))
            start += take
            self.open[i] = (used + take, pieces)
            if used + take == self.size:
                yield self.open.pop(i)[1]

    @staticmethod
    def _piece(doc: int | None, ids: bytes, start: int, length: int, total: int) -> Piece:
        return doc, start, length, total, ids[4 * start : 4 * (start + length)]

    def finish(self) -> Iterator[list[Piece]]:
        """Merges the open windows, fullest first, into full sequences; the last is cut at powers of two."""
        rest = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open = []
        left = sum(p[2] for p in rest)
        while left:
            want = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            sequence, have = [], 0
            while have < want:
                doc, start, length, total, ids = rest.pop(0)
                take = min(length, want - have)
                sequence.append((doc, start, take, total, ids[: 4 * take]))
                if take < length:
                    rest.insert(0, (doc, start + take, length - take, total, ids[4 * take :]))
                have += take
            left -= want
            yield sequence


def pack_stream(documents: Iterable[tuple[int | None, bytes]], size: int, windows: int) -> Iterator[list[Piece]]:
    packer = Packer(size, windows)
    for doc, ids in documents:
        yield from packer.add(doc, ids)
    yield from packer.finish()


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = "byte_bpe_50k.json", size: int = 2048, windows: int = 16) -> DataFrame:
    """Pieces of packed sequences, see SCHEMA; ids are little-endian unsigned 32-bit.

    Each id of each document, its end id included, lies in exactly one piece. A null or empty text is its end id
    alone; repeated rows are packed each time; a null id stays null; an empty table gives no rows. `size` must be a
    power of two.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        for batch in batches:
            _, off = text_buffer(batch.column(1))
            for i, j in slices(off, CALL_BYTES):
                ids, ends = encoder(vocabulary).encode_column(batch.column(1)[i:j])
                raw = memoryview(ids).cast("B")
                for doc, a, b in zip(batch.column(0)[i:j].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    yield doc, bytes(raw[4 * a : 4 * b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * STRIDE
        rows: list[tuple] = []
        for sequence in pack_stream(documents(batches), size, windows):
            offset = 0
            for doc, start, length, total, ids in sequence:
                rows.append((doc, start, length, total, number, offset, ids))
                offset += length
            number += 1
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)
        release_memory()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return bounded_batches(rows).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def pack_digest(pieces: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select(F.col("id").alias(id_column), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
