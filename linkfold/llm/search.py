"""Exact top-k search: BM25 over an inverted index with block-max WAND pruning, run per shard and merged exactly.

Each shard of documents has its own index: sorted term hashes, and postings by blocks of documents, with the largest
count of each term in each block. Documents of a shard are put in order of their most frequent term and their length, so
that a block holds documents of one kind. The numbers that scores need from everywhere (documents, average length,
document frequencies) are counted over all shards first, so scores of different shards compare.

Queries come in blocks of a bounded number of bytes; each block meets all shards. For a query and a shard, terms are
parted as WAND parts them: rare terms bring documents in, terms that many documents have are held back. Rare terms'
lists are added up. A block of documents whose best such sum, with the block maxima of the terms held back, stays below
the query's k-th best score is skipped by all its cursors, and its postings of those terms aren't touched. The blocks
with the best bounds go first and raise the floor for the others. Shards are taken in rounds, each twice as large as
those before it together and spread over all shards: the k best so far give each query a floor for the next round, so a
round's tasks hand on a few times k rows a query however many they are, not k rows each. Documents that then reach the floor are scored afresh,
always in the order of term hashes, so equal texts have equal scores wherever they lie. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkfold.llm.common import Scratch, bounded_batches, map_batches, materialise, release_memory, slices, text_buffer, word_hashes

K1, B = 1.2, 0.75
#: Text and documents of one shard, about, and text of one block of queries.
SHARD_BYTES, SHARD_DOCUMENTS = 16 << 20, 16_384
QUERY_BYTES = 24 << 20
#: Documents of one block for block maxima, and queries that go through a shard together.
BLOCK, TOGETHER = 64, 256
#: Terms are held back where queries with the term times documents with it are more than this share of all pairs; at most so many.
HELD_BACK, HELD_TERMS = 1 / 200, 1024
#: Blocks of the best bounds that are scored before the others.
AHEAD = 2
#: Each round of a block of queries takes so many times as many shards as all rounds before it together.
ROUND = 2
_INDEX = {"ids": "<i8", "lengths": "<i8", "ptr": "<i8", "term": "<i4", "tf": "<i4", "vocabulary": "<u8", "df": "<i4", "block_ptr": "<i8", "block_term": "<i4", "block_tf": "<i4", "block_least": "<i8"}
_SCHEMA = ", ".join(f"{name} binary" for name in _INDEX)


def document_terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms (hash), counts and document of each distinct term, sorted by document and hash; and the documents' lengths."""
    words, wo = word_hashes(raw, off)
    terms, counts, owner = [], [], []
    for d, (a, b) in enumerate(zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True)):
        if b > a:
            t, c = np.unique(words[a:b], return_counts=True)
            terms.append(t)
            counts.append(c)
            owner.append(np.full(len(t), d, np.int32))
    if not terms:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.diff(wo)
    return np.concatenate(terms), np.concatenate(counts), np.concatenate(owner), np.diff(wo)


def _index_batch(parts: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
    lengths = np.concatenate([p[3] for p in parts]).astype(np.int64)
    base = np.cumsum([0] + [len(x) for x in ids])
    hashes = np.concatenate([p[0] for p in parts])
    tf = np.concatenate([p[1] for p in parts]).astype(np.int64)
    doc = np.concatenate([p[2] + b for p, b in zip(parts, base[:-1].tolist(), strict=True)]).astype(np.int64)
    vocabulary, term = np.unique(hashes, return_inverse=True)
    # Documents by their most frequent term (of equals the first), and by length.
    first = np.full(len(lengths), -1, np.int64)
    best = np.lexsort((-term, tf, doc))
    first[doc[best]] = term[best]
    order = np.lexsort((lengths, first))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by = np.lexsort((term, place[doc]))
    doc, term, tf = place[doc][by], term[by], tf[by]
    blocks = -(-len(order) // BLOCK)
    lengths = lengths[order]
    # Block maxima: the largest count of a term, and the least length, in a block.
    by = np.lexsort((term, doc // BLOCK))
    at, what = (doc // BLOCK)[by], term[by]
    starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (what[1:] != what[:-1])]) if len(by) else np.empty(0, np.int64)
    columns = {
        "ids": np.concatenate(ids)[order],
        "lengths": lengths,
        "ptr": np.searchsorted(doc, np.arange(len(order) + 1)),
        "term": term,
        "tf": tf,
        "vocabulary": vocabulary,
        "df": np.bincount(term, minlength=len(vocabulary)),
        "block_ptr": np.searchsorted(at[starts], np.arange(blocks + 1)),
        "block_term": what[starts],
        "block_tf": np.maximum.reduceat(tf[by], starts) if len(by) else tf,
        "block_least": np.minimum.reduceat(lengths, np.arange(0, len(lengths), BLOCK)),
    }
    return pa.RecordBatch.from_arrays([pa.array([columns[n].astype(kind).tobytes()], pa.binary()) for n, kind in _INDEX.items()], names=list(_INDEX))


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard. Rows with a null id are left out; a null text has no terms and matches nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, size = [], [], 0
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in ((a, min(a + 4096, end)) for start, end in slices(off) for a in range(start, end, 4096)):
                parts.append(document_terms(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
                ids.append(own[i:j])
                size += int(off[j] - off[i])
                if size >= shard_bytes or sum(map(len, ids)) >= SHARD_DOCUMENTS:
                    yield _index_batch(parts, ids)
                    parts, ids, size = [], [], 0
        if parts:
            yield _index_batch(parts, ids)
        release_memory()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where(F.col("id").isNotNull())
    return bounded_batches(rows).mapInArrow(run, _SCHEMA)


class Queries:
    """A block of queries: their ids, and their terms as numbers in the sorted vocabulary of all of them."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]) -> None:
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.vocabulary = np.unique(np.concatenate([t for _, t in rows]))
        self.ptr = np.cumsum([0] + [len(t) for _, t in rows])
        self.term = np.searchsorted(self.vocabulary, np.concatenate([t for _, t in rows])).astype(np.int32)
        self.asked = np.bincount(self.term, minlength=len(self.vocabulary))


class Shard:
    """An index row in memory, with term weights for a given average length and the idf of a block of queries."""

    def __init__(self, row: dict, average: float, queries: Queries, idf: np.ndarray) -> None:
        get = {name: np.frombuffer(row[name].as_buffer(), kind) for name, kind in _INDEX.items()}
        self.ids, self.ptr, self.term, self.tf = get["ids"], get["ptr"], get["term"], get["tf"]
        n = self.documents = len(self.ids)
        self.norm, least = (K1 * (1 - B + B * get[x] / max(average, 1e-9)) for x in ("lengths", "block_least"))
        own = get["vocabulary"]
        at = np.minimum(np.searchsorted(own, queries.vocabulary), max(len(own) - 1, 0))
        has = own[at] == queries.vocabulary if len(own) else np.zeros(len(at), bool)
        #: Of each query term, its number here or -1; and the idf of each term here, 0 for those not asked.
        self.here = np.where(has, at, -1)
        self.idf = np.zeros(len(own))
        self.idf[at[has]] = idf[has]
        # Terms that many documents and many queries have are held back.
        asked = np.zeros(len(own), np.int64)
        asked[at[has]] = queries.asked[has]
        pairs = asked * get["df"]
        held = np.flatnonzero(pairs > HELD_BACK * len(queries.ids) * n)
        held = held[np.argsort(-pairs[held], kind="stable")[:HELD_TERMS]]
        self.held = np.full(len(own), -1, np.int64)
        self.held[held] = np.arange(len(held))
        # Weights of the held terms by document, and their block maxima.
        owner = np.repeat(np.arange(n), np.diff(self.ptr))
        weight = (self.tf * (K1 + 1) / (self.tf + self.norm[owner]) * self.idf[self.term]).astype(np.float32)
        dense = self.held[self.term] >= 0
        self.weights = np.zeros((len(held), n), np.float32)
        self.weights[self.held[self.term[dense]], owner[dense]] = weight[dense]
        self.blocks = len(least)
        block = np.repeat(np.arange(self.blocks), np.diff(get["block_ptr"]))
        dense = self.held[get["block_term"]] >= 0
        what, most, block = get["block_term"][dense], get["block_tf"][dense], block[dense]
        self.maxima = np.zeros((len(held), self.blocks), np.float32)
        self.maxima[self.held[what], block] = most * (K1 + 1) / (most + least[block]) * self.idf[what]
        # Lists of the other terms that are asked.
        rest = np.flatnonzero((asked[self.term] > 0) & (self.held[self.term] < 0))
        rest = rest[np.argsort(self.term[rest], kind="stable")]
        self.list_ptr = np.searchsorted(self.term[rest], np.arange(len(own) + 1))
        self.list_doc, self.list_weight = owner[rest].astype(np.int32), weight[rest]
        self.flag = np.zeros(len(own), bool)
        #: Pairs of a query and a block of documents that held terms were added up for, and all such pairs.
        self.touched = self.all = 0

    def top(self, queries: Queries, rows: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For some queries, their documents that may be among the k best, and exact scores, given that k others reach `floor` already."""
        n = self.documents
        terms, _ = _ranges(queries.ptr, rows)
        owner = np.repeat(np.arange(len(rows)), np.diff(queries.ptr)[rows])
        term = self.here[queries.term[terms]]
        owner, term = owner[term >= 0], term[term >= 0]
        back = self.held[term] >= 0
        asks = np.zeros((len(rows), len(self.weights)), np.float32)
        asks[owner[back], self.held[term[back]]] = 1
        lists, sizes = _ranges(self.list_ptr, term[~back])
        score = np.bincount(np.repeat(owner[~back] * n, sizes) + self.list_doc[lists], weights=self.list_weight[lists], minlength=len(rows) * n).astype(np.float32).reshape(len(rows), n)
        bound = np.maximum.reduceat(score, np.arange(0, n, BLOCK), axis=1) + asks @ self.maxima
        slack = 1e-4 * (1 + bound.max(axis=1))
        floor = np.maximum(floor[rows], 1e-6)
        rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
        open_, whole = bound > 0, np.zeros(bound.shape, bool)
        self.all += open_.size
        for first in (True, False):
            live = open_ & ~whole & (bound >= (floor - slack)[:, None])
            if first:
                live &= rank < AHEAD
            for b in range(self.blocks):
                some = live[:, b].nonzero()[0]
                if len(some):
                    score[some, b * BLOCK : (b + 1) * BLOCK] += asks[some] @ self.weights[:, b * BLOCK : (b + 1) * BLOCK]
            whole |= live
            self.touched += int(live.sum())
            if not first:
                score *= np.repeat(whole, BLOCK, axis=1)[:, :n]
            # What is added up so far is no more than the documents' scores: a floor for the rest.
            if n > k:
                floor = np.maximum(floor, np.partition(score, n - k, axis=1)[:, n - k] - slack)
        found, docs = (score >= np.maximum(floor - slack, 1e-7)[:, None]).nonzero()
        cut = np.searchsorted(found, np.arange(len(rows) + 1))
        for r in np.flatnonzero(np.diff(cut)).tolist():
            own = self.here[queries.term[queries.ptr[rows[r]] : queries.ptr[rows[r] + 1]]]
            yield int(rows[r]), *self._exact(own[own >= 0], docs[cut[r] : cut[r + 1]], k)

    def _exact(self, terms: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        self.flag[terms] = True
        at, sizes = _ranges(self.ptr, docs)
        owner = np.repeat(np.arange(len(docs)), sizes)
        asked = self.flag[self.term[at]]
        at, owner = at[asked], owner[asked]
        self.flag[terms] = False
        tf = self.tf[at]
        added = (tf * (K1 + 1) / (tf + self.norm[docs[owner]]) * self.idf[self.term[at]]).tolist()
        ends = np.searchsorted(owner, np.arange(len(docs) + 1)).tolist()
        scores = np.array([math.fsum(added[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
        best = np.lexsort((self.ids[docs], -scores))[:k]
        best = best[scores[best] > 0]
        return self.ids[docs[best]], scores[best]


def _ranges(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the given rows' entries one after the other, and the rows' numbers of entries."""
    start, sizes = ptr[rows], ptr[rows + 1] - ptr[rows]
    return np.arange(int(sizes.sum())) + np.repeat(start - np.r_[0, np.cumsum(sizes)[:-1]], sizes), sizes


def rounds(files: list[str]) -> list[list[str]]:
    """The files in rounds, each spread over all of them and ROUND times as large as those before it, about."""
    step, out, taken = 1, [], set()
    while step * (ROUND + 1) < len(files):
        step *= ROUND + 1
    while step:
        out.append([f for i, f in enumerate(files) if i % step == 0 and i not in taken])
        taken.update(range(0, len(files), step))
        step //= ROUND + 1
    return [x for x in out if x]


def search_shards(index: DataFrame, queries: Queries, k: int, documents: int, average: float, floors: np.ndarray, frequency: np.ndarray) -> DataFrame:
    """Each task's k best for each query over its shards, those below the query's floor left out: query_id, doc_id, score."""
    idf = np.log1p((documents - frequency + 0.5) / (frequency + 0.5))
    shared = index.sparkSession.sparkContext.broadcast((queries, idf, floors))  # bounded by QUERY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, idf, floors = shared.value
        floor, count = floors.copy(), len(queries.ids)
        # The k best so far of each query, best first: arrays, as tuples of all queries of a block take tens of MB.
        scores_, ids_, held = np.empty((count, k)), np.empty((count, k), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard({n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}, average, queries, idf)
                if not len(shard.term):
                    continue
                for a in range(0, count, TOGETHER):
                    for q, ids, scores in shard.top(queries, np.arange(a, min(a + TOGETHER, count)), k, floor):
                        # k others reach the floor already; at the floor itself ids decide.
                        ids, scores = ids[scores >= floor[q]], scores[scores >= floor[q]]
                        all_scores, all_ids = np.r_[scores_[q, : held[q]], scores], np.r_[ids_[q, : held[q]], ids]
                        top = np.lexsort((all_ids, -all_scores))[:k]
                        held[q] = n = len(top)
                        scores_[q, :n], ids_[q, :n] = all_scores[top], all_ids[top]
                        if n == k:
                            floor[q] = max(floor[q], scores_[q, k - 1])
                del shard
            del batch
        step = max(1, 20_000 // max(k, 1))
        for a in range(0, count, step):
            used = np.arange(k) < held[a : a + step, None]
            owner = np.repeat(queries.ids[a : a + step], held[a : a + step])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(ids_[a : a + step][used]), pa.array(scores_[a : a + step][used])], names=["query_id", "doc_id", "score"])
        release_memory()

    return index.mapInArrow(run, "query_id long, doc_id long, score double")


def frequencies(index: DataFrame, asked: DataFrame) -> DataFrame:
    """block, term (hash as a long), n: documents over all shards that hold the term, for each term that a block's queries ask for.

    A shard hands on its own terms, once for all blocks: rows grow with the shards, not with shards times queries."""

    def held(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(i)[r].as_buffer(), kind)) for i, kind in enumerate(("<i8", _INDEX["df"]))], names=["term", "n"])

    def wanted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of = batch.column(1).to_numpy()
        for b in np.unique(of).tolist():
            terms = np.unique(np.concatenate([np.frombuffer(batch.column(0)[r].as_buffer(), "<i8") for r in np.flatnonzero(of == b).tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), b, np.int64)), pa.array(terms)], names=["block", "term"])

    counts = map_batches(index.select("vocabulary", "df"), held, "term long, n int").groupBy("term").agg(F.sum("n").alias("n"))
    terms = map_batches(asked.select("terms", "block"), wanted, "block long, term long").distinct()
    # Neither side is small on large tables; one block's rows lie together in each file.
    return terms.hint("merge").join(counts, "term").select("block", "term", "n").sortWithinPartitions("block")


def _query_terms(asked: DataFrame) -> DataFrame:
    """id and sorted term hashes of each query."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, off = text_buffer(batch.column(1))
        for i, j in slices(off):
            terms, _, owner, _ = document_terms(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            cut = np.searchsorted(owner, np.arange(j - i + 1)).tolist()
            sets = [terms[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(sets, pa.binary()), batch.column(2)[i:j]], names=["id", "terms", "block"])

    return map_batches(asked, run, "id long, terms binary, block long")


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", query_bytes: int = QUERY_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, doc_id, score: for each query (its text's distinct words) the k best documents of all.

    Words are runs of other than blank and \\x09-\\x0D, A-Z lower-cased. A document with no word of the query is no
    result; a query without words, or with a null id, has none; of queries with one id the least text counts. Rows of
    docs with one id are documents of their own. Texts of any length are taken whole; an empty table has no results.
    Columns other than the two are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        # A file for each shard: a row group or an Arrow batch never holds several, in writing or reading.
        index = scratch.keep(build_index(docs, id_column, text_column, shard_bytes), "index", compression="lz4", maxRecordsPerFile="1")

        def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lengths = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, lengths))]), pa.array([int(sum(x.sum() for x in lengths))])], names=["n", "words"])

        stats = map_batches(index.select("lengths"), count, "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        documents, average = int(stats["n"] or 0), (stats["words"] or 0) / max(stats["n"] or 0, 1)
        asked = queries.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
        size = asked.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
        blocks = max(1, math.ceil(size / query_bytes))
        asked = asked.groupBy("id").agg(F.min("text").alias("text")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        asked = scratch.keep(_query_terms(asked).repartition("block"), "queries")
        files = sorted(index.inputFiles())
        counted = scratch.keep(frequencies(index, asked), "frequencies")
        parts: list[DataFrame] = []
        for b in range(blocks):
            rows = asked.where(F.col("block") == b).toArrow().to_pylist()
            wanted = [(r["id"], np.frombuffer(r["terms"], np.uint64)) for r in sorted(rows, key=lambda r: r["id"]) if r["terms"]]
            if not wanted or not files:
                continue
            block = Queries(wanted)
            table = counted.where(F.col("block") == b).select("term", "n").toArrow()  # at most one row for each term of a bounded block of queries
            frequency = np.zeros(len(block.vocabulary), np.int64)
            frequency[np.searchsorted(block.vocabulary, table.column("term").to_numpy().view(np.uint64))] = table.column("n").to_numpy()
            floors, best = np.zeros(len(wanted)), None
            order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
            for some in (turns := rounds(files)):
                found = search_shards(spark.read.schema(index.schema).parquet(*some), block, k, documents, average, floors, frequency)
                found = (found if best is None else found.unionByName(best)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                if some is turns[-1]:
                    # Each block's results are written before the next begins: k rows a query.
                    parts.append(materialise(found.select("query_id", "rank", "doc_id", "score"), "found"))
                    break
                best = scratch.keep(found.select("query_id", "doc_id", "score"), "best")
                kth = {r["query_id"]: r["kth"] for r in best.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
                floors = np.array([kth.get(q, 0.0) for q, _ in wanted])
        if not parts:
            return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
        return spark.read.schema(parts[0].schema).parquet(*[f for p in parts for f in p.inputFiles()])
