import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from linkfold.llm import search
from linkfold.llm.common import text_buffer
from linkfold.llm.search import B, K1, top_k


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(docs, queries, k):
    bags = [(i, Counter(words(t))) for i, t in docs if i is not None]
    n, average = len(bags), sum(sum(b.values()) for _, b in bags) / max(len(bags), 1)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for q, text in queries:
        if q is None:
            continue
        found, asked = [], set(words(text))
        for i, bag in bags:
            size = sum(bag.values())
            s = math.fsum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * (K1 + 1) / (bag[w] + K1 * (1 - B + B * size / average)) for w in asked if bag[w])
            if s > 0:
                found.append((-s, i))
        out += [(q, r + 1, i, pytest.approx(-s, rel=1e-9)) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


def corpus(seed, n):
    r = random.Random(seed)
    names = [f"w{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(r.choices(names, weight, k=r.randint(1, 60)))) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(25)]  # ties
    return rows + [(n + 30, None), (n + 31, ""), (n + 32, "ONLY here"), (None, "w1 w2")]


@pytest.mark.parametrize(("shard_bytes", "query_bytes"), [(1 << 25, 1 << 25), (2000, 500)])
def test_against_brute_force(spark, shard_bytes, query_bytes):
    rows = corpus(1, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [x for x in rows if x[0] is not None and x[0] % 7 == 3] + [(331, ""), (333, "only HERE w5")]
    asked.append(asked[0])
    out = top_k(docs, spark.createDataFrame(asked, "doc_id long, text string"), 5, query_bytes=query_bytes, shard_bytes=shard_bytes)
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in out.collect())
    assert got == sorted(brute(rows, asked[:-1], 5), key=lambda x: x[:2])


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert top_k(empty, empty).count() == 0
    assert top_k(empty, spark.createDataFrame([(1, "a")], "doc_id long, text string")).count() == 0


def test_blocks_are_skipped_and_results_stay_exact():
    r = random.Random(5)
    kinds = [[f"{k}{i}" for i in range(300)] for k in "ab"]
    weight = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(r.choices(kinds[i % 2], weight, k=r.randint(5, 80))) for i in range(2000)]
    raw, off = text_buffer(pa.array(texts))
    row = search._index_batch([search.document_terms(raw, off)], [np.arange(2000)])
    names = {n: row.column(i)[0] for i, n in enumerate(row.schema.names)}
    average = sum(len(t.split()) for t in texts) / 2000
    asked = [(i, np.unique(search.word_hashes(*text_buffer(pa.array([texts[i]])))[0])) for i in range(0, 2000, 50)]
    queries = search.Queries(asked)
    df = Counter(w for t in texts for w in set(t.split()))
    number = {int(search.word_hashes(*text_buffer(pa.array([w])))[0][0]): n for w, n in df.items()}
    frequency = np.array([number[int(h)] for h in queries.vocabulary])
    shard = search.Shard(names, average, queries, np.log1p((2000 - frequency + 0.5) / (frequency + 0.5)))
    got = {q: list(zip(ids.tolist(), scores.tolist(), strict=True)) for q, ids, scores in shard.top(queries, np.arange(len(asked)), 5, np.zeros(len(asked)))}
    for q, (i, _) in enumerate(asked):
        want = brute(list(enumerate(texts)), [(i, texts[i])], 5)
        assert [d for d, _ in got[q]] == [w[2] for w in want] and [s for _, s in got[q]] == [w[3] for w in want]
    assert 0 < len(shard.weights) and shard.touched < 0.6 * shard.all


def test_long_texts_many_short_ones_and_clashing_names(spark):
    rows = [(i, f"w{i % 50}", "a", 1) for i in range(6000)] + [(9000, " ".join(f"w{i % 700}" for i in range(300_000)), "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, rank int")
    out = top_k(docs, docs.where("doc_id in (7, 9000)"), 4).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in out) == [(r[0], r[1], r[2]) for r in sorted(brute([x[:2] for x in rows], [rows[7][:2], rows[-1][:2]], 4))]


def test_each_shard_is_a_file_of_its_own(spark, monkeypatch):
    seen, frequencies = [], search.frequencies
    monkeypatch.setattr(search, "frequencies", lambda index, v: seen.append((index.count(), len(index.inputFiles()))) or frequencies(index, v))
    docs = spark.createDataFrame(corpus(2, 6000), "doc_id long, text string").where("doc_id is not null").coalesce(1)
    top_k(docs, docs.where("doc_id = 3"), 5, shard_bytes=2000)
    assert seen and seen[0][0] == seen[0][1] > 1


def test_rounds_hold_each_file_once_and_grow():
    for n in (1, 2, 3, 4, 9, 10, 64, 500):
        files = [f"f{i:03}" for i in range(n)]
        turns = search.rounds(files)
        assert sorted(f for x in turns for f in x) == files
        assert all(len(x) <= 2 * sum(map(len, turns[:i])) for i, x in enumerate(turns) if i) and len(turns[0]) <= 3


def test_tasks_hand_on_few_rows_however_many_shards_there_are(spark, monkeypatch):
    r = random.Random(8)
    names = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(r.choices(names, k=40))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = docs.where("doc_id % 100 = 0")
    seen, plain = [], search.search_shards
    monkeypatch.setattr(search, "search_shards", lambda *a: seen.append(plain(*a)) or seen[-1])
    monkeypatch.setattr(search.Scratch, "close", lambda self: None)  # so that rows can be counted afterwards
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # a task for each shard
    try:
        out = top_k(docs, queries, 5, shard_bytes=4000)
        got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in out.collect())
        made = sum(x.count() for x in seen)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(brute(rows, [x for x in rows if x[0] % 100 == 0], 5), key=lambda x: x[:2])
    assert len(rows) * 40 * 5 // 4000 > 50 and made < 12 * 5 * 20


def test_terms_are_counted_once_however_many_blocks_of_queries_there_are(spark, monkeypatch):
    made, shards, plain, build = [], [], search.map_batches, search.build_index

    def spy(df, fn, schema):
        out = plain(df, fn, schema)
        if schema.startswith("term long, n"):
            made.append(out.count())
        return out

    monkeypatch.setattr(search, "map_batches", spy)
    monkeypatch.setattr(search, "build_index", lambda *a: shards.append(build(*a).count()) or build(*a))
    r = random.Random(9)
    names = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(r.choices(names, k=40))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = top_k(docs, docs.where("doc_id % 20 = 0"), 5, query_bytes=150)
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in out.collect())
    assert got == sorted(brute(rows, [x for x in rows if x[0] % 20 == 0], 5), key=lambda x: x[:2])
    # Each shard's terms at most once, not once for each block of queries.
    assert shards == [4] and 0 < sum(made) <= 4 * len(names)
