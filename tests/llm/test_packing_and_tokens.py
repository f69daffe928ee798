import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkfold.llm import packing, token_orc
from linkfold.llm.common import scratch_path


def ids_of(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("size", "windows"), [(8, 1), (64, 3), (2048, 16)])
def test_each_id_lies_in_one_piece(size, windows):
    r = random.Random(size)
    docs = [(i, np.arange(r.choice([1, 3, size // 2, size, size + 1, 5 * size]), dtype="<u4").tobytes()) for i in range(200)]
    sequences = list(packing.pack_stream(docs, size, windows))
    for s in sequences:
        total = sum(p[2] for p in s)
        assert total == size or (total & (total - 1) == 0 and total < size)
        assert all(len(p[4]) == 4 * p[2] for p in s)
    assert sum(sum(p[2] for p in s) < size for s in sequences) <= size.bit_length()
    for i, ids in docs:
        own = sorted((p[1], p[4]) for s in sequences for p in s if p[0] == i)
        assert b"".join(x for _, x in own) == ids
        assert [a for a, _ in own] == list(np.cumsum([0] + [len(x) // 4 for _, x in own])[:-1])


def test_best_fit_and_fullest():
    p = packing.Packer(10, 2)
    piece = lambda n: bytes(4 * n)
    assert not list(p.add(0, piece(7))) and not list(p.add(1, piece(4)))
    done = list(p.add(2, piece(3)))
    assert [[x[:3] for x in s] for s in done] == [[(0, 0, 7), (2, 0, 3)]]
    assert not list(p.add(3, piece(9)))
    done = list(p.add(4, piece(8)))
    assert [[x[:3] for x in s] for s in done] == [[(3, 0, 9), (4, 0, 1)]]
    assert p.open[0][0] == 4 and len(p.open) == 2


ROWS = [(5, "Hello world,  it's\n\nme", "a"), (1, None, "b"), (2, "", "c"), (9, "x " * 3000, "d"), (None, "no id", "e"), (5, "Hello world,  it's\n\nme", "f"), (7, "é中\t\x00", None)]


def test_pack_query(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, length string").repartition(2)
    out = packing.pack_digest(packing.pack(docs)).collect()
    for i, text, _ in ROWS:
        ids = ids_of("byte_bpe_50k.json", text)
        own = [r for r in out if r["doc_id"] == i]
        copies = sum(1 for j, _, _ in ROWS if j == i)
        assert sum(r["length"] for r in own) == copies * len(ids)
        for r in own:
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1])
    assert packing.pack(docs.limit(0)).count() == 0


def test_orc_round_trip(spark):
    docs = spark.createDataFrame(ROWS + [(100 + i, f"text number {i} " * (i % 7), "z") for i in range(200)], "doc_id long, text string, start string").repartition(3)
    path = scratch_path(spark, "orc")
    token_orc.write_tokens(docs, path, parts=3)
    rows = token_orc.ids_digest(token_orc.read_tokens(spark, path)).orderBy("start").collect()
    assert len(rows) == 207
    names = [r["id"] if r["id"] is not None else -1 for r in rows]
    assert names == sorted(names)
    at = 0
    texts = {i: t for i, t, _ in ROWS} | {100 + i: f"text number {i} " * (i % 7) for i in range(200)}
    for r in rows:
        ids = ids_of("word_bpe_49k.json", texts[r["id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    found = token_orc.lookup(spark, path, [5, 150])
    assert sorted(r["id"] for r in found.collect()) == [5, 5, 150]
    assert "In(id" in found._jdf.queryExecution().toString() or "PushedFilters: [In" in found._jdf.queryExecution().toString()


def test_empty_orc(spark):
    path = scratch_path(spark, "orc")
    token_orc.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, parts=2)
    assert token_orc.ids_digest(token_orc.read_tokens(spark, path)).count() == 0
