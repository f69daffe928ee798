import random

import numpy as np
import pyarrow as pa
import pytest

from linkfold.llm import ngram_join
from linkfold.llm.common import Scratch
from linkfold.llm.ngram_join import components, keep_one, near_duplicates


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, any_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and 100 * both >= 80 * any_:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group}
    return sorted((rows[k][0], len(sets[k]), least[group[k]]) for k in range(len(rows)))


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 5)))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "a b c d e"), (7, "A b c d E")]
    base = [word() for _ in range(120)]
    for k in range(60):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = word()
        rows.append((10 + k, " ".join(words)))
    for k in range(40):
        words = [word() for _ in range(r.randint(3, 60))]
        rows.append((100 + 3 * k, " ".join(words)))
        rows.append((101 + 3 * k, " ".join(words[:-1] + [word()])))
        rows.append((102 + 3 * k, " ".join(words)))
    return rows


def result(spark, rows):
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return sorted((r["id"], r["n_shingles"], r["component_id"]) for r in out.collect())


def test_against_brute_force(spark):
    rows = corpus()
    assert result(spark, rows) == brute(rows)


def test_split_lists_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SEEN", 0)
    rows = corpus()
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("long_list", [1, 2, 3])
def test_every_part_of_a_split_list_stays(spark, monkeypatch, long_list):
    monkeypatch.setattr(ngram_join, "LONG_LIST", long_list)
    monkeypatch.setattr(ngram_join, "HELD", 50)
    rows = corpus()
    assert result(spark, rows) == brute(rows)


def test_classes_alone_in_their_part_stay(spark):
    blocks = [(0, [(1, 10, 5, 0, 2), (2, 10, 5, 1, 1)]), (1, [(1, 11, 5, 0, 2)])]
    packed = [(b, *(np.array(c, kind).tobytes() for c, (_, kind) in zip(zip(*rows, strict=True), ngram_join._POSTINGS, strict=True))) for b, rows in blocks]
    frame = spark.createDataFrame([(r[0], *map(bytearray, r[1:])) for r in packed], "bucket int, token binary, class binary, n binary, pos binary, parts binary")
    assert sorted((r["token"], r["class"]) for r in ngram_join.shared_postings(frame, 2).collect()) == [(1, 10), (1, 11)]


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_sets_of_members_with_repeated_and_null_ids(spark, monkeypatch, held):
    monkeypatch.setattr(ngram_join, "HELD_MEMBERS", held)
    rows = [(1, "a b c d e f"), (1, "other words"), (2, "a b c d e f"), (None, "x y"), (3, ""), (4, "not asked")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(2)
    signed = {(r["id"], r["n"]): r["class"] for r in ngram_join.signatures(docs).collect()}
    members = spark.createDataFrame([(1, signed[1, 2], 5), (ngram_join._NAMELESS, signed[None, 1], 6)], "first long, class long, cluster long")
    out = ngram_join.sets_of(members, docs)
    assert sorted((r["first"], r["class"], r["cluster"], len(r["shingles"])) for r in out.collect()) == sorted([(1, signed[1, 2], 5, 16), (ngram_join._NAMELESS, signed[None, 1], 6, 8)])
    assert ("Join" in out._jdf.queryExecution().toString()) == (held == 0)


def packed(spark, blocks):
    rows = [(b, *(bytearray(np.array(c, kind).tobytes()) for c, (_, kind) in zip(zip(*rows, strict=True), ngram_join._POSTINGS, strict=True))) for b, rows in blocks]
    return spark.createDataFrame(rows, "bucket int, token binary, class binary, n binary, pos binary, parts binary")


def test_postings_without_a_partner_end_where_their_list_is(spark):
    rows = [(7, 20, 100, 0, 1), (7, 21, 30, 0, 1), (7, 22, 31, 0, 1), (8, 20, 100, 20, 1), (8, 23, 100, 20, 1), (9, 20, 100, 11, 1), (9, 23, 100, 11, 1), (9, 20, 100, 11, 1)]
    found = ngram_join.shared_postings(packed(spark, [(0, rows)]), 1).collect()
    assert sorted((r["token"], r["class"], r["n"], r["pos"]) for r in found) == [(7, 21, 30, 0), (7, 22, 31, 0), (9, 20, 100, 11), (9, 23, 100, 11)]


@pytest.mark.parametrize("most", [3, 12, 200, 2**32 - 1])
def test_partners_are_those_of_the_size_filters(most):
    r = np.random.default_rng(most)
    for lists in (1, 5, 60):
        token, n = np.sort(r.integers(0, 2**64, lists, dtype=np.uint64)[r.integers(0, lists, 120)]), r.integers(1 + most // 2 * int(most > 12), most, 120, endpoint=True)
        pos = (r.random(120) * ngram_join.prefix_length(n)).astype(np.int64)
        order = np.lexsort((n, token))
        token, n, pos = token[order], n[order], pos[order]
        pairs = ngram_join.Candidates(n, pos, pa.array([b""] * 120, pa.binary()))
        i, j = np.divmod(np.arange(120 * 120), 120)
        want = (pairs.size_filters(i, j) & (token[i] == token[j]) & (i != j)).reshape(120, 120).any(axis=1)
        assert (ngram_join.partnered(token, n.astype(np.uint32), pos.astype(np.uint32)) == want).all()
        assert lists == 60 or 0 < want.sum()
    none = np.empty(0, np.uint32)
    assert not len(ngram_join.partnered(none.astype(np.uint64), none, none))


@pytest.mark.parametrize(("long_list", "block", "short"), [(50_000, 512, 32), (1, 7, 2), (3, 1, 1)])
def test_every_link_is_counted(spark, monkeypatch, long_list, block, short):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "LONG_LIST", long_list)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    linked = [sum(i != j and bool(a & b) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    first = [min(rows[j][0] for j, b in enumerate(sets) if j == i or (a and a == b)) for i, a in enumerate(sets)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["id"], r["class_id"], r["links"]) for r in out) == sorted((rows[i][0], first[i], linked[i]) for i in range(len(rows)))


def test_empty_table(spark):
    assert result(spark, []) == []


def test_keep_one_keeps_columns_and_clean_documents(spark):
    rows = [(1, "a b c d e f", "x", 5), (2, "A b c d e f", "y", 6), (3, "other words here", "z", 7), (4, None, "n", 8), (1, "a b c d e f", "x", 5), (None, "a b c d e f", "m", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, rows int")
    out = keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.where("doc_id is not null").collect())) == [rows[0], rows[2], rows[3]]
    assert out.where("doc_id is null").count() == 1


def test_a_common_passage_null_ids_and_a_long_text(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, f"{passage} {' '.join(word() for _ in range(r.randint(1, 12)))}") for i in range(150)]
    long = [word() for _ in range(180_000)]
    rows += [(500, " ".join(long)), (501, " ".join([*long[:-9], *("x" for _ in range(9))])), (502, "x" * 1_000_000)]
    assert result(spark, rows) == brute(rows)
    named = [(i, t, "a", "b") for i, t in [*rows[:40], (None, rows[0][1]), (None, "alone here"), (None, None)]]
    out = near_duplicates(spark.createDataFrame(named, "doc_id long, text string, class string, id string")).collect()
    assert len(out) == len(named) and {r["component_id"] for r in out if r["id"] is None} == {None, brute(rows[:40])[0][2]}


def test_chains_of_near_copies(spark):
    # Each text links with its neighbours only, so that components come from many small steps.
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 100])) for i in range(60)]
    assert result(spark, rows) == brute(rows)


def test_scratch_tables_are_removed(spark):
    import os

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    near_duplicates(spark.createDataFrame(corpus(), "doc_id long, text string")).count()
    assert [x.split("-")[1] for x in set(os.listdir(root)) - before] == ["near"]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


@pytest.mark.parametrize(("n", "m"), [(300, 290), (40, 35), (520, 500), (70, 60), (5000, 4500)])
def test_the_suffix_filter_never_rejects_a_link(n, m):
    r = np.random.default_rng(n)
    for same in (0.7, 0.85, 0.93, 0.99):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: int(m * same)], r.integers(0, 2**63, m - int(m * same), dtype=np.uint64)])
        sizes = np.array([len(a), len(b)])
        found = ngram_join.Candidates(sizes, np.zeros(2), pa.array(ngram_join.parities(np.r_[a, b], np.r_[0, np.cumsum(sizes)]), pa.binary()))
        both = len(np.intersect1d(a, b))
        ok = found.suffix_filter(np.array([0, 1]), np.array([1, 0]))
        assert ok[0] == ok[1]
        assert ok[0] or 5 * both < 4 * (len(a) + len(b) - both)
        assert not ok[0] or same > 0.7 or n > 4500


def test_unit_links_are_all_links():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[r.choice(base, 55, replace=False), r.integers(0, 2**63, r.integers(0, 9), dtype=np.uint64)]) for _ in range(40)] + [base[:1], np.unique(base[:5])]
    left, right = np.arange(0, 25), np.arange(10, 42)
    got = ngram_join.unit_links(np.array([len(s) for s in sets]), np.concatenate(sets), left, right)
    for x, i in enumerate(left):
        for y, j in enumerate(right):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert got[x, y] == (i != j and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both))
    assert 0 < got.sum() < got.size


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 10, 100])
def test_prefix_length(n):
    assert ngram_join.prefix_length(n) == n - int(np.ceil(round(0.8 * n, 9))) + 1
