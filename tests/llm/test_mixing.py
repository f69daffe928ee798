import math

import pytest
from pyspark.sql import functions as F

from linkfold.llm import mixing
from linkfold.llm.mixing import BLOCKS, block_of, entropy, mix, plan, turn, weights


def test_exponent_reaches_the_entropy_or_stops_at_the_repeats():
    tokens = {"a": 3600, **{f"s{i}": 337 - i for i in range(19)}}
    shares = plan(tokens, 0.9, 10)
    assert entropy({s.source: s.weight for s in shares}) == pytest.approx(0.9 * math.log(20), abs=1e-6)
    limited = plan(tokens, 0.99, 1.2)
    assert max(s.budget / s.tokens for s in limited) == pytest.approx(1.2, abs=0.01)
    assert min(s.budget / s.tokens for s in limited) == pytest.approx(1.0, abs=0.01)
    assert plan({"a": 5}) and plan({"a": 5})[0].budget == 5
    assert plan({}) == [] and plan({"a": 0}) == []
    assert sum(weights(tokens, 0.0).values()) == pytest.approx(1)


def rows(out):
    return [(r["doc_id"], r["source"], r["mixed"]["epoch"]) for r in out.collect()]


@pytest.mark.parametrize(("entropy_goal", "most", "budget"), [(0.9, 1.5, None), (0.99, 3.0, None), (0.9, 2.0, 1500), (0.5, 2.0, 300)])
def test_budgets_are_met_and_epochs_are_whole(spark, entropy_goal, most, budget):
    docs = [(i, f"src{i % 10 if i % 3 else 0}", " ".join(["w"] * (1 + i % 13))) for i in range(400)]
    out = rows(mix(spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3), target_entropy=entropy_goal, max_repeats=most, budget=budget))
    size = {i: len(t.split()) for i, _, t in docs}
    tokens: dict = {}
    for i, s, _ in docs:
        tokens[s] = tokens.get(s, 0) + size[i]
    for share in plan(tokens, entropy_goal, most, budget):
        took = sum(size[i] for i, s, _ in out if s == share.source)
        assert share.budget <= took <= share.budget + 13
        copies = [sum(1 for j, _, _ in out if j == i) for i, s, _ in docs if s == share.source]
        assert max(copies) - min(copies) <= 1
    assert len(set(out)) == len(out)


def test_odd_rows(spark):
    docs = [(1, None, "a b"), (2, "x", None), (3, "x", ""), (None, "y", "c"), (4, "y", "c d"), (4, "y", "c d")]
    out = mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), target_entropy=0.0)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "3", "4", "4", "None"]
    assert mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    assert BLOCKS == 1024


@pytest.mark.parametrize(("budget", "broadcast"), [(None, 100_000), (900, 0)])
def test_rows_and_order_against_brute_force(spark, monkeypatch, budget, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    docs = [(i, f"s{i % 7 if i % 3 else 0}", " ".join(["w"] * (1 + i % 11)), i, i) for i in range(300)] + [(900, "s1", "long " * 100_000, 0, 0)] * (budget is None)
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, own long, mixed long")
    named = frame.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("place")).withColumn("block", block_of(F.col("place"), BLOCKS))
    named = named.select("*", F.array(*[turn(F.col("source"), F.col("block"), F.lit(e).cast("long"), BLOCKS) for e in range(6)]).alias("turns")).collect()
    tokens: dict = {}
    for r in named:
        tokens[r["source"]] = tokens.get(r["source"], 0) + len(r["text"].split())
    want = []
    for share in plan(tokens, 0.99, 3.0, budget):
        own = [r for r in named if r["source"] == share.source]
        full, rest = divmod(share.budget, share.tokens)
        want += [(r["doc_id"], e, r["turns"][e], r["place"]) for r in own for e in range(full)]
        for r in sorted(own, key=lambda r: (r["turns"][full], r["place"])):
            if rest <= 0:
                break
            want.append((r["doc_id"], full, r["turns"][full], r["place"]))
            rest -= len(r["text"].split())
    out = mix(frame, target_entropy=0.99, max_repeats=3.0, budget=budget)
    assert out.columns == [*frame.columns, "mixed_"]
    got = out.collect()
    assert sorted((r["doc_id"], *r["mixed_"]) for r in got) == sorted(want)
    assert all(r["own"] == r["mixed"] == r["doc_id"] for r in got if r["doc_id"] < 900)
