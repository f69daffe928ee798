"""Each stage of the pipeline, judged on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from linkfold.llm import language_id, mixing, ngram_join, quality_classifier
from linkfold.llm.queries import queries


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_classifier_stage(spark, sf_dir, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_classifier.score(before, quality_classifier.learn(before, labels))
    kept = {r["id"] for r in scored.collect() if r["score"] >= 0.3}
    assert rows(after) == rows(before.where(F.col("doc_id").isin(kept)))
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & kept) >= 0.98 * len(good)


def test_language_stage(stages):
    _, before, after = stages[1]
    known = {r["id"] for r in language_id.identify(before, language_id.learn(before)).collect() if r["lang_pred"] != "und" and r["score"] >= language_id.MIN_SCORE}
    assert rows(after) == rows(before.where(F.col("doc_id").isin(known)))


def test_join_stage(stages):
    _, before, after = stages[2]
    found = ngram_join.near_duplicates(before).collect()
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({r["component_id"] for r in found})
    assert after.count() < before.count()


def test_mixing_stage(stages):
    _, before, after = stages[3]
    tokens = Counter()
    for r in before.collect():
        tokens[r["source"]] += len(r["text"].encode().split())
    took = Counter()
    for r in after.collect():
        took[r["source"]] += len(r["text"].encode().split())
    longest = max(len(r["text"].encode().split()) for r in before.collect())
    for s in mixing.plan(tokens):
        assert s.budget <= took[s.source] <= s.budget + longest
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}


def test_packing_stage(stages):
    _, before, after = stages[4]
    copies = Counter(r["doc_id"] for r in before.collect())
    sizes = {r["doc_id"]: r["doc_tokens"] for r in after.collect()}
    assert sum(r["length"] for r in after.collect()) == sum(n * sizes[i] for i, n in copies.items())


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == stages[-1][2].columns
    assert whole.agg(F.sum("length")).first()[0] == stages[-1][2].agg(F.sum("length")).first()[0]


def test_all_are_registered():
    assert [int(k[2:].split("_")[0]) for k in queries()] == list(range(1, 11))
    assert set(queries()) | {"pipeline"} <= set(__spark_entry__.queries())
