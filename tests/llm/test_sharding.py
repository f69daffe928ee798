import pytest

from linkfold.llm.common import scratch_path
from linkfold.llm.sharding import CommitConflict, Shard, ShardStore, VersionGone, shard_documents


def rows(df):
    return sorted(map(str, df.drop("file").collect()))


def test_append_merge_and_read_back(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 40, "x") for i in range(3000)] + [(7, None, None), (None, "n", "n")], "doc_id long, text string, shard string")
    store = shard_documents(docs, scratch_path(spark, "store"), base_bytes=1000, target_bytes=40_000)
    assert rows(store.read()) == rows(docs)
    sizes = [store.tier(s.size) for s in store.shards()]
    assert all(sizes.count(t) < 4 for t in sizes)
    assert not store.due(store.shards())
    assert sorted(n for s in store.shards() for n in range(s.first, s.last + 1)) == list(range(16))
    assert store.version() > 16
    store.append(docs.limit(10), 2, "doc_id")
    assert store.read().count() == docs.count() + 10


def test_a_version_is_committed_once(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    store = shard_documents(docs, scratch_path(spark, "store"), arrivals=2)
    at = store.version()
    store.commit(at, store.shards())
    with pytest.raises(CommitConflict):
        store.commit(at, [Shard("other", [], 0, 0, 0)])
    assert rows(store.read()) == rows(docs)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shard_documents(docs, scratch_path(spark, "store")).read().count() == 0


def test_names_that_clash_and_long_texts(spark):
    docs = spark.createDataFrame([(1, 99, "n", "f", "x" * 2_000_000), (2, 98, None, "g", "")], "doc_id long, arrival int, name string, file string, text string")
    store = shard_documents(docs, scratch_path(spark, "store"), arrivals=3)
    out = store.read()
    assert out.columns == [*docs.columns, "file_"]
    assert sorted(map(tuple, out.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    files = {f for s in store.shards() for f in s.files}
    assert {r["file_"] for r in out.collect()} == files


def test_rows_lie_in_the_files_named(spark):
    docs = spark.createDataFrame([(i, f"t {i}") for i in range(500)], "doc_id long, text string")
    store = shard_documents(docs, scratch_path(spark, "store"), base_bytes=500, target_bytes=3000)
    for name in {r["file"] for r in store.read().collect()}:
        there = sorted(map(tuple, spark.read.parquet(f"{store.root}/{name}").collect()))
        assert there == sorted((r["doc_id"], r["text"]) for r in store.read().collect() if r["file"] == name)


def test_two_writers_and_a_crash_between_write_and_commit(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a") for i in range(20)], "doc_id long, text string")
    store = shard_documents(docs, scratch_path(spark, "store"), arrivals=1)
    other = ShardStore(spark, store.root, docs.schema)
    commit, lost = ShardStore.commit, []

    def beaten(self, version, shards):
        if self is store and not lost:
            lost.append(version)
            commit(other, version, [*other.shards(version), Shard("theirs", [], 0, 50, 50)])
        return commit(self, version, shards)

    monkeypatch.setattr(ShardStore, "commit", beaten)
    store.append(docs, 1, "doc_id")
    assert lost and rows(store.read()) == sorted(2 * rows(docs))
    assert "theirs" in {s.name for s in store.shards()}

    def crash(self, version, shards):
        raise RuntimeError("gone")

    monkeypatch.setattr(ShardStore, "commit", crash)
    with pytest.raises(RuntimeError, match="gone"):
        store.append(docs, 1, "doc_id")
    monkeypatch.setattr(ShardStore, "commit", commit)
    assert rows(store.read()) == sorted(2 * rows(docs))
    store.append(docs, 1, "doc_id")
    assert rows(store.read()) == sorted(3 * rows(docs))


def test_readers_of_the_former_version_go_on(spark):
    docs = spark.createDataFrame([(i, "b" * 50) for i in range(40)], "doc_id long, text string")
    store = shard_documents(docs, scratch_path(spark, "store"), arrivals=1)
    for _ in range(2):
        store.append(docs, 1, "doc_id")
    before, version = store.read(), store.version()
    store.append(docs, 1, "doc_id")  # the fourth: merged, and cleaned
    assert store.version() == version + 2
    assert store.read(version + 1).count() == store.read().count() == 160
    assert before.count() == 120
    with pytest.raises(VersionGone):
        store.read(1)
