import pytest
from pyspark.sql import functions as F

from linkfold.sources import links
from linkfold.streaming import events


@pytest.mark.parametrize(
    ("name", "text", "expected"),
    [
        ("a.csv", 'id,domain,url\n1,x.com,"https://x.com/a,b"\n2,y.com,y.com/c\n\n3,short\n', ["https://x.com/a,b", "https://y.com/c"]),
        ("a.tsv", "id\tdomain\tlink\n1\tx.com\tipfs://abc\n", ["ipfs://abc"]),
        ("a.txt", "x.com/a\n\n  \"y.com\"  \n", ["x.com/a", "y.com"]),
        ("a.dat", "1,x.com\n2,mailto:a@b.c\n", ["https://x.com", "mailto:a@b.c"]),
        ("b.csv", "rank,host\n1,x.com\n", ["https://x.com"]),
    ],
)
def test_files(spark, tmp_path, name, text, expected):
    (tmp_path / name).write_text(text)
    got = [r["url"] for r in links.read_links(spark, str(tmp_path / name)).orderBy("seq").collect()]
    assert got == expected
    assert links.read_links(spark, str(tmp_path / name), limit=1).count() == 1


def test_a_folder_of_files_with_headers(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_text(f"id,url\n{k},https://x.com/{k}\n")
    assert sorted(r["url"] for r in links.read_links(spark, str(tmp_path)).collect()) == [f"https://x.com/{k}" for k in range(3)]


def test_header_rules():
    assert links.link_column(["id", "Domain", " URL "]) == (2, True)
    assert links.link_column(["id", "url", "x"], given=2) == (1, True)
    assert links.link_column(["host", "x"]) == (0, True)
    assert links.link_column(["1", "2"]) == (1, False)
    assert links.split_row('a,"b,c",d', ",") == ["a", "b,c", "d"]
    assert [links.file_format(x) for x in ("a.CSV", "b.urls", "c.list", "d")] == ["csv", "txt", "txt", "auto"]


def sample(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").limit(400)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("query", [events.tumbling, events.sessions, events.sliding])
def test_streams_give_the_tables_rows(spark, sf_dir, tmp_path, query):
    table = sample(spark, sf_dir)
    table.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    last = table.agg(F.max("ts")).first()[0]
    # A far later event closes all windows before it.
    table.limit(1).withColumn("ts", F.lit(last) + F.expr("INTERVAL 3 DAYS")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = query(events.read_stream(spark, str(tmp_path / "in"), table))
    events.collect_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(stream.columns).collect()}
    assert got <= {tuple(r) for r in query(table).select(stream.columns).collect()} and len(got) >= 0.9 * query(table).count() - 2


def test_ingest_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"https://x.com/{i % 30}") for i in range(60)], "seq long, url string")
    for part in range(2):
        rows.where(F.col("seq") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = events.read_stream(spark, str(tmp_path / "in"), rows)
    events.ingest(source, str(tmp_path / "table"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "table"))
    assert out.count() == 60
    assert out.groupBy("url").agg(F.countDistinct("key").alias("n")).where("n > 1").count() == 0
    assert out.groupBy("key").agg(F.countDistinct("url").alias("n")).where("n > 1").count() == 0
