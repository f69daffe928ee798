from pyspark.sql import functions as F

from linkfold import __main__ as cli
from linkfold import api
from linkfold.functions import kernels
from tests.test_kernels import GOLDEN


def links(spark):
    return spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(GOLDEN)], "seq long, url string")


def test_known_codes_and_keys(spark):
    assert [r["code"] for r in api.encode(links(spark)).orderBy("seq").collect()] == [c for _, c, _ in GOLDEN]
    short = api.shorten(links(spark)).orderBy("seq").collect()
    assert [r["key"] for r in short] == [k for _, _, k in GOLDEN]
    held = api.shorten(links(spark)).select("key", "url")
    again = api.expand(held.select("key"), held)
    assert sorted(r["url"] for r in again.collect()) == sorted(u for u, _, _ in GOLDEN)
    plain = api.expand(spark.createDataFrame([(c,) for _, c, _ in GOLDEN], "key string"), held.limit(0))
    assert sorted(r["url"] for r in plain.collect()) == sorted(u for u, _, _ in GOLDEN)


def test_profiles(spark, tmp_path):
    profile = api.train(links(spark))
    assert sum(profile.freqs) == 4096
    path = str(tmp_path / "profiles")
    api.save(spark, profile, path)
    assert api.load(spark, path, profile.id) == profile
    coded = api.encode(links(spark), profile).drop("url")
    assert [r["url"] for r in api.resolve(coded, profile).orderBy("seq").collect()] == [kernels.normalize(u) for u, _, _ in GOLDEN]
    assert api.merge([]) == api.generic() == api.train(links(spark).limit(0)) and api.merge([profile]) is profile
    assert sum(api.merge([profile, api.generic()]).freqs) == 4096


def test_containers_and_sql(spark):
    coded = api.encode(links(spark)).withColumn("g", F.lit(1))
    packed = api.export(coded)
    assert api.verify(packed).first()["ok"]
    assert sorted(r["url"] for r in api.open_container(packed).collect()) == sorted(u for u, _, _ in GOLDEN)
    api.register(spark)
    row = spark.sql("SELECT link_encode('https://crates.io/crates/clap') AS c, link_resolve('0zGTjPDu~').url AS u, hex(base66_decode(base66_encode(unhex('00FF')))) AS b").first()
    assert (row["c"], row["u"], row["b"]) == ("0zGTjPDu~", "https://crates.io/crates/clap", "00FF")


def test_command_line(capsys, tmp_path):
    assert cli.main(["encode", "https://crates.io/crates/clap"]) == 0
    assert cli.main(["decode", "0zGTjPDu~"]) == 0
    assert cli.main(["decode", "$"]) == 1
    assert cli.main(["check", "mailto:a@b.c"]) == 0
    (tmp_path / "x").write_bytes(b"no")
    assert cli.main(["verify", str(tmp_path / "x")]) == 1
    assert capsys.readouterr().out.split() == ["0zGTjPDu~", "https://crates.io/crates/clap", "Alive", "invalid"]
