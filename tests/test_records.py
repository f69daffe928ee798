import json

from hypothesis import given, settings
from hypothesis import strategies as st

from linkfold import server
from linkfold.operators import records as r


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.builds(lambda b, n: b * n, st.binary(min_size=1, max_size=2), st.integers(1, 600))))
def test_payload_codecs(data):
    assert r.rle_unpack(r.rle_pack(data)) == data
    assert r.symbol_unpack(r.symbol_pack(data)) == data


def test_records_are_read_without_the_writer(spark):
    urls = [f"https://g.com/a/pull/{i}" for i in range(300)] + ["é://x", "mailto:a@b.c", "", "https://é.com/", "x" * 70_000, "y" * 70_001]
    urls += [f"{chr(65 + i % 26)}{i * 7919}-{'zq'[i % 2] * (i % 40)}" for i in range(400)]
    links = spark.createDataFrame([(i, i % 2, u) for i, u in enumerate(urls)], "seq long, shard int, url string")
    out = r.read_records(r.records(links)).collect()
    assert {x["seq"]: x["url"] for x in out} == dict(enumerate(urls)) and all(x["error"] is None for x in out)


def test_missing_anchor_is_an_error(spark):
    links = spark.createDataFrame([(1, 0, "https://g.com/a/pull/100"), (2, 0, "https://g.com/a/pull/200")], "seq long, shard int, url string")
    stored = r.records(links)
    assert [x["error"] is None for x in r.read_records(stored.where("seq = 2")).collect()] == [False]


def test_index_never_finds_absent_keys():
    import hashlib

    keys = {hashlib.sha256(str(i).encode()).digest(): 42 * i for i in range(3000)}
    index = r.build_index(keys)
    assert all(r.find(index, d) == o for d, o in keys.items())
    assert all(r.find(index, hashlib.sha256(f"no{i}".encode()).digest()) is None for i in range(3000))


def test_http_answers():
    code = json.loads(server.answer("POST", "/encode", '{"url": "https://crates.io/crates/clap"}')[2])["code"]
    assert code == "0zGTjPDu~"
    assert server.answer("GET", "/" + code)[:2] == (302, {"Location": "https://crates.io/crates/clap"})
    assert json.loads(server.answer("POST", "/decode", json.dumps({"code": code}))[2])["url"].endswith("clap")
    assert [server.answer(*x)[0] for x in (("GET", "/health"), ("GET", "/"), ("OPTIONS", "/x"), ("GET", "/check?target=urn:a"), ("GET", "/check"), ("GET", "/$"), ("POST", "/encode", "no"), ("POST", "/x"))] == [200, 200, 204, 200, 400, 404, 400, 404]
