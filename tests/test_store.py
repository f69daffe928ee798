import hashlib
import random

import pytest
from pyspark.sql import functions as F

from linkfold.functions import codec, kernels
from linkfold.operators import objects, store


def one_by_one(links, held, lengths, digits):
    """Allocation as one link after the other does it."""
    import hashlib

    keys, out = dict(held), {}
    for _, url in sorted(links):
        for n in lengths:
            key = hashlib.sha256(url.encode()).hexdigest()[:n] if digits is None else hashlib.sha256(url.encode()).hexdigest()[:n].translate(str.maketrans("0123456789abcdef", "aaaabbbbccccdddd"))
            if keys.get(key, url) == url:
                keys[key] = url
                out[url] = key
                break
        else:
            out[url] = "exhausted"
    return {(s, u): out[u] for s, u in links}


def narrow(url, n):
    """Keys of four digits only, so that they collide."""
    return F.translate(F.substring(F.sha2(F.encode(url, "UTF-8"), 256), 1, n), "0123456789abcdef", "aaaabbbbccccdddd")


@pytest.mark.parametrize("seed", range(4))
def test_allocation_equals_one_link_after_the_other(spark, seed):
    r = random.Random(seed)
    links = [(i, f"u{r.randrange(40)}") for i in range(60)]
    lengths = (1, 2, 3, 9)
    held = [("a", "u1"), ("bb", "other"), ("c", "u7")]
    out = store.allocate(spark.createDataFrame(links, "seq long, url string"), spark.createDataFrame(held, "key string, url string"), key=narrow, lengths=lengths)
    assert {(x["seq"], x["url"]): x["key"] for x in out.collect()} == one_by_one(links, held, lengths, 4)


def test_exhausted_keys_raise(spark):
    links = spark.createDataFrame([(i, f"u{i}") for i in range(40)], "seq long, url string")
    with pytest.raises(Exception, match="taken"):
        store.allocate(links, spark.createDataFrame([], "key string, url string"), key=narrow, lengths=(1,)).collect()


def test_links_with_short_codes_take_no_key(spark):
    links = spark.createDataFrame([(1, "u1"), (2, "u2")], "seq long, url string")
    out = store.allocate(links, spark.createDataFrame([], "key string, url string"), code_length=F.when(F.col("url") == "u1", 3).otherwise(9))
    assert [r["key"] is None for r in out.orderBy("seq").collect()] == [True, False]


def test_cache():
    cache = store.AdaptiveCache(2)
    assert [cache.access(k) for k in ("k1", "k2", "k1", "k3", "k3")] == [False, False, True, False, True]
    r = random.Random(1)
    cache = store.AdaptiveCache(20)
    hits = sum(cache.access(min(r.randrange(100), r.randrange(100))) for _ in range(5000))
    assert len(cache.recent) + len(cache.frequent) <= 20 and hits > 1000


def test_cluster(spark):
    rows = [(1, "https://g.com/a/pull/100", 0), (2, "https://g.com/a/pull/200", 0), (3, "shop!?", 0)]
    out = store.cluster(spark.createDataFrame(rows, "seq long, url string, shard int")).orderBy("seq").collect()
    assert [(r["idx"], r["new"]) for r in out] == [(0, True), (0, False), (1, True)]


def test_container():
    data = objects.container(bytes(32), [b"a", b"b", b"a"])
    assert [d for _, d in objects.open_container(data)[2]] == [b for _, b in sorted((kernels.blake3([x])[0], x) for x in (b"a", b"b"))]
    for i in range(len(data)):
        assert not objects.verify(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
    assert not objects.verify(data[:80])


def test_damaged_container_gives_an_error_row(spark):
    good = objects.container(bytes(32), [b"a"])
    rows = objects.unpack(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:-1]))], "g int, container binary")).orderBy("g").collect()
    assert [(r["g"], r["error"] is None) for r in rows] == [(1, True), (2, False)]


def test_delta_micro_golden(spark):
    row = spark.range(1).select(codec.delta_mask(F.lit("amora"), F.lit("omera"), 0).alias("m"), codec.delta_diffs(F.lit("amora"), F.lit("omera")).alias("d")).first()
    assert (row["m"], row["d"]) == (26, "oe")


def test_native_codecs_agree_with_the_kernels(spark):
    urls = ["https://shop.x.com/12345678?session_id=deadbeef0123", "~~ff", "a" * 300, "", "https://github.com/a/b/pull/1", "18446744073709551615", "18446744073709551616", "x{1}y"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    out = df.select("u", codec.trans_pack_hex(codec.tokenize(F.col("u"))).alias("t"), codec.template_match(F.col("u")).alias("m"), codec.rle_restore(codec.rle_hex(F.col("u"))).alias("r"), codec.ascii_link(F.concat("u", F.lit("é"))).alias("a")).collect()
    for r in out:
        assert bytes.fromhex(r["t"]) == kernels.trans_pack(kernels.tokenize(r["u"].encode()))
        assert (None if r["m"] is None else (r["m"]["id"], list(r["m"]["slots"]))) == kernels.template_match(r["u"])
        assert r["r"] == r["u"]
        assert r["a"] == kernels.ascii_link(r["u"] + "é")


def test_elias_fano_of_every_shard(spark, sf_dir):
    from linkfold.plans import storing

    offsets = {}
    for r in storing.log_offsets(spark, sf_dir).orderBy("shard", "seq").collect():
        offsets.setdefault(r["shard"], []).append(r["offset"])
    expected = []
    for shard, values in offsets.items():
        w = (max(values) // len(values)).bit_length() - 1 if max(values) > len(values) else 0
        expected += [(shard, i, v, v & ((1 << w) - 1), i + (v >> w)) for i, v in enumerate(values)]
    assert len(offsets) == 4
    assert sorted(map(tuple, storing.elias_shards(spark, sf_dir).collect())) == sorted(expected)


def test_dangling_pages_that_share_a_url(spark, tmp_path):
    from linkfold.plans import storing

    urls = {10: "https://a/", 11: "https://a/", 20: None, 23: None, 30: "https://b/", 40: "https://c/", 50: "https://c/"}
    spark.createDataFrame(list(urls.items()), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    sha = {u: hashlib.sha256(u.encode()).hexdigest() for u in urls.values() if u}
    got = storing.dangling(spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["hash"]) for r in got if r["hash"]) == [(0, sha["https://c/"]), (2, sha["https://a/"]), (2, sha["https://c/"])]
    assert [r["id"] for r in got if r["hash"] is None] == [4]


def test_sizes_round_as_their_exact_value(spark):
    """Against printf of the same double: values whose shortest decimal form is a tie, ties, carries and units' bounds."""
    r = random.Random(7)
    values = [46467003522241000, 0, 1023, 1024, 1029, 1152, 1048575, 1048576, (1 << 30) - 1, 1 << 30, 9223372036854775000, (1 << 63) - 1]
    values += [1024 * k + 128 * j for k in (1, 2, 7) for j in range(8)] + [r.randrange(1 << r.randint(11, 62)) for _ in range(3000)]
    units = [(1024, "KB"), (1 << 20, "MB"), (1 << 30, "GB")]
    want = [f"{n} B" if n < 1024 else next(f"{float(n) / u:.2f} {s}" for u, s in units if n < u * 1024 or s == "GB") for n in values]
    got = spark.createDataFrame(list(enumerate(values)), "i int, n long").select("i", codec.format_bytes(F.col("n")).alias("s")).collect()
    assert [s for _, s in sorted(map(tuple, got))] == want


def test_links_that_find_all_keys_taken_are_left_out_without_strict(spark):
    links = [(i, f"u{i}") for i in range(40)]
    out = store.allocate(spark.createDataFrame(links, "seq long, url string"), spark.createDataFrame([], "key string, url string"), key=narrow, lengths=(1, 2), strict=False).collect()
    want = one_by_one(links, [], (1, 2), 4)
    assert "exhausted" in want.values()
    assert {(r["seq"], r["url"]): r["key"] for r in out} == {k: v for k, v in want.items() if v != "exhausted"}


def test_shorten_alloc_of_links_that_lose_every_short_key(spark, tmp_path, monkeypatch):
    from linkfold.plans import storing

    monkeypatch.setattr(storing, "SHORT", (1,))
    rows = [(i, i) for i in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = storing.shorten_alloc(spark, str(tmp_path)).collect()
    assert 0 < len(got) == len({r["key"] for r in got}) <= 16


def test_expand_of_links_whose_keys_collide(spark, tmp_path, monkeypatch):
    from linkfold.plans import storing
    from linkfold.sources.links import order_links

    sha_key = store.sha_key
    monkeypatch.setattr(store, "sha_key", lambda url, n: sha_key(url, 1 if n == 10 else n))
    monkeypatch.setattr(store.allocate, "__defaults__", (store.sha_key, *store.allocate.__defaults__[1:]))
    spark.createDataFrame([(i, i) for i in range(80)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    links = {r["seq"]: r["url"] for r in order_links(spark, str(tmp_path)).collect()}
    got = storing.expand(spark, str(tmp_path)).where(F.col("seq") % 2 == 0).collect()
    assert {r["seq"]: (r["url"], r["error"]) for r in got} == {s: (u, None) for s, u in links.items() if s % 2 == 0}


def test_deltas_of_long_and_odd_texts(spark):
    r = random.Random(3)
    rows = [("", ""), ("", "ab"), ("ab", ""), (None, "a"), ("a", None), ("é😀x", "é😀yz"), ("a" * 300, "a" * 300)]
    rows += [("".join(r.choices("abc", k=r.randint(0, 400))), "".join(r.choices("abc", k=r.randint(0, 400)))) for _ in range(40)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, u string")
    out = df.select("i", *[codec.delta_mask(F.col("a"), F.col("u"), w).alias(f"m{w}") for w in range(4)], codec.delta_diffs(F.col("a"), F.col("u")).alias("d"))
    for got in out.collect():
        a, u = rows[got["i"]]
        if a is None or u is None:
            continue
        same = [i < min(256, len(a)) and a[i] == c for i, c in enumerate(u)]
        assert sum((got[f"m{w}"] % (1 << 64)) << (64 * w) for w in range(4)) == sum(1 << i for i, s in enumerate(same) if s)
        assert got["d"] == "".join(c for s, c in zip(same, u, strict=True) if not s)
    # Texts are taken apart once a row, not again for each character.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for part in plan.split("lambdafunction(")[1:]:
        depth, end = 1, 0
        while depth and end < len(part):
            depth += {"(": 1, ")": -1}.get(part[end], 0)
            end += 1
        assert "split(" not in part[:end] and "regexp_extract_all(" not in part[:end]
