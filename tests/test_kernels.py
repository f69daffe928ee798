import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkfold.functions import kernels as k

#: Known links, codes and five-digit keys, from the table in FIXTURES.md.
GOLDEN = [
    (m[1], m[2], m[3])
    for line in (Path(__file__).parent.parent / "FIXTURES.md").read_text().splitlines()
    if (m := re.match(r"\| \d+ \| [^|]+ \| `([^`]+)` \| \d+ \| `([^`]+)` \| \d+ \| `([^`]+)` \|", line))
]


def test_known_codes():
    assert len(GOLDEN) == 18
    for link, code, key in GOLDEN:
        assert k.encode(link) == code
        assert k.resolve(code) == link
        assert k.shortcut(k.blake3([link.encode()])[0], 5) == key


def test_blake3_of_known_inputs():
    """Published test vectors: bytes 0, 1, ... 250 repeating."""
    known = {0: "af1349b9f5f9a1a6a0404dea36dcc949", 1: "2d3adedff11b61f14c886e35afa03673", 1024: "42214739f095a406f3fc83deb889744a", 1025: "d00278ae47eb27b34faecf67b4fe263f", 2048: "e776b6028c7cd22a4d0ba182a8bf6220", 3072: "b98cb0ff3623be03326b373de6b90952"}
    data = [bytes(i % 251 for i in range(n)) for n in known]
    assert [d.hex()[:32] for d in k.blake3(data)] == list(known.values())


URLS = st.one_of(
    st.text(st.characters(min_codepoint=33, max_codepoint=126), max_size=60),
    st.builds("https://www.{}.com/{}?utm_source={}".format, st.text("abc0", max_size=8), st.integers(0, 2**70), st.text("0123456789abcdef", max_size=30)),
    st.builds("https://github.com/{}/{}/pull/{}".format, st.text("a{}1", max_size=5), st.text("b~", max_size=5), st.integers(0, 10**9)),
)


@settings(max_examples=300, deadline=None)
@given(URLS)
def test_round_trip(url):
    code = k.encode(url)
    assert set(code) <= set(k.ALPHABET)
    assert k.resolve(code) == k.normalize(url)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_byte_codecs(data):
    assert k.base66_decode(k.base66_encode(data)) == data
    assert k.move_to_front_inverse(k.move_to_front(data)) == data
    assert k.rans_decode(k.rans_encode(data, k.generic_frequencies()), len(data), k.generic_frequencies()) == data
    symbols, rules = k.repair(data)
    assert k.repair_expand(symbols, rules) == data
    assert k.grammar_unpack(k.grammar_pack(symbols, rules)) == (symbols, rules)
    assert k.trans_unpack(k.trans_pack(data)) == data


@pytest.mark.parametrize("code", ["$some", "0", "0invalid!char", "3", "3A", "~x", "0é"])
def test_what_is_no_code(code):
    assert k.try_resolve(code)[0] is None and k.try_resolve(code)[1]


def test_numbers_at_the_edges():
    for x in ["1234567", "00000000", "18446744073709551615", "18446744073709551616", "1" * 21, "deadbee", "deadbeef", "a" * 512, "~~"]:
        assert k.trans_unpack(k.trans_pack(x.encode())) == x.encode()
    assert k.trans_pack(b"12345678")[:3] == b"\x7e\x01\x08"


def test_scaled_frequencies():
    assert sum(k.generic_frequencies()) == k.SCALE and k.frequencies([0] * 256) == [16] * 256


def test_non_ascii_links_are_percent_encoded():
    assert k.resolve(k.encode("https://x.com/é")) == "https://x.com/%C3%A9"


def smallest_of_all(url, freqs):
    """The code by trying each form, without bounds."""
    link = k.ascii_link(k.normalize(url))
    plain = k.trans_pack(k.tokenize(link.encode()))
    packed = k.grammar_pack(*k.repair(plain))
    grammar = packed if len(packed) < len(plain) + 1 else b"\x00" + plain
    forms = [b"\x02" + plain, b"\x00" + grammar, b"\x01" + len(grammar).to_bytes(2, "little") + k.rans_encode(grammar, freqs)]
    code = "0" + k.base66_encode(min(forms, key=len))
    found = k.template_match(link)
    other = found and "3" + k.base66_encode(k.trans_pack(k.template_pack(*found)))
    return other if other and len(other) < len(code) else code


SKEWED = tuple(k.frequencies([1000 if chr(i) in "abc/" else 1 for i in range(256)]))


@settings(max_examples=400, deadline=None)
@given(st.one_of(URLS, st.text("ab/", min_size=1, max_size=120), st.builds(lambda a, n: (a * n)[:200], st.text("xyz01/", min_size=1, max_size=9), st.integers(1, 60))), st.sampled_from([None, SKEWED]))
def test_bounds_skip_no_shorter_form(url, freqs):
    if url.strip():
        assert k.encode(url, freqs) == smallest_of_all(url, freqs or k.generic_frequencies())


def test_base66_codes_of_whole_links(spark, sf_dir):
    from linkfold.functions.fixed import ALPHABET
    from linkfold.plans import codecs
    from linkfold.sources.links import order_links

    def plain(text):
        value, digits = int("01" + text.encode().hex(), 16), ""
        while value > 0:
            digits = ALPHABET[(value - 1) % 66] + digits
            value = (value - 1) // 66
        return digits

    urls = {r["seq"]: r["url"] for r in order_links(spark, sf_dir).collect()}
    codes = codecs.base66(spark, sf_dir).collect()
    assert len(codes) == len(urls) and all(r["code"] == plain(urls[r["seq"]].strip()) for r in codes)


@pytest.mark.parametrize("url", ["mailto:a@b.c?subject=", "mailto:?subject=x?subject=y", "https://github.com/a/b/pull/7", "https://github.com/a/b/blob/m/x/y", "https://x.com/a/status/1/", "https://www.reddit.com/r/a/comments/b/c/d", "https://www.reddit.com/r/a/comments/b/c/", "https://www.youtube.com/watch?v=", "nothing", ""])
def test_templates_by_plain_cutting(spark, url):
    import re

    from pyspark.sql import functions as F

    from linkfold.functions import codec
    from linkfold.functions.fixed import TEMPLATES

    want = None
    for number, pattern in TEMPLATES.items():
        first, *parts = re.split(r"\{\d+\}", pattern)
        rest, slots = url[len(first) :] if url.startswith(first) else None, []
        for p in parts:
            if rest is not None:
                at = len(rest) if p == "" else rest.find(p)
                slots.append(rest[:at])
                rest = None if at < 0 else rest[at + len(p) :]
        if rest == "":
            want = (number, slots)
            break
    got = spark.createDataFrame([(url,)], "u string").select(codec.template_match(F.col("u")).alias("m")).first()["m"]
    assert (got and (got["id"], got["slots"])) == want
