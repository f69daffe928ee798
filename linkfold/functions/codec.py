"""Codecs as Spark column functions, built from Catalyst expressions.

Byte strings are written as text with one character (0-255) for each byte, so that regular expressions can work on
them; `to_binary` gives the bytes, `hex_bytes` their hexadecimal digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkfold.functions.fixed import ATLAS, SYMBOLS, TEMPLATES, TRANSCODER

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U64_MAX = "18446744073709551615"


def literal_map(pairs: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def quote(token: str) -> str:
    """A token as a pattern that Java's and RE2's syntax read alike."""
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", token)


def alternation(tokens: Iterable[str], rest: str, by_length: bool) -> str:
    """A pattern that cuts a text into tokens and `rest`. Tokens are grouped by first character, so a position tries
    only those that can begin there; the order within a group is kept, or longest first."""
    groups: dict[str, list[str]] = {}
    for t in sorted(tokens, key=len, reverse=True) if by_length else tokens:
        groups.setdefault(t[0], []).append(t)
    parts = [f"{quote(c)}(?:{'|'.join(quote(t[1:]) for t in ts)})" for c, ts in groups.items()]
    return f"({'|'.join(parts)}|{rest})"


def to_binary(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def hex_bytes(text: Column) -> Column:
    return F.hex(to_binary(text))


def byte_text(binary: Column) -> Column:
    return F.decode(binary, "ISO-8859-1")


def pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def joined(parts: Column, each) -> Column:
    return F.array_join(F.transform(parts, each), "")


# Normalised links and dictionary tokens ---------------------------------------------------------------------------


def normalize(url: Column) -> Column:
    """Outer white space goes, the scheme (all before `://`) is lower-cased; nothing else changes."""
    trimmed = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    at = F.instr(trimmed, "://")
    scheme = F.substring(trimmed, F.lit(1), at - 1)
    return F.when(at > 0, F.concat(F.translate(scheme, _UPPER, _LOWER), F.substring(trimmed, at, F.length(trimmed)))).otherwise(trimmed)


def ascii_link(url: Column) -> Column:
    """Characters beyond ASCII percent-encoded, as bytes from 0x80 stand for tokens in a code."""
    return joined(pieces(url, r"((?s:.))"), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")))


TOKENS = alternation(ATLAS, "(?s:.)", by_length=True)
_TOKEN_BYTE = {t: chr(0x80 | i) for i, t in enumerate(ATLAS)}


def tokenize(url: Column) -> Column:
    """Dictionary tokens, the longest at each place, become one byte from 0x80; other characters stay. ASCII only."""
    table = literal_map(_TOKEN_BYTE)
    return joined(pieces(url, TOKENS), lambda x: F.when(F.length(x) > 1, table[x]).otherwise(x))


def detokenize(text: Column) -> Column:
    """The inverse of tokenize on byte text; bytes without a token stay."""
    table = literal_map({b: t for t, b in _TOKEN_BYTE.items()})
    return joined(pieces(text, "((?s:.))"), lambda x: F.when(F.ascii(x) >= 128, F.coalesce(table[x], x)).otherwise(x))


# Transcoder: numbers, hexadecimal runs, tokens --------------------------------------------------------------------

_TRANS = alternation([t for t, _ in TRANSCODER], "[0-9]+|[a-f][0-9a-f]*|(?s:.)", by_length=False)


def u64_le_hex(digits: Column) -> Column:
    """Decimal digits as 16 hexadecimal digits, least byte first."""
    wide = F.lpad(F.conv(digits, 10, 16), 16, "0")
    return F.concat(*[F.substring(wide, i, 2) for i in range(15, 0, -2)])


def byte_hex(n: Column) -> Column:
    return F.lpad(F.hex(n), 2, "0")


def trans_pack_hex(text: Column) -> Column:
    """Byte text with numbers of 8 to 20 digits, even runs of 8 to 510 hexadecimal digits and common tokens packed
    behind 7E; hexadecimal digits of the result. A longer hexadecimal run stays literal: its length has one byte."""
    table = literal_map({t: f"7E03{i:02X}" for t, i in TRANSCODER})

    def each(x: Column) -> Column:
        n = F.length(x)
        number = x.rlike("^[0-9]+$") & n.between(8, 20) & ((n < 20) | (x <= F.lit(U64_MAX)))
        digits = x.rlike("^[a-f][0-9a-f]*$") & (n >= 8) & (n <= 510) & (n % 2 == 0)
        return (
            F.when(n == 1, F.when(x == "~", F.lit("7E7E")).otherwise(hex_bytes(x)))
            .when(table[x].isNotNull(), table[x])
            .when(number, F.concat(F.lit("7E01"), byte_hex(n), u64_le_hex(x)))
            .when(digits, F.concat(F.lit("7E02"), byte_hex((n / 2).cast("int")), F.upper(x)))
            .otherwise(hex_bytes(x))
        )

    return joined(pieces(text, _TRANS), each)


# Templates --------------------------------------------------------------------------------------------------------


def template_parts(pattern: str) -> list[str]:
    """The literals around a template's slots."""
    return re.split(r"\{\d+\}", pattern)


def template_regex(pattern: str) -> str:
    """Each slot ends at the first occurrence of the literal after it, without a second try: atomic groups."""
    first, *rest = template_parts(pattern)
    body = "".join(f"(?>((?s:.*?)){quote(x)})" if x else "((?s:.*))" for x in rest)
    return rf"\A{quote(first)}{body}\z"


def template_match(url: Column) -> Column:
    """struct<id, slots> of the first template in order of id that the whole link fits; else null."""
    found = []
    for i, pattern in TEMPLATES.items():
        regex = template_regex(pattern)
        slots = F.array(*[F.regexp_extract(url, regex, k + 1) for k in range(len(template_parts(pattern)) - 1)])
        found.append(F.when(url.rlike(regex), F.struct(F.lit(i).alias("id"), slots.alias("slots"))))
    return F.coalesce(*found)


def template_pack_hex(match: Column) -> Column:
    """Number, count of slots, and each slot's length (two bytes from 128 on) and bytes, as hexadecimal digits."""

    def slot(s: Column) -> Column:
        n = F.octet_length(s)
        size = F.when(n < 128, byte_hex(n)).otherwise(F.concat(byte_hex(F.shiftright(n, 8).bitwiseOR(0x80)), byte_hex(n.bitwiseAND(255))))
        return F.concat(size, F.hex(F.encode(s, "UTF-8")))

    return F.concat(byte_hex(match["id"]), byte_hex(F.size(match["slots"])), joined(match["slots"], slot))


def template_expand(number: Column, slots: Column) -> Column:
    """The link of a template and its slots; null for an unknown number or another count of slots. Slots go in at
    once: a slot that contains {k} stays as it is."""
    out = F.lit(None).cast("string")
    for i, pattern in TEMPLATES.items():
        parts = template_parts(pattern)
        text = F.concat(F.lit(parts[0]), *[x for k, p in enumerate(parts[1:]) for x in (F.element_at(slots, k + 1), F.lit(p))])
        out = F.when((number == i) & (F.size(slots) == len(parts) - 1), text).otherwise(out)
    return out


# Run lengths, symbols ---------------------------------------------------------------------------------------------


def rle_hex(text: Column) -> Column:
    """Runs of 3 to 255 equal bytes as FF n b, a literal FF as FF 00 FF, behind 01; or 00 and the bytes where that is
    not shorter. Empty stays empty."""

    def run(x: Column) -> Column:
        n, b = F.length(x), hex_bytes(F.substring(x, 1, 1))
        return F.when(n >= 3, F.concat(F.lit("FF"), byte_hex(n), b)).otherwise(F.repeat(F.when(b == "FF", F.lit("FF00FF")).otherwise(b), n))

    packed = joined(F.regexp_extract_all(text, F.lit(r"(((?s:.))\2{0,254})"), F.lit(1)), run)
    plain = hex_bytes(text)
    return F.when(plain == "", F.lit("")).when(F.length(packed) < F.length(plain), F.concat(F.lit("01"), packed)).otherwise(F.concat(F.lit("00"), plain))


def rle_restore(packed: Column) -> Column:
    """Byte text of an RLE payload given as hexadecimal digits; null if its mode or length is wrong."""
    body = byte_text(F.unhex(F.substring(packed, F.lit(3), F.length(packed))))
    runs = joined(pieces(body, r"(\xFF(?s:..)|(?s:.))"), lambda x: F.when(F.length(x) == 3, F.when(F.substring(x, 2, 1) == "\x00", F.lit("ÿ")).otherwise(F.repeat(F.substring(x, 3, 1), F.ascii(F.substring(x, 2, 1))))).otherwise(x))
    mode = F.substring(packed, 1, 2)
    return F.when(packed == "", F.lit("")).when(mode == "00", body).when((mode == "01") & ~body.rlike(r"\xFF(?s:.)?\z") | body.rlike(r"\xFF\x00\xFF\z"), runs)


_SYMBOLS = alternation(SYMBOLS, "(?s:.)", by_length=False)


def symbol_hex(text: Column) -> Column:
    """Symbols as FF and their number, a literal FF as FF FE."""
    table = literal_map({t: f"FF{i:02X}" for i, t in enumerate(SYMBOLS)})
    return joined(pieces(text, _SYMBOLS), lambda x: F.when(F.length(x) > 1, table[x]).when(x == "ÿ", F.lit("FFFE")).otherwise(hex_bytes(x)))


def symbol_restore(packed: Column) -> Column:
    table = literal_map({f"FF{i:02X}": t for i, t in enumerate(SYMBOLS)})
    return joined(pieces(packed, "(FF[0-9A-F]{2}|[0-9A-F]{2})"), lambda x: F.when(x == "FFFE", F.lit("ÿ")).when(F.length(x) == 4, table[x]).otherwise(byte_text(F.unhex(x))))


# Bytes of two texts -----------------------------------------------------------------------------------------------


def characters(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, F.lit("")))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading characters."""
    same = F.zip_with(characters(a), characters(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise((first - 1).cast("int"))


def equal_places(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(characters(a), characters(b), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))


def similarity(a: Column, b: Column) -> Column:
    """Equal places over the longer length; 0 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), equal_places(a, b) / longest).otherwise(F.lit(0.0))


def same_places(anchor: Column, target: Column) -> Column:
    """Of each of the first 256 places, whether target has a character there that equals anchor's."""
    first = [characters(F.substring(x, 1, 256)) for x in (anchor, target)]
    return F.zip_with(*first, lambda x, y: F.coalesce(x == y, F.lit(False)))


def mask_word(same: Column, word: int) -> Column:
    """Bits of 64 of the places from 64 * word."""
    return F.aggregate(F.reverse(F.slice(same, 64 * word + 1, 64)), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x, 1).otherwise(0)))


def delta_mask(anchor: Column, target: Column, word: int) -> Column:
    """Bits of 64 places from 64 * word: set where target equals anchor."""
    return mask_word(same_places(anchor, target), word)


def delta_diffs(anchor: Column, target: Column) -> Column:
    """Characters of target that differ from anchor's, and all from place 256 on."""
    return diffs_of(same_places(F.coalesce(anchor, F.lit("")), target), target)


def diffs_of(same: Column, target: Column) -> Column:
    # Characters are an argument, evaluated once a row; inside the lambda they would be split again for each place.
    kept = F.zip_with(same, characters(F.substring(target, 1, 256)), lambda s, y: F.when(~s, y))
    return F.concat(F.array_join(kept, ""), F.substring(target, 257, 1 << 30))


# Small functions --------------------------------------------------------------------------------------------------

_M32 = 0xFFFFFFFF


def fingerprint32(text: Column) -> Column:
    """32-bit fingerprint of adjacent byte pairs: a multiplicative and a rotating sum, combined by exclusive or."""
    codes = F.transform(characters(text), lambda c: F.ascii(c).cast("long"))
    n = F.size(codes)
    pairs = F.zip_with(F.slice(codes, 1, F.greatest(n - 1, F.lit(0))), F.slice(codes, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a * 256 + b)

    def step(s: Column, v: Column) -> Column:
        one = (s["a"] * 0x01000193).bitwiseAND(_M32).bitwiseXOR(v)
        two = (s["b"] + v).bitwiseAND(_M32)
        return F.struct(one.alias("a"), F.shiftleft(two, 5).bitwiseOR(F.shiftright(two, 27)).bitwiseAND(_M32).alias("b"))

    start = F.struct(F.lit(0x811C9DC5).cast("long").alias("a"), F.lit(0x517CC1B7).cast("long").alias("b"))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, start, step, lambda s: s["a"].bitwiseXOR(s["b"])))


def context_hash(text: Column, order: int) -> Column:
    """h = h * 31 + byte over the last `order` bytes, in 32 bits."""
    last = F.substring(text, F.greatest(F.length(text) - order + 1, F.lit(1)), F.lit(order))
    return F.aggregate(F.transform(characters(last), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda h, b: (h * 31 + b).bitwiseAND(_M32))


def mix_probabilities(probs: Column, weights: Column) -> Column:
    """Weighted mean; a missing weight is 1, no probabilities give 1/256, weights that sum to 0 or less the first."""
    pairs = F.transform(probs, lambda p, i: F.struct(p.alias("p"), F.coalesce(F.get(weights, i), F.lit(1.0)).alias("w")))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["w"])
    return F.when(F.size(probs) == 0, F.lit(1 / 256)).when(total <= 0, F.get(probs, F.lit(0))).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["w"] * x["p"]) / total)


def tag_id(char: Column) -> Column:
    """Number of a code's first character: 0-3, then a-z from 4 on; null for any other."""
    code = F.ascii(char)
    return F.when(char.rlike(r"\A[0-3]\z"), code - 48).when(char.rlike(r"\A[a-z]\z"), code - 97 + 4)


def tag_char(number: Column) -> Column:
    return F.when(number.between(0, 3), F.chr(number + 48)).when(number.between(4, 25), F.chr(number + 93)).otherwise(F.lit("0"))


def ratio(raw: Column, packed: Column) -> Column:
    return F.when(raw == 0, F.lit(1.0)).otherwise(packed / raw)


def is_web(url: Column) -> Column:
    return F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))


def liveness_by_scheme(url: Column) -> Column:
    """What the scheme alone tells: Alive, Unknown, or null for a web link, which must be asked."""
    return F.when(url.rlike(r"\A(mailto:|ipfs://|magnet:|urn:)"), F.lit("Alive")).when(~is_web(url), F.lit("Unknown"))


def liveness_by_status(status: Column) -> Column:
    return (
        F.when(status.between(200, 299), F.lit("Alive"))
        .when(status.isin(301, 308), F.lit("Changed"))
        .when(status.between(302, 307), F.lit("Alive"))
        .when(status.isin(404, 410), F.lit("Dead"))
        .otherwise(F.lit("Error"))
    )


def format_bytes(n: Column) -> Column:
    """Bytes, or hundredths of the largest binary unit below n, rounded half to even by integers: n as a double over the
    unit is exact, and a double's shortest decimal form may be a tie where the double is none."""
    # The largest double below 2^63, which reads alike, in place of 2^63.
    exact = F.least(n.cast("long"), F.lit((1 << 63) - 1024)).cast("double").cast("long")

    def unit(size: int, name: str) -> Column:
        one = F.lit(size).cast("long")
        whole, parts = F.call_function("div", exact, one), exact % one * 100
        cents, rest = F.call_function("div", parts, one), parts % one
        up = (rest * 2 > size) | ((rest * 2 == size) & (cents % 2 == 1))
        total = cents + F.when(up, 1).otherwise(0)
        return F.format_string(f"%d.%02d {name}", whole + F.call_function("div", total, F.lit(100).cast("long")), total % 100)

    kb, mb, gb = 1024, 1024**2, 1024**3
    return F.when(n < kb, F.format_string("%d B", n)).when(n < mb, unit(kb, "KB")).when(n < gb, unit(mb, "MB")).otherwise(unit(gb, "GB"))


def shorten_text(text: Column) -> Column:
    return F.when(F.length(text) > 45, F.concat(F.substring(text, 1, 42), F.lit("..."))).otherwise(text)
