"""DuckDB fragments that the oracles share, written from the formats' definitions."""

from __future__ import annotations

from linkfold.functions.codec import TOKENS, U64_MAX, _SYMBOLS, _TRANS
from linkfold.functions.fixed import ATLAS, SYMBOLS, TRANSCODER
from linkfold.sources.links import ORDER_LINK

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


PAGES = "SELECT page_id AS seq, url FROM pages"
ORDERS = f"SELECT o_orderkey AS seq, {ORDER_LINK} AS url FROM orders"


def links(source: str = ORDERS, body: str = "") -> str:
    return f"WITH links AS ({source}) {body}"


def normalize(x: str) -> str:
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN contains({t}, '://') THEN translate(split_part({t}, '://', 1), '{UP}', '{LOW}') || substr({t}, strpos({t}, '://')) ELSE {t} END"


def each(x: str, pattern: str, body: str) -> str:
    """The pieces of x, each put through `body`, a term of p, and joined."""
    return f"array_to_string(list_transform(regexp_extract_all({x}, {text(pattern)}, 1), lambda p: {body}), '')"


def chars(x: str) -> str:
    return f"regexp_extract_all({x}, '((?s:.))', 1)"


def hex_bytes(x: str) -> str:
    return each(x, "((?s:.))", "printf('%02X', unicode(p))")


def tokenize(x: str) -> str:
    return each(x, TOKENS, f"CASE WHEN length(p) > 1 THEN chr((127 + list_position({listing(ATLAS)}, p))::INTEGER) ELSE p END")


def trans_pack(x: str) -> str:
    tokens, numbers = listing([t for t, _ in TRANSCODER]), listing([f"7E03{i:02X}" for _, i in TRANSCODER])
    wide = "printf('%016X', TRY_CAST(p AS UBIGINT))"
    swapped = " || ".join(f"substr({wide}, {i}, 2)" for i in range(15, 0, -2))
    return each(
        x,
        _TRANS,
        f"CASE WHEN p = '~' THEN '7E7E' WHEN length(p) = 1 THEN printf('%02X', unicode(p)) "
        f"WHEN list_contains({tokens}, p) THEN {numbers}[list_position({tokens}, p)] "
        f"WHEN regexp_full_match(p, '[0-9]+') AND length(p) BETWEEN 8 AND 20 AND (length(p) < 20 OR p <= '{U64_MAX}') THEN '7E01' || printf('%02X', length(p)) || {swapped} "
        f"WHEN regexp_full_match(p, '[a-f][0-9a-f]*') AND length(p) BETWEEN 8 AND 510 AND length(p) % 2 = 0 THEN '7E02' || printf('%02X', length(p) // 2) || upper(p) "
        f"ELSE hex(p) END",
    )


def symbols(x: str) -> str:
    return each(x, _SYMBOLS, f"CASE WHEN length(p) > 1 THEN 'FF' || printf('%02X', list_position({listing(SYMBOLS)}, p) - 1) WHEN p = chr(255) THEN 'FFFE' ELSE printf('%02X', unicode(p)) END")
