"""Queries of the codecs (projections, filters, deltas) with their oracles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.functions import codec, kernels
from linkfold.functions.fixed import ALPHABET, TEMPLATES
from linkfold.plans import duck
from linkfold.sources.links import delimiter_column, order_links, page_links, with_scheme

S, D = SparkSession, DataFrame


def flagship(spark: S, sf_dir: str) -> D:
    """Savings of the direct code by scheme and registered domain: one scan, one small aggregate."""
    links = page_links(spark, sf_dir)
    norm = codec.normalize(F.col("url"))
    domain = F.regexp_extract("norm", r"^[^:]*://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+)", 1)
    rows = links.select(norm.alias("norm")).select(F.split_part("norm", F.lit("://"), F.lit(1)).alias("scheme"), domain.alias("domain"), F.octet_length("norm").alias("raw"), (F.length(codec.trans_pack_hex(codec.tokenize(F.col("norm")))) / 2 + 1).cast("long").alias("packed"))
    out = rows.groupBy("scheme", "domain").agg(F.count("*").alias("links"), F.sum("raw").cast("long").alias("raw_bytes"), F.sum("packed").alias("packed_bytes"))
    return out.withColumn("saved_permille", F.expr("((raw_bytes - packed_bytes) * 1000) div raw_bytes"))


FLAGSHIP = duck.links(
    duck.PAGES,
    f""", n AS (SELECT {duck.normalize("url")} AS norm FROM links),
 r AS (SELECT split_part(norm, '://', 1) AS scheme, regexp_extract(norm, '^[^:]*://(?:[^/?#]*\\.)?([^./?#]+\\.[^./?#]+)', 1) AS domain, strlen(norm) AS raw, length({duck.trans_pack(duck.tokenize("norm"))}) // 2 + 1 AS packed FROM n)
SELECT scheme, domain, count(*) AS links, sum(raw)::BIGINT AS raw_bytes, sum(packed)::BIGINT AS packed_bytes, ((sum(raw) - sum(packed)) * 1000 // sum(raw))::BIGINT AS saved_permille FROM r GROUP BY ALL""",
)


def normalize(spark: S, sf_dir: str) -> D:
    return order_links(spark, sf_dir).select("seq", codec.normalize(F.col("url")).alias("norm"))


def tokenize(spark: S, sf_dir: str) -> D:
    return order_links(spark, sf_dir).select("seq", codec.hex_bytes(codec.tokenize(codec.normalize(F.col("url")))).alias("bytes"))


def detokenize(spark: S, sf_dir: str) -> D:
    return order_links(spark, sf_dir).select("seq", codec.detokenize(codec.tokenize(codec.normalize(F.col("url")))).alias("url"))


def trans_pack(spark: S, sf_dir: str) -> D:
    return order_links(spark, sf_dir).select("seq", codec.trans_pack_hex(codec.normalize(F.col("url"))).alias("packed"))


def trans_unpack(spark: S, sf_dir: str) -> D:
    unpack = kernels.binary_udf(kernels.trans_unpack)
    packed = F.unhex(codec.trans_pack_hex(codec.normalize(F.col("url"))))
    return order_links(spark, sf_dir).select("seq", codec.byte_text(unpack(packed)).alias("url"))


def _template(spark: S, sf_dir: str) -> D:
    # The generator keeps the match, 13 regular expressions, from being computed anew for each use of it.
    return order_links(spark, sf_dir).select("seq", F.explode(F.array(codec.template_match(codec.normalize(F.col("url"))))).alias("m"))


def template_match(spark: S, sf_dir: str) -> D:
    return _template(spark, sf_dir).select("seq", F.col("m.id").alias("template"), F.array_join("m.slots", "|").alias("slots"))


def template_pack(spark: S, sf_dir: str) -> D:
    return _template(spark, sf_dir).where("m IS NOT NULL").select("seq", codec.template_pack_hex(F.col("m")).alias("packed"))


def template_expand(spark: S, sf_dir: str) -> D:
    return _template(spark, sf_dir).where("m IS NOT NULL").select("seq", codec.template_expand(F.col("m.id"), F.col("m.slots")).alias("url"))


def _templates_sql() -> str:
    """The slots by the first occurrence of the next literal, as nested strpos and substr."""
    cases = []
    for i, pattern in TEMPLATES.items():
        first, *rest = codec.template_parts(pattern)
        left, ok, slots = f"substr(u, {len(first) + 1})", [f"starts_with(u, {duck.text(first)})"], []
        for x in rest:
            if not x:
                slots.append(left)
                left = "''"
            else:
                ok.append(f"strpos({left}, {duck.text(x)}) > 0")
                slots.append(f"substr({left}, 1, (strpos({left}, {duck.text(x)}) - 1)::BIGINT)")
                left = f"substr({left}, strpos({left}, {duck.text(x)}) + {len(x)})"
        ok.append(f"{left} = ''")
        cases.append(f"WHEN {' AND '.join(ok)} THEN {{'id': {i}, 'slots': [{', '.join(slots)}]}}")
    return f"t AS (SELECT seq, u, CASE {' '.join(cases)} END AS m FROM (SELECT seq, {duck.normalize('url')} AS u FROM links))"


def rle(spark: S, sf_dir: str) -> D:
    return order_links(spark, sf_dir).select("seq", codec.rle_hex(F.col("url")).alias("packed"))


RLE = duck.links(
    body=f""", c AS (SELECT seq, unnest({duck.chars("url")}) AS ch, generate_subscripts({duck.chars("url")}, 1) AS i FROM links),
 g AS (SELECT *, i - row_number() OVER (PARTITION BY seq, ch ORDER BY i) AS grp FROM c),
 r AS (SELECT seq, ch, grp, min(i) AS i, count(*) AS n FROM g GROUP BY ALL),
 p AS (SELECT seq, string_agg(CASE WHEN n >= 3 THEN 'FF' || printf('%02X', n) || printf('%02X', unicode(ch)) ELSE repeat(printf('%02X', unicode(ch)), n) END, '' ORDER BY i) AS x, string_agg(repeat(printf('%02X', unicode(ch)), n), '' ORDER BY i) AS y FROM r GROUP BY seq)
SELECT seq, CASE WHEN length(x) < length(y) THEN '01' || x ELSE '00' || y END AS packed FROM p"""
)


def rle_roundtrip(spark: S, sf_dir: str) -> D:
    return order_links(spark, sf_dir).select("seq", codec.rle_restore(codec.rle_hex(F.col("url"))).alias("url"))


def symbol(spark: S, sf_dir: str) -> D:
    return order_links(spark, sf_dir).select("seq", codec.symbol_hex(F.col("url")).alias("packed"))


def symbol_roundtrip(spark: S, sf_dir: str) -> D:
    return order_links(spark, sf_dir).select("seq", codec.symbol_restore(codec.symbol_hex(F.col("url"))).alias("url"))


def base66(spark: S, sf_dir: str) -> D:
    """The code of each whole link. Numbers of this size are beyond SQL; a test holds the codes against whole-number arithmetic."""
    return order_links(spark, sf_dir).select("seq", kernels.base66_udf(F.encode(F.trim("url"), "UTF-8")).alias("code"))


def base66_roundtrip(spark: S, sf_dir: str) -> D:
    code = kernels.base66_udf(F.encode("url", "UTF-8"))
    return order_links(spark, sf_dir).select("seq", F.decode(kernels.base66_decode_udf(code), "UTF-8").alias("url"))


def encode_len(spark: S, sf_dir: str) -> D:
    """Sizes of the direct and the template payload of each link."""
    norm = order_links(spark, sf_dir).select("seq", codec.normalize(F.col("url")).alias("u"))
    match = codec.template_match(F.col("u"))
    packed = codec.trans_pack_hex(codec.byte_text(F.unhex(codec.template_pack_hex(F.col("m")))))
    return norm.withColumn("m", match).select("seq", F.octet_length("u").cast("long").alias("raw"), (F.length(codec.trans_pack_hex(codec.tokenize(F.col("u")))) / 2 + 1).cast("long").alias("direct"), (F.length(packed) / 2).cast("long").alias("template"))


def encode(spark: S, sf_dir: str) -> D:
    return order_links(spark, sf_dir).select("seq", kernels.encode_udf()(F.col("url")).alias("code"))


def encode_roundtrip(spark: S, sf_dir: str) -> D:
    out = encode(spark, sf_dir).select("seq", kernels.resolve_udf()(F.col("code")).alias("r"))
    return out.select("seq", F.col("r.url").alias("norm"), F.col("r.error").alias("error"))


def batch_decode(spark: S, sf_dir: str) -> D:
    """Codes as lines, some of them damaged: the link or what is wrong."""
    code = F.when(F.col("seq") % 10 == 0, F.concat(F.lit("$"), F.col("code"))).otherwise(F.concat(F.lit(" "), F.col("code")))
    lines = encode(spark, sf_dir).select("seq", F.trim(code).alias("code")).where("code != ''")
    out = lines.select("seq", kernels.resolve_udf()(F.col("code")).alias("r"))
    return out.select("seq", F.col("r.url").alias("norm"), F.col("r.error").isNotNull().alias("failed"))


def grammar_roundtrip(spark: S, sf_dir: str) -> D:
    again = kernels.binary_udf(lambda b: kernels.repair_expand(*kernels.grammar_unpack(kernels.grammar_pack(*kernels.repair(b)))))
    return order_links(spark, sf_dir).select("seq", codec.byte_text(again(F.encode("url", "UTF-8"))).alias("url"))


def rans_roundtrip(spark: S, sf_dir: str) -> D:
    again = kernels.binary_udf(lambda b: kernels.rans_decode(kernels.rans_encode(b, kernels.generic_frequencies()), len(b), kernels.generic_frequencies()))
    return order_links(spark, sf_dir).select("seq", codec.byte_text(again(F.encode("url", "UTF-8"))).alias("url"))


def mtf(spark: S, sf_dir: str) -> D:
    """Move-to-front ranks of the links of `pages`, by position."""
    ranks = kernels.binary_udf(kernels.move_to_front)
    rows = page_links(spark, sf_dir).select("seq", ranks(F.encode("url", "UTF-8")).alias("r"))
    return rows.select("seq", F.hex("r").alias("ranks"))


MTF = duck.links(
    duck.PAGES,
    f""", c AS (SELECT seq, unnest({duck.chars("url")}) AS ch, generate_subscripts({duck.chars("url")}, 1) AS i FROM links),
 p AS (SELECT *, lag(i) OVER (PARTITION BY seq, ch ORDER BY i) AS before FROM c),
 r AS (SELECT a.seq, a.i, CASE WHEN a.before IS NOT NULL THEN (SELECT count(DISTINCT b.ch) FROM c b WHERE b.seq = a.seq AND b.i > a.before AND b.i < a.i)
   ELSE unicode(a.ch) + (SELECT count(DISTINCT b.ch) FROM c b WHERE b.seq = a.seq AND b.i < a.i AND b.ch > a.ch) END AS r FROM p a)
SELECT seq, string_agg(printf('%02X', r), '' ORDER BY i) AS ranks FROM r GROUP BY seq""",
)


def tag_parse(spark: S, sf_dir: str) -> D:
    first = F.substring("url", F.lit(2) + (F.col("seq") % 7).cast("int"), F.lit(1))
    out = page_links(spark, sf_dir).select("seq", first.alias("c")).select("seq", "c", codec.tag_id(F.col("c")).cast("long").alias("tag"))
    return out.withColumn("back", codec.tag_char(F.col("tag")))


def score(spark: S, sf_dir: str) -> D:
    """Ratio of packed to raw size, in permille."""
    norm = codec.normalize(F.col("url"))
    raw, packed = F.octet_length(norm), F.length(codec.trans_pack_hex(codec.tokenize(norm))) / 2 + 1
    return order_links(spark, sf_dir).select("seq", F.floor(codec.ratio(raw, packed) * 1000 + 0.0000001).cast("long").alias("permille"))


def _pairs(spark: S, sf_dir: str) -> D:
    """Each link and the one three orders before it."""
    links = order_links(spark, sf_dir)
    other = links.select((F.col("seq") + 12).alias("seq"), F.col("url").alias("anchor"))
    return links.join(other, "seq")


def _compared(spark: S, sf_dir: str) -> D:
    """Pairs, with their equal places found once for all masks and diffs."""
    return _pairs(spark, sf_dir).withColumn("same", codec.same_places(F.col("anchor"), F.col("url")))


_PAIRS = duck.links(body=", pairs AS (SELECT a.seq, a.url, b.url AS anchor FROM links a JOIN links b ON a.seq = b.seq + 12)")


def delta_diff(spark: S, sf_dir: str) -> D:
    s, u = F.col("same"), F.col("url")
    return _compared(spark, sf_dir).select("seq", codec.mask_word(s, 0).alias("mask0"), codec.mask_word(s, 1).alias("mask1"), codec.diffs_of(s, u).alias("diffs"), F.length("url").cast("long").alias("target_len"))


_SAME = f"list_transform({duck.chars('url')}, lambda c, i: coalesce(c = {duck.chars('anchor')}[i], false))"


def _mask_sql(word: int) -> str:
    bits = f"list_transform(list_slice(same, {64 * word + 1}, {64 * word + 64}), lambda s, i: CASE WHEN s THEN (1::UBIGINT << (i - 1))::HUGEINT ELSE 0::HUGEINT END)"
    total = f"coalesce(list_sum({bits}), 0)"
    return f"(CASE WHEN {total} >= 9223372036854775808 THEN {total} - 18446744073709551616 ELSE {total} END)::BIGINT"


DELTA = f"""{_PAIRS}, s AS (SELECT *, {_SAME} AS same FROM pairs)
SELECT seq, {_mask_sql(0)} AS mask0, {_mask_sql(1)} AS mask1,
 array_to_string(list_transform({duck.chars("url")}, lambda c, i: CASE WHEN i <= 256 AND same[i] THEN '' ELSE c END), '') AS diffs, length(url)::BIGINT AS target_len FROM s"""


def delta_roundtrip(spark: S, sf_dir: str) -> D:
    """Deltas applied to their anchors give the links again."""

    @F.pandas_udf("string")
    def apply(anchor: pd.Series, size: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, diffs: pd.Series) -> pd.Series:
        rows = zip(anchor, size, a, b, c, d, diffs, strict=True)
        return pd.Series([kernels.delta_apply(x.encode(), n, [w % (1 << 64) for w in ws], y.encode()).decode() for x, n, *ws, y in rows])

    s, u = F.col("same"), F.col("url")
    return _compared(spark, sf_dir).select("seq", apply(F.col("anchor"), F.length(u), *[codec.mask_word(s, w) for w in range(4)], codec.diffs_of(s, u)).alias("url"))


def similarity(spark: S, sf_dir: str) -> D:
    return _pairs(spark, sf_dir).select("seq", F.floor(codec.similarity(F.col("anchor"), F.col("url")) * 10000 + 0.0000001).cast("long").alias("similarity")).where("similarity >= 3500")


def fingerprint32(spark: S, sf_dir: str) -> D:
    return order_links(spark, sf_dir).select("seq", codec.fingerprint32(F.col("url")).alias("h"))


_U32 = 4294967296
FINGERPRINT = duck.links(
    body=f""", c AS (SELECT seq, list_transform({duck.chars("url")}, lambda p: unicode(p)::BIGINT) AS b FROM links),
 w AS (SELECT seq, list_transform(range(1, len(b)), lambda i: b[i] * 256 + b[i + 1]) AS v FROM c),
 f AS (SELECT seq, list_reduce(v, lambda h, x: xor((h * 16777619) % {_U32}, x), {0x811C9DC5}::BIGINT) AS h1,
  list_reduce(v, lambda h, x: (((h + x) % {_U32}) * 32) % {_U32} + ((h + x) % {_U32}) // 134217728, {0x517CC1B7}::BIGINT) AS h2 FROM w)
SELECT seq, xor(h1, h2)::BIGINT AS h FROM f"""
)


def ctx_hash(spark: S, sf_dir: str) -> D:
    return order_links(spark, sf_dir).select("seq", codec.context_hash(F.col("url"), 6).alias("h"))


CTX = duck.links(body=f"SELECT seq, list_reduce(list_transform({duck.chars('right(url, 6)')}, lambda p: unicode(p)::BIGINT), lambda h, x: (h * 31 + x) % {_U32}, 0::BIGINT)::BIGINT AS h FROM links")


def mix(spark: S, sf_dir: str) -> D:
    """Weighted mean of three probabilities by key, one weight missing."""
    p = F.array(*[((F.col("seq") % k) / F.lit(float(k))) for k in (7, 11, 13)])
    return order_links(spark, sf_dir).select("seq", F.round(codec.mix_probabilities(p, F.array(F.lit(0.5), F.lit(2.0))), 6).alias("p"))


MIX = duck.links(body="SELECT seq, round((0.5::DOUBLE * ((seq % 7) / 7.0::DOUBLE) + 2.0::DOUBLE * ((seq % 11) / 11.0::DOUBLE) + (seq % 13) / 13.0::DOUBLE) / 3.5::DOUBLE, 6) AS p FROM links")


def predicates(spark: S, sf_dir: str) -> D:
    """Scheme filters of links, and prefixing of bare hosts."""
    out = order_links(spark, sf_dir).where(F.length(F.trim("url")) > 0)
    return out.select("seq", codec.is_web(F.col("url")).alias("web"), codec.liveness_by_scheme(F.col("url")).alias("by_scheme"), with_scheme(F.trim("url")).alias("full"), delimiter_column(F.col("url")).alias("sep"))


PREDICATES = duck.links(
    body="""SELECT seq, starts_with(url, 'http://') OR starts_with(url, 'https://') AS web,
 CASE WHEN regexp_matches(url, '^(mailto:|ipfs://|magnet:|urn:)') THEN 'Alive' WHEN NOT (starts_with(url, 'http://') OR starts_with(url, 'https://')) THEN 'Unknown' END AS by_scheme,
 CASE WHEN regexp_matches(trim(url), '^(https?://|ipfs://|magnet:|mailto:|bitcoin:)') THEN trim(url) ELSE 'https://' || trim(url) END AS full,
 CASE WHEN contains(url, chr(9)) THEN 'tab' WHEN contains(url, ',') THEN 'comma' ELSE 'newline' END AS sep FROM links WHERE length(trim(url)) > 0"""
)


def liveness(spark: S, sf_dir: str) -> D:
    """State of each link from its scheme, or from an HTTP status made from its key."""
    status = (F.lit(200) + (F.col("seq") * 7) % 305).cast("int")
    out = order_links(spark, sf_dir).select("url", status.alias("status"))
    state = F.coalesce(codec.liveness_by_scheme(F.col("url")), codec.liveness_by_status(F.col("status")))
    return out.select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


LIVENESS = duck.links(
    body="""SELECT CASE WHEN regexp_matches(url, '^(mailto:|ipfs://|magnet:|urn:)') THEN 'Alive' WHEN NOT (starts_with(url, 'http://') OR starts_with(url, 'https://')) THEN 'Unknown'
 WHEN s BETWEEN 200 AND 299 THEN 'Alive' WHEN s IN (301, 308) THEN 'Changed' WHEN s BETWEEN 302 AND 307 THEN 'Alive' WHEN s IN (404, 410) THEN 'Dead' ELSE 'Error' END AS state, count(*) AS n
 FROM (SELECT url, 200 + (seq * 7) % 305 AS s FROM links) GROUP BY ALL"""
)


def formats(spark: S, sf_dir: str) -> D:
    n = F.col("seq") * F.col("seq") * 1000
    return order_links(spark, sf_dir).select("seq", codec.format_bytes(n).alias("size"), F.format_number(n, 0).alias("grouped"), codec.shorten_text(F.col("url")).alias("shown"))


FORMATS = duck.links(
    body="""SELECT seq, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576) ELSE printf('%.2f GB', n / 1073741824) END AS size,
 format('{:,}', n) AS grouped, CASE WHEN length(url) > 45 THEN substr(url, 1, 42) || '...' ELSE url END AS shown FROM (SELECT seq, url, seq * seq * 1000 AS n FROM links)"""
)


def blake3(spark: S, sf_dir: str) -> D:
    return order_links(spark, sf_dir).select("seq", F.hex(kernels.blake3_udf(F.col("url"))).alias("digest"))


def queries() -> dict:
    names = [flagship, normalize, tokenize, detokenize, trans_pack, trans_unpack, template_match, template_pack, template_expand, rle, rle_roundtrip, symbol, symbol_roundtrip, base66, base66_roundtrip, encode_len, encode, encode_roundtrip, batch_decode, grammar_roundtrip, rans_roundtrip, mtf, tag_parse, score, delta_diff, delta_roundtrip, similarity, fingerprint32, ctx_hash, mix, predicates, liveness, formats, blake3]
    return {f"q_{f.__name__}": f for f in names}


def oracle_sql() -> dict[str, str]:
    norm = duck.normalize("url")
    same = duck.links(body="SELECT seq, url FROM links")
    normal = duck.links(body=f"SELECT seq, {norm} AS url FROM links")
    packed = f"length({duck.trans_pack(duck.tokenize('u'))}) // 2 + 1"
    t = duck.links(body=f", {_templates_sql()} ")
    slot = "array_to_string(list_transform(m.slots, lambda s: CASE WHEN strlen(s) < 128 THEN printf('%02X', strlen(s)) ELSE printf('%02X', 128 | (strlen(s) >> 8)) || printf('%02X', strlen(s) & 255) END || hex(s)), '')"
    packed_template = f"printf('%02X', m.id) || printf('%02X', len(m.slots)) || {slot}"
    latin = duck.each("x", "(..)", "chr(('0x' || p)::INTEGER)")
    return {
        "q_flagship": FLAGSHIP,
        "q_normalize": duck.links(body=f"SELECT seq, {norm} AS norm FROM links"),
        "q_tokenize": duck.links(body=f"SELECT seq, {duck.hex_bytes(duck.tokenize(norm))} AS bytes FROM links"),
        "q_detokenize": normal,
        "q_trans_pack": duck.links(body=f"SELECT seq, {duck.trans_pack(norm)} AS packed FROM links"),
        "q_trans_unpack": normal,
        "q_template_match": f"{t} SELECT seq, m.id::INTEGER AS template, array_to_string(m.slots, '|') AS slots FROM t",
        "q_template_pack": f"{t} SELECT seq, {packed_template} AS packed FROM t WHERE m IS NOT NULL",
        "q_template_expand": f"{t} SELECT seq, u AS url FROM t WHERE m IS NOT NULL",
        "q_rle": RLE,
        "q_rle_roundtrip": same,
        "q_symbol": duck.links(body=f"SELECT seq, {duck.symbols('url')} AS packed FROM links"),
        "q_symbol_roundtrip": same,
        "q_base66_roundtrip": same,
        "q_encode_len": f"{t}, y AS (SELECT *, {packed_template} AS x FROM t) SELECT seq, strlen(u)::BIGINT AS raw, ({packed})::BIGINT AS direct, CASE WHEN m IS NOT NULL THEN (length({duck.trans_pack(latin)}) // 2)::BIGINT END AS template FROM y",
        "q_encode_roundtrip": duck.links(body=f"SELECT seq, {norm} AS norm, NULL::VARCHAR AS error FROM links"),
        "q_batch_decode": duck.links(body=f"SELECT seq, CASE WHEN seq % 10 != 0 THEN {norm} END AS norm, seq % 10 = 0 AS failed FROM links"),
        "q_grammar_roundtrip": same,
        "q_rans_roundtrip": same,
        "q_mtf": MTF,
        "q_tag_parse": duck.links(duck.PAGES, "SELECT *, CASE WHEN tag BETWEEN 0 AND 3 THEN chr((tag + 48)::INTEGER) WHEN tag BETWEEN 4 AND 25 THEN chr((tag + 93)::INTEGER) ELSE '0' END AS back FROM (SELECT seq, c, (CASE WHEN c BETWEEN '0' AND '3' THEN unicode(c) - 48 WHEN c BETWEEN 'a' AND 'z' THEN unicode(c) - 93 END)::BIGINT AS tag FROM (SELECT seq, substr(url, 2 + (seq % 7)::INTEGER, 1) AS c FROM links))"),
        "q_score": duck.links(body=f"SELECT seq, floor(({packed}) * 1000.0 / strlen(u) + 0.0000001)::BIGINT AS permille FROM (SELECT seq, {norm} AS u FROM links)"),
        "q_delta_diff": DELTA,
        "q_delta_roundtrip": f"{_PAIRS} SELECT seq, url FROM pairs",
        "q_similarity": f"{_PAIRS}, s AS (SELECT seq, floor(len(list_filter({_SAME}, lambda x: x)) * 10000.0 / greatest(length(url), length(anchor)) + 0.0000001)::BIGINT AS similarity FROM pairs) SELECT * FROM s WHERE similarity >= 3500",
        "q_fingerprint32": FINGERPRINT,
        "q_ctx_hash": CTX,
        "q_mix": MIX,
        "q_predicates": PREDICATES,
        "q_liveness": LIVENESS,
        "q_formats": FORMATS,
    }
