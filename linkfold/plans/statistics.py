"""Queries of training statistics, sketches and merges with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.functions import codec
from linkfold.functions.fixed import SCALE
from linkfold.operators import statistics as st
from linkfold.plans import duck
from linkfold.sources.links import order_links, page_links

S, D = SparkSession, DataFrame

_BYTES = f"b AS (SELECT seq, unnest(list_transform({duck.chars(duck.tokenize(duck.normalize('url')))}, lambda c: unicode(c))) AS sym, generate_subscripts({duck.chars(duck.tokenize(duck.normalize('url')))}, 1) AS i FROM links)"
_HIST = f"{_BYTES}, h AS (SELECT s.sym::INTEGER AS sym, coalesce(n, 0) + 1 AS count FROM range(256) s(sym) LEFT JOIN (SELECT sym, count(*) AS n FROM b GROUP BY sym) x ON x.sym = s.sym)"


def _table_sql(source: str) -> str:
    return f"""f0 AS (SELECT sym, (1 + count * {SCALE - 256} // sum(count) OVER ())::BIGINT AS f FROM {source}),
 f AS (SELECT sym, (f + CASE WHEN sym = 0 THEN {SCALE} - sum(f) OVER () ELSE 0 END)::BIGINT AS freq FROM f0),
 t AS (SELECT sym, freq, coalesce(sum(freq) OVER (ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM f)"""


def byte_hist(spark: S, sf_dir: str) -> D:
    return st.histogram(order_links(spark, sf_dir))


def freq_table(spark: S, sf_dir: str) -> D:
    return st.frequency_table(st.histogram(order_links(spark, sf_dir)))


def slots(spark: S, sf_dir: str) -> D:
    return st.slots(freq_table(spark, sf_dir)).select(F.col("slot").cast("long").alias("slot"), "sym")


def generic_profile(spark: S, sf_dir: str) -> D:
    return st.frequency_table(st.generic_counts(spark))


_GENERIC = "g AS (SELECT s.sym::INTEGER AS sym, (CASE WHEN sym >= 128 THEN 12 WHEN regexp_full_match(chr(sym::INTEGER), '[a-z]') THEN 10 WHEN regexp_full_match(chr(sym::INTEGER), '[0-9]') THEN 8 WHEN regexp_full_match(chr(sym::INTEGER), '[A-Z]') THEN 6 WHEN sym > 0 AND contains('-._~/:?&=%#+@', chr(sym::INTEGER)) THEN 15 ELSE 1 END)::BIGINT AS count FROM range(256) s(sym))"


def profile_bytes(spark: S, sf_dir: str) -> D:
    """The trained table as it is saved: 512 bytes, 16 bits each, least byte first."""
    rows = freq_table(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("sym", "freq"))).alias("t"))  # 256 rows
    two = lambda x: F.concat(codec.byte_hex(x["freq"].bitwiseAND(255)), codec.byte_hex(F.shiftright(x["freq"], 8)))
    return rows.select(F.array_join(F.transform("t", two), "").alias("bytes"))


def profile_load(spark: S, sf_dir: str) -> D:
    """A saved table read again."""
    saved = profile_bytes(spark, sf_dir)
    at = F.explode(F.sequence(F.lit(0), F.lit(255)))
    low = F.substring("bytes", F.col("sym") * 4 + 1, F.lit(2))
    high = F.substring("bytes", F.col("sym") * 4 + 3, F.lit(2))
    return saved.select("bytes", at.alias("sym")).select("sym", F.conv(F.concat(high, low), 16, 10).cast("long").alias("freq"))


def bigram(spark: S, sf_dir: str) -> D:
    return st.bigrams(order_links(spark, sf_dir))


_BIGRAM = f"{_BYTES}, g AS (SELECT coalesce(lag(sym) OVER (PARTITION BY seq ORDER BY i), 0)::INTEGER AS prev, sym::INTEGER AS cur FROM b), c AS (SELECT prev, cur, count(*) AS n FROM g GROUP BY ALL)"


def ctx_prob(spark: S, sf_dir: str) -> D:
    return st.context_probabilities(bigram(spark, sf_dir))


def top_pair(spark: S, sf_dir: str) -> D:
    return st.top_pair(order_links(spark, sf_dir))


def cms_build(spark: S, sf_dir: str) -> D:
    return st.sketch(page_links(spark, sf_dir).select(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1).alias("host")), "host")


_HOSTS = "hosts AS (SELECT regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS host FROM pages)"


def _cells(item: str) -> str:
    h = f"sha256(unhex(printf('%02X', r) || hex({item})))"
    return f"(('0x' || substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))::BIGINT % {st.COLUMNS})::INTEGER"


_SKETCH = f"{_HOSTS}, k AS (SELECT r::INTEGER AS row, {_cells('host')} AS col, count(*) AS n FROM hosts, range({st.ROWS}) x(r) GROUP BY ALL)"


def cms_query(spark: S, sf_dir: str) -> D:
    hosts = page_links(spark, sf_dir).select(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1).alias("host")).distinct()
    return st.sketch_query(cms_build(spark, sf_dir), hosts, "host")


def cms_merge(spark: S, sf_dir: str) -> D:
    hosts = page_links(spark, sf_dir).select("seq", F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1).alias("host"))
    return st.merge_counters(st.sketch(hosts.where("seq % 2 = 0"), "host"), st.sketch(hosts.where("seq % 2 = 1"), "host"), key=["row", "col"], value="n")


def approx(spark: S, sf_dir: str) -> D:
    """Built-in sketches: distinct hosts and quantiles of the links' lengths."""
    rows = order_links(spark, sf_dir)
    return rows.agg(F.approx_count_distinct("url", 0.02).alias("links"), F.percentile_approx(F.length("url"), [0.5, 0.9], 10000).alias("lengths"))


def gcounter(spark: S, sf_dir: str) -> D:
    return st.merge_counters(st.histogram(order_links(spark, sf_dir)), st.histogram(page_links(spark, sf_dir)), key=["sym"], value="count")


def profile_merge(spark: S, sf_dir: str) -> D:
    """Tables of two profiles added and scaled anew."""
    both = st.merge_counters(*[t.select("sym", F.col("freq").alias("count")) for t in (freq_table(spark, sf_dir), generic_profile(spark, sf_dir))], key=["sym"], value="count")
    return st.frequency_table(both)


def dp(spark: S, sf_dir: str) -> D:
    return st.privacy_noise(st.histogram(page_links(spark, sf_dir)), 0.25)


def queries() -> dict:
    return {f"q_{f.__name__}": f for f in (byte_hist, freq_table, slots, generic_profile, profile_bytes, profile_load, bigram, ctx_prob, top_pair, cms_build, cms_query, cms_merge, approx, gcounter, profile_merge, dp)}


def oracle_sql() -> dict[str, str]:
    table = f", {_HIST}, {_table_sql('h')}"
    le = "printf('%08X', count)"
    digest = f"sha256(unhex(printf('%02X', sym) || substr({le}, 7, 2) || substr({le}, 5, 2) || substr({le}, 3, 2) || substr({le}, 1, 2)))"
    second = _HIST.replace("FROM links", "FROM plinks").replace("b AS (", "b2 AS (").replace("FROM b GROUP", "FROM b2 GROUP").replace("h AS (", "h2 AS (")
    gtable = f", {_GENERIC}, {_table_sql('g')}"
    renamed = _table_sql("g").replace("f0 AS", "e0 AS").replace("FROM f0", "FROM e0").replace(" f AS (", " e AS (").replace("FROM f)", "FROM e)").replace(" t AS (", " u AS (")
    return {
        "q_byte_hist": duck.links(body=f", {_HIST} SELECT * FROM h"),
        "q_freq_table": duck.links(body=f"{table} SELECT * FROM t"),
        "q_slots": duck.links(body=f"{table} SELECT unnest(range(cum, cum + freq)) AS slot, sym FROM t"),
        "q_generic_profile": duck.links(body=f"{gtable} SELECT * FROM t"),
        "q_profile_bytes": duck.links(body=f"{table} SELECT string_agg(printf('%02X', freq % 256) || printf('%02X', freq // 256), '' ORDER BY sym) AS bytes FROM t"),
        "q_profile_load": duck.links(body=f"{table} SELECT sym, freq FROM t"),
        "q_bigram": duck.links(body=f", {_BIGRAM} SELECT * FROM c"),
        "q_ctx_prob": duck.links(body=f", {_BIGRAM} SELECT prev, cur, ((n + 1) * 1000000 // (sum(n) OVER (PARTITION BY prev) + 256))::BIGINT AS ppm FROM c"),
        "q_top_pair": duck.links(body=f", {_BIGRAM} SELECT * FROM c WHERE prev != 0 AND n >= 2 ORDER BY n DESC, prev, cur LIMIT 1"),
        "q_cms_build": f"WITH {_SKETCH} SELECT * FROM k",
        "q_cms_query": f"WITH {_SKETCH}, d AS (SELECT DISTINCT host FROM hosts), q AS (SELECT host, r AS row, {_cells('host')} AS col FROM d, range({st.ROWS}) x(r)) SELECT host, min(n) AS estimate FROM q JOIN k USING (row, col) GROUP BY host",
        "q_cms_merge": f"WITH {_SKETCH} SELECT * FROM k",
        "q_gcounter": duck.links(body=f", plinks AS ({duck.PAGES}), {_HIST}, {second} SELECT h.sym, (h.count + h2.count)::BIGINT AS count FROM h JOIN h2 ON h.sym = h2.sym"),
        "q_profile_merge": duck.links(body=f"{table}, {_GENERIC}, {renamed}, m AS (SELECT t.sym, (t.freq + u.freq)::BIGINT AS count FROM t JOIN u ON t.sym = u.sym), {_table_sql('m').replace('f0', 'd0').replace(' f AS (', ' d AS (').replace('FROM f)', 'FROM d)').replace(' t AS (', ' v AS (')} SELECT * FROM v"),
        "q_dp": f"WITH links AS ({duck.PAGES}), {_HIST} SELECT sym, greatest(1, count + ('0x' || substr({digest}, 1, 2))::INTEGER % 9 - 4)::BIGINT AS count FROM h",
    }
