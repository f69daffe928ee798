"""Extension: the standard relational categories over the business tables and links, which any engine of this kind needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkfold.functions import codec
from linkfold.plans import duck
from linkfold.sources.links import page_links
from linkfold.streaming import events as streams

S, D = SparkSession, DataFrame
_HOST = "^[^:]*://([^/?#]*)"


def _t(spark: S, sf_dir: str, name: str) -> D:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str):
    return F.round(F.col(c) * 100).cast("long")


def join_inner(spark: S, sf_dir: str) -> D:
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.sum(_money("o_totalprice")).alias("cents"))


def join_merge(spark: S, sf_dir: str) -> D:
    li, o = _t(spark, sf_dir, "lineitem").hint("merge"), _t(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_orderpriority").agg(F.count("*").alias("lines"))


def join_broadcast(spark: S, sf_dir: str) -> D:
    """nation and region have a fixed number of rows."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    s = _t(spark, sf_dir, "supplier")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.count("*").alias("suppliers"))


def join_theta(spark: S, sf_dir: str) -> D:
    """Each nation with those before it in its region: 25 rows, fixed."""
    n = _t(spark, sf_dir, "nation")
    a, b = n.alias("a"), F.broadcast(n).alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_name > b.n_name")).groupBy(F.col("a.n_name").alias("n_name")).agg(F.count("*").alias("before"))


def join_range(spark: S, sf_dir: str) -> D:
    """Orders in price bands: a range condition against a table of five bands."""
    bands = spark.createDataFrame([(i, i * 100_000.0, (i + 1) * 100_000.0) for i in range(5)], "band int, low double, high double")
    o = _t(spark, sf_dir, "orders")
    return o.join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("low")) & (F.col("o_totalprice") < F.col("high"))).groupBy("band").agg(F.count("*").alias("orders"))


def join_asof(spark: S, sf_dir: str) -> D:
    """For each purchase the user's last other event before it: one sort by user, no range join."""
    e = _t(spark, sf_dir, "events")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") != "purchase", F.col("event_id")), ignorenulls=True).over(before)
    return e.withColumn("before", last).where("event_type = 'purchase'").select("event_id", "before")


def join_full(spark: S, sf_dir: str) -> D:
    a = _t(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("a"))
    b = _t(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def join_semi(spark: S, sf_dir: str) -> D:
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_totalprice > 200000")
    with_ = c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", F.lit("with").alias("kind"))
    return with_.union(c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", F.lit("without")))


def rollup(spark: S, sf_dir: str) -> D:
    u = page_links(spark, sf_dir).select(F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme"), F.regexp_extract("url", _HOST, 1).alias("host"))
    return u.rollup("scheme", "host").agg(F.count("*").alias("links"), F.grouping_id().cast("long").alias("level"))


def cube(spark: S, sf_dir: str) -> D:
    return _t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def grouping_sets(spark: S, sf_dir: str) -> D:
    o = _t(spark, sf_dir, "orders")
    return o.groupingSets([("o_orderstatus",), ("o_orderpriority",), ()], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def pivot(spark: S, sf_dir: str) -> D:
    e = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("day").agg(*[F.count(F.when(F.col("event_type") == x, 1)).alias(x) for x in ("click", "view", "purchase")])


def unpivot(spark: S, sf_dir: str) -> D:
    return pivot(spark, sf_dir).unpivot("day", ["click", "view", "purchase"], "kind", "n")


def count_distinct(spark: S, sf_dir: str) -> D:
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


def window_rank(spark: S, sf_dir: str) -> D:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("quartile")).where("rn <= 5")


def window_lag(spark: S, sf_dir: str) -> D:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.first("o_orderkey").over(w).alias("first"))


def window_range(spark: S, sf_dir: str) -> D:
    """Orders of the same customer within 90 days before each."""
    day = F.col("o_orderdate").cast("timestamp").cast("long")
    w = Window.partitionBy("o_custkey").orderBy("at").rangeBetween(-90 * 86400, 0)
    return _t(spark, sf_dir, "orders").withColumn("at", day).select("o_orderkey", F.count("*").over(w).alias("recent"))


def topk(spark: S, sf_dir: str) -> D:
    return _t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", _money("o_totalprice").alias("cents"))


def setops(spark: S, sf_dir: str) -> D:
    a = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("k"))
    b = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 70).alias("k"))
    return a.intersect(b).withColumn("op", F.lit("intersect")).union(a.subtract(b).withColumn("op", F.lit("except"))).union(b.union(a).distinct().withColumn("op", F.lit("union")))


def subquery(spark: S, sf_dir: str) -> D:
    """Orders above their customer's mean: a correlated scalar subquery as join with an aggregate."""
    o = _t(spark, sf_dir, "orders").withColumn("cents", _money("o_totalprice"))
    mean = o.groupBy("o_custkey").agg(F.sum("cents").alias("s"), F.count("*").alias("n"))
    return o.join(mean, "o_custkey").where("cents * n > s").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def recursive(spark: S, sf_dir: str) -> D:
    """Expansion of a small grammar by a recursive query, as symbols of rules are pairs of symbols."""
    return spark.sql("""WITH RECURSIVE r(id, a, b) AS (VALUES (256, 97, 98), (257, 256, 99), (258, 257, 257)),
      e(sym, path) AS (SELECT 258, '' UNION ALL SELECT CASE WHEN k = 0 THEN a ELSE b END, concat(path, k)
        FROM e JOIN r ON id = sym CROSS JOIN (VALUES (0), (1)) s(k))
      SELECT sym, path FROM e WHERE sym < 256""")


def datetime(spark: S, sf_dir: str) -> D:
    e = _t(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), (F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts"))).alias("span_s"))


def json_props(spark: S, sf_dir: str) -> D:
    e = _t(spark, sf_dir, "events")
    keys = F.json_object_keys("props")
    return e.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def url_parts(spark: S, sf_dir: str) -> D:
    u = page_links(spark, sf_dir)
    return u.select("seq", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("QUERY")).alias("query"), F.try_parse_url("url", F.lit("REF")).alias("ref"), F.try_parse_url("url", F.lit("QUERY"), F.lit("utm_source")).alias("utm_source"))


def id_formats(spark: S, sf_dir: str) -> D:
    """Kinds of identifiers in links: long numbers, hexadecimal digests, other."""
    v = F.expr("CASE o_orderkey % 3 WHEN 0 THEN lpad(cast(o_orderkey * 104729 AS string), 18, '1') WHEN 1 THEN md5(cast(o_orderkey AS string)) ELSE concat('Page_', o_orderkey) END")
    kind = F.when(F.col("v").rlike(r"^[0-9]{15,20}$"), "snowflake").when(F.col("v").rlike("^[0-9a-f]{32}$"), "hex").otherwise("other")
    return _t(spark, sf_dir, "orders").select(v.alias("v")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def stream_tumbling(spark: S, sf_dir: str) -> D:
    return streams.tumbling(_t(spark, sf_dir, "events"))


def stream_sliding(spark: S, sf_dir: str) -> D:
    return streams.sliding(_t(spark, sf_dir, "events"))


def stream_session(spark: S, sf_dir: str) -> D:
    return streams.sessions(_t(spark, sf_dir, "events"))


def stream_dedup(spark: S, sf_dir: str) -> D:
    return streams.deduplicate(_t(spark, sf_dir, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type")


def near_links(spark: S, sf_dir: str) -> D:
    """Links by host with the share of characters that tokens save, in permille."""
    u = page_links(spark, sf_dir).select(F.regexp_extract("url", _HOST, 1).alias("host"), F.length("url").alias("n"), F.length(codec.tokenize(codec.normalize(F.col("url")))).alias("t"))
    return u.groupBy("host").agg(F.expr("(sum(n) - sum(t)) * 1000 div sum(n)").alias("permille"))


def queries() -> dict:
    names = (join_inner, join_merge, join_broadcast, join_theta, join_range, join_asof, join_full, join_semi, rollup, cube, grouping_sets, pivot, unpivot, count_distinct, window_rank, window_lag, window_range, topk, setops, subquery, recursive, datetime, json_props, url_parts, id_formats, stream_tumbling, stream_sliding, stream_session, stream_dedup, near_links)
    return {f"x_{f.__name__}": f for f in names}


def oracle_sql() -> dict[str, str]:
    cents = "round({} * 100)::BIGINT"
    pivoted = "SELECT ts::DATE AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1"
    host = f"regexp_extract(url, '{_HOST}', 1)"
    tokens = duck.tokenize(duck.normalize("url"))
    return {
        "x_join_inner": f"SELECT c_mktsegment, count(*) AS orders, sum({cents.format('o_totalprice')})::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        "x_join_merge": "SELECT o_orderpriority, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
        "x_join_broadcast": "SELECT r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
        "x_join_theta": "SELECT a.n_name, count(*) AS before FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name > b.n_name GROUP BY 1",
        "x_join_range": "SELECT floor(o_totalprice / 100000)::INTEGER AS band, count(*) AS orders FROM orders WHERE o_totalprice >= 0 AND o_totalprice < 500000 GROUP BY 1",
        "x_join_asof": "SELECT event_id, (SELECT max_by(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.event_type != 'purchase' AND (b.ts, b.event_id) < (a.ts, a.event_id)) AS before FROM events a WHERE event_type = 'purchase'",
        "x_join_full": "SELECT c_custkey AS k, (c_custkey % 3 = 0)::INTEGER AS a, (c_custkey % 5 = 0)::INTEGER AS b FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0",
        "x_join_semi": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN 'with' ELSE 'without' END AS kind FROM customer",
        "x_rollup": f"SELECT scheme, host, count(*) AS links, grouping_id(scheme, host) AS level FROM (SELECT split_part(url, '://', 1) AS scheme, {host} AS host FROM pages) GROUP BY ROLLUP (scheme, host)",
        "x_cube": "SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
        "x_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
        "x_pivot": pivoted,
        "x_unpivot": f"UNPIVOT ({pivoted}) ON click, view, purchase INTO NAME kind VALUE n",
        "x_count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
        "x_window_rank": "SELECT c_custkey, (row_number() OVER w)::INTEGER AS rn, (rank() OVER w)::INTEGER AS rk, (dense_rank() OVER w)::INTEGER AS dr, (ntile(4) OVER w)::INTEGER AS quartile FROM customer QUALIFY rn <= 5 WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)".replace(" QUALIFY rn <= 5 WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)", " WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) QUALIFY row_number() OVER w <= 5"),
        "x_window_lag": "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
        "x_window_range": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS recent FROM orders",
        "x_topk": f"SELECT o_orderkey, {cents.format('o_totalprice')} AS cents FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
        "x_setops": "WITH a AS (SELECT o_custkey % 100 AS k FROM orders), b AS (SELECT c_custkey % 70 AS k FROM customer) SELECT *, 'intersect' AS op FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT *, 'except' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT *, 'union' FROM (SELECT k FROM a UNION SELECT k FROM b)",
        "x_subquery": f"WITH o AS (SELECT *, {cents.format('o_totalprice')} AS cents FROM orders) SELECT o_orderstatus, count(*) AS n FROM o WHERE cents > (SELECT sum(cents) / count(*) FROM o p WHERE p.o_custkey = o.o_custkey) GROUP BY 1",
        "x_recursive": "SELECT * FROM (VALUES (97, '000'), (98, '001'), (99, '01'), (97, '100'), (98, '101'), (99, '11')) t(sym, path)",
        "x_datetime": "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT AS span_s FROM events GROUP BY 1",
        "x_json_props": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1",
        "x_url_parts": "SELECT page_id AS seq, regexp_extract(url, '://([^/?#]*)', 1) AS host, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)', 1), '') AS ref, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM pages",
        "x_id_formats": "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'snowflake' WHEN 1 THEN 'hex' ELSE 'other' END AS kind, count(*) AS n FROM orders GROUP BY 1",
        "x_stream_tumbling": f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum({cents.format('value')})::BIGINT AS cents FROM events GROUP BY 1, 2",
        "x_stream_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1",
        "x_stream_session": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
        "x_stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
        "x_near_links": f"SELECT host, ((sum(n) - sum(t)) * 1000 // sum(n))::BIGINT AS permille FROM (SELECT {host} AS host, length(url) AS n, length({tokens}) AS t FROM pages) GROUP BY 1",
    }
