"""URL rules as a sort-merge range join, with DataFrame operations only.

A host is written with its labels reversed and a dot after each (`example.net` -> `net.example.`), so a host and all
its subdomains are one interval of keys, and the intervals of different rules are nested or apart. Sweeping over the
sorted keys, a stack holds the rules whose interval is open; each interval end becomes a boundary row that carries the
stack from there on. Boundaries and urls are range-partitioned and sorted together, and each url takes the stack of
the last boundary before it: the one within its partition, or else the one carried over from earlier partitions.
Equal keys are spread by a salt, so one host may hold any share of the urls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkfold.llm.common import materialise

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"

_STACK = "array<struct<size:int,rule:string,path:string,verdict:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def boundaries(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, list[tuple]]]:
    """The sweep over the rules' own intervals: keys where the stack changes, with the rules open from there on."""
    hosts: dict[str, list[tuple]] = {}
    for verdict, host, path in rules:
        key = "".join(f"{x}." for x in reversed(host.split(".")))
        hosts.setdefault(key, []).append((len(host) + len(path), host + path, path, verdict))
    # '/' follows '.' in code order, so key[:-1] + '/' is the first key beyond all subdomains.
    events = sorted([(k, 1, k) for k in hosts] + [(k[:-1] + "/", 0, k) for k in hosts], key=lambda e: (e[0], e[1], e[2] if e[1] else "￿"))
    stack: list[str] = []
    out: dict[str, list[tuple]] = {"": []}
    for at, opens, key in events:
        if opens:
            stack.append(key)
        else:
            stack.remove(key)
        out[at] = [r for k in stack for r in sorted(hosts[k])]
    return sorted(out.items())


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict for each row.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins (host and path
    together), of equals the last by name. The rules are a parameter held by the driver and must be distinct; without rules every
    url gets the default. Repeated rows stay repeated; an empty table gives no rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url")).select("id", host.alias("host"), path.alias("path"), F.xxhash64("id", "url").alias("salt"))
    urls = urls.select("id", "host", "path", host_key(F.col("host")).alias("key"), (F.shiftrightunsigned("salt", 32) + 1).alias("salt"), F.lit(None).cast(_STACK).alias("stack"))
    marks = spark.createDataFrame([(k, [list(r) for r in rows]) for k, rows in boundaries(rules)], f"key string, stack {_STACK}")
    marks = marks.select(F.lit(None).cast(urls.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", F.lit(0).cast("long").alias("salt"), "stack")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: both uses below must see the same ranges, also after a lost executor.
    ranged = materialise(urls.unionByName(marks).repartitionByRange(parts, "key", "salt").withColumn("range", F.spark_partition_id()), "url-ranges")
    # One row for each range: the stack at its end, and by that the stack at the start of the next.
    ends = ranged.groupBy("range").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("key"))).alias("end"))
    carried = ends.select("range", F.last("end", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("range").orderBy("key", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where(F.col("stack").isNull())
    open_rules = F.coalesce("open", "carried")
    # One row for each range: at most as many as there are shuffle partitions.
    best = F.array_max(F.filter(open_rules, lambda r: F.startswith(F.col("path"), r["path"])))
    out = swept.join(F.broadcast(carried), "range").withColumn("best", best)
    return out.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> str:
    """DuckDB SQL for judge_urls over `pages`."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, host, path) AS (VALUES {values}),
best AS (
  SELECT p.page_id, p.host, p.path, max_by(r.host || r.path, (length(r.host || r.path), r.host || r.path)) AS rule,
         max_by(r.verdict, (length(r.host || r.path), r.host || r.path)) AS verdict
  FROM (SELECT *, row_number() OVER () AS rn FROM parts) p
  LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.rn, p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM best"""
