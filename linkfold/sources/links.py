"""Link sources: delimited and line files with a found link column, and corpora made from tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.functions.fixed import KNOWN_SCHEMES, LINK_HEADERS

#: A corpus of links by key, written so that Spark and DuckDB read it alike: 12 kinds over `orders`.
ORDER_LINK = """CASE o_orderkey % 12
 WHEN 0 THEN concat('https://github.com/org', o_custkey % 50, '/repo', o_custkey % 200, '/pull/', o_orderkey)
 WHEN 1 THEN concat('https://www.amazon.com/dp/B', o_orderkey, '?ref=r', o_custkey, '&utm_source=news&utm_medium=email&utm_campaign=c', o_custkey % 7, '&utm_content=hero&gclid=E', o_orderkey * 7919)
 WHEN 2 THEN concat('https://x.com/user', o_custkey, '/status/', lpad(cast(o_orderkey * 104729 as string), 12, '0'))
 WHEN 3 THEN concat('https://api.github.com/repos/o', o_custkey, '/r', o_orderkey % 97, '/issues?state=open&sort=created&direction=desc')
 WHEN 4 THEN concat('magnet:?xt=urn:btih:', md5(cast(o_orderkey as string)), '&dn=file', o_orderkey)
 WHEN 5 THEN concat('mailto:team', o_custkey, '@example.org?subject=hello', o_orderkey)
 WHEN 6 THEN concat('bitcoin:1A', substr(md5(cast(o_custkey as string)), 1, 12), '?amount=0.', o_orderkey % 1000, '&label=L', o_custkey)
 WHEN 7 THEN concat('https://store.steampowered.com/app/', o_orderkey, '/game', o_custkey, '/?utm_source=steam&utm_medium=f&utm_campaign=w&fbclid=Iw', o_orderkey)
 WHEN 8 THEN concat('https://shop.s', o_custkey % 40, '.com/shop/products/item/', o_orderkey * 7919, '?session_id=', md5(cast(o_orderkey as string)), '&timestamp=', 1600000000 + o_orderkey)
 WHEN 9 THEN concat('https://en.wikipedia.org/wiki/Page_', o_orderkey, '~~~~~', o_custkey)
 WHEN 10 THEN concat('  HTTP://Example', o_custkey, '.org/a~b/', o_orderkey, ' ')
 ELSE concat('ipfs://bafybeic', md5(cast(o_orderkey as string)), 'aaaaaaaa')
END"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("seq"), "url")


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.expr(ORDER_LINK).alias("url"))


# Files --------------------------------------------------------------------------------------------------------------


def file_format(path: str) -> str:
    """csv, tsv, txt, or auto where the extension does not tell."""
    end = os.path.splitext(path)[1].lower().lstrip(".")
    return end if end in ("csv", "tsv") else "txt" if end in ("txt", "urls", "list") else "auto"


def delimiter(kind: str, sample: str) -> str:
    """The delimiter of a format; auto looks at the first line: a tab, else a comma, else none."""
    if kind in ("csv", "tsv", "txt"):
        return {"csv": ",", "tsv": "\t", "txt": "\n"}[kind]
    return "\t" if "\t" in sample else "," if "," in sample else "\n"


def delimiter_column(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("\t")), F.lit("tab")).when(F.contains(line, F.lit(",")), F.lit("comma")).otherwise(F.lit("newline"))


def split_row(line: str, sep: str) -> list[str]:
    """Fields of a line; a quote turns quoting on and off and does not stay."""
    out, field, quoted = [], [], False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == sep and not quoted:
            out.append("".join(field))
            field = []
        else:
            field.append(c)
    return [*out, "".join(field)]


def link_column(header: list[str], given: int | None = None) -> tuple[int, bool]:
    """The place of the link column and whether the line is a header. Names of first priority go before a given place,
    names of second priority count without one; else the last column, and the line is data."""
    names = [h.strip().strip('"').lower() for h in header]
    for i, n in enumerate(names):
        if n in LINK_HEADERS[0]:
            return i, True
    second = next((i for i, n in enumerate(names) if n in LINK_HEADERS[1]), None)
    if second is not None:
        return (second if given is None else given), True
    return (len(names) - 1 if given is None else given), False


def with_scheme(value: Column) -> Column:
    known = F.lit(False)
    for s in KNOWN_SCHEMES:
        known = known | F.startswith(value, F.lit(s))
    return F.when(known, value).otherwise(F.concat(F.lit("https://"), value))


def fields(line: Column, sep: str) -> Column:
    """Fields of a line outside quotes, quotes taken away."""
    outside = f'{sep}(?=(?:[^"]*"[^"]*")*[^"]*$)'
    return F.transform(F.split(line, outside), lambda x: F.replace(x, F.lit('"'), F.lit("")))


def read_links(spark: SparkSession, path: str, given: int | None = None, limit: int | None = None) -> DataFrame:
    """seq and url of a file, or of all files of a folder, whose header lines are alike. Only the first line comes to the
    driver; seq grows with the place in the file."""
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], "seq long, url string")
    sep = delimiter(file_format(path), first["value"])
    lines = lines.withColumn("seq", F.monotonically_increasing_id())
    if sep == "\n":
        url, header = F.regexp_replace(F.trim("value"), '^"+|"+$', ""), False
    else:
        at, header = link_column(split_row(first["value"], sep), given)
        parts = fields(F.col("value"), sep)
        value = F.trim(F.get(parts, at))
        url = F.when(value != "", with_scheme(value))
    out = lines.where(F.trim("value") != "").withColumn("url", url).where(F.coalesce(F.col("url") != "", F.lit(False)))
    if header:
        out = out.where(F.col("value") != first["value"])
    out = out.select("seq", "url")
    return out.orderBy("seq").limit(limit) if limit is not None else out


def third_field(line: Column) -> Column:
    """The link of a report line `id,domain,link`, whose link may hold commas."""
    value = F.get(F.split(line, ",", 3), 2)
    return F.regexp_replace(F.trim(value), '^"+|"+$', "")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank: codes to decode, or links to train on."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where(F.col("line") != "")
