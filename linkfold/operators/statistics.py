"""Training statistics: byte histograms, frequency tables, bigrams, sketches and their merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkfold.functions import codec
from linkfold.functions.fixed import GENERIC_COUNTS, GENERIC_HIGH, GENERIC_OTHER, SCALE


def byte_rows(links: DataFrame, key: str = "seq", text: str = "url") -> DataFrame:
    """key, pos (from 0) and sym of each byte of the tokenized links."""
    body = codec.tokenize(codec.normalize(F.col(text)))
    return links.select(key, F.posexplode(codec.characters(body)).alias("pos", "ch")).select(key, "pos", F.ascii("ch").alias("sym"))


def histogram(links: DataFrame) -> DataFrame:
    """Count of each of 256 bytes over the corpus, one more each. Counts are summed before the shuffle."""
    counts = byte_rows(links).groupBy("sym").agg(F.count("*").alias("n"))
    every = links.sparkSession.range(256).select(F.col("id").cast("int").alias("sym"))
    return every.join(counts, "sym", "left").select("sym", (F.coalesce("n", F.lit(0)) + 1).alias("count"))


def generic_counts(spark) -> DataFrame:
    """Counts of the generic profile: 256 rows."""
    out = F.when(F.col("sym") >= 128, F.lit(GENERIC_HIGH)).otherwise(F.lit(GENERIC_OTHER))
    for chars, n in GENERIC_COUNTS:
        out = F.when(F.col("sym").isin([ord(c) for c in chars]), F.lit(n)).otherwise(out)
    return spark.range(256).select(F.col("id").cast("int").alias("sym")).withColumn("count", out.cast("long"))


def frequency_table(counts: DataFrame, *by: str) -> DataFrame:
    """Frequencies of at least 1 that sum to SCALE, with the exclusive running sum; of 256 rows for each profile."""
    every = Window.partitionBy(*by)
    total = F.sum("count").over(every)
    freq = F.when(total == 0, F.lit(SCALE // 256)).otherwise(1 + F.floor(F.col("count") * (SCALE - 256) / total)).cast("long")
    base = counts.withColumn("freq", freq)
    base = base.withColumn("freq", F.col("freq") + F.when(F.col("sym") == 0, SCALE - F.sum("freq").over(every)).otherwise(0))
    running = Window.partitionBy(*by).orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return base.withColumn("cum", F.coalesce(F.sum("freq").over(running), F.lit(0)).cast("long")).select(*by, "sym", "freq", "cum")


def slots(table: DataFrame) -> DataFrame:
    """The symbol of each of SCALE slots."""
    return table.select(F.explode(F.sequence(F.col("cum"), F.col("cum") + F.col("freq") - 1)).alias("slot"), "sym")


def bigrams(links: DataFrame) -> DataFrame:
    """Counts of a byte and the one before it, 0 before the first, from arrays: no shuffle but that of the sums."""
    body = codec.tokenize(codec.normalize(F.col("url")))
    codes = F.transform(codec.characters(body), lambda c: F.ascii(c))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0)))).alias("prev"), codes.alias("cur"))
    rows = links.select(F.explode(pairs).alias("p")).select(F.col("p.prev").alias("prev"), F.col("p.cur").alias("cur")).where("cur IS NOT NULL")
    return rows.groupBy("prev", "cur").agg(F.count("*").alias("n"))


def context_probabilities(counts: DataFrame) -> DataFrame:
    """Probability of a symbol after a context with one count more for each of 256 symbols, in millionths."""
    total = F.sum("n").over(Window.partitionBy("prev")) + 256
    return counts.select("prev", "cur", F.floor((F.col("n") + 1) * 1000000 / total).cast("long").alias("ppm"))


def top_pair(links: DataFrame) -> DataFrame:
    """The most frequent adjacent pair of bytes, of equals the least, if it occurs twice."""
    counts = bigrams(links).where("prev != 0").where("n >= 2")
    return counts.orderBy(F.desc("n"), "prev", "cur").limit(1)


# Count-min sketches ---------------------------------------------------------------------------------------------------

ROWS, COLUMNS = 4, 256


def sketch_cells(item: Column, digest=lambda b: F.unhex(F.sha2(b, 256))) -> Column:
    """The column of each row of the sketch: the first 4 bytes of the digest of row and item, least byte first."""

    def cell(r: int) -> Column:
        h = F.hex(digest(F.concat(F.unhex(F.lit(f"{r:02X}")), F.encode(item, "UTF-8"))))
        value = F.conv(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("long")
        return F.struct(F.lit(r).alias("row"), (value % COLUMNS).cast("int").alias("col"))

    return F.array(*[cell(r) for r in range(ROWS)])


def sketch(items: DataFrame, item: str, *by: str) -> DataFrame:
    cells = items.select(*by, F.explode(sketch_cells(F.col(item))).alias("c"))
    return cells.groupBy(*by, F.col("c.row").alias("row"), F.col("c.col").alias("col")).agg(F.count("*").alias("n"))


def sketch_query(table: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """An upper bound of each item's count: the least of its cells; 0 where one is empty."""
    cells = items.select(item, F.explode(sketch_cells(F.col(item))).alias("c")).select(item, "c.row", "c.col")
    # ROWS * COLUMNS rows at most.
    return cells.join(F.broadcast(table), ["row", "col"], "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def merge_counters(*parts: DataFrame, key: list[str], value: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*key).agg(F.sum(value).cast("long").alias(value))


def privacy_noise(counts: DataFrame, epsilon: float) -> DataFrame:
    """Bounded noise that a count itself determines (no privacy guarantee); the result is at least 1."""
    scale = max(0, int(1 / max(epsilon, 0.01) + 0.5))
    n = F.lpad(F.hex(F.col("count")), 8, "0")
    little = F.concat(*[F.substring(n, i, 2) for i in (7, 5, 3, 1)])
    first = F.conv(F.substring(F.sha2(F.unhex(F.concat(codec.byte_hex(F.col("sym")), little)), 256), 1, 2), 16, 10).cast("long")
    return counts.select("sym", F.greatest(F.lit(1).cast("long"), F.col("count") + first % (2 * scale + 1) - scale).alias("count"))
