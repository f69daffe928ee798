"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its share of all tokens raised to an exponent and normalised: at 1 the corpus as it is, at 0 all
sources alike. The exponent is bisected to the largest that reaches a target entropy, and raised again where a source would
otherwise repeat more often than allowed. A budget of tokens then gives each source a number of epochs, whole and
part. Documents lie in hash blocks; each epoch takes the blocks of a source in an order of its own, and the last,
partial epoch ends in the block, and at the document, where the source's budget ends.

Sums are by source and block, so no task holds a source; the number of blocks follows the number of rows, so that no
block is large. The driver holds one row for each source, as the exponent needs all shares at once; tables of sources
are broadcast up to BROADCAST_SOURCES rows and joined otherwise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkfold.llm.common import free_name, materialise

#: Blocks of a source, at least, and rows of a block on average, at most.
BLOCKS, BLOCK_ROWS = 1024, 20_000
BROADCAST_SOURCES = 100_000
#: Target entropy as a share of the logarithm of the number of sources.
ENTROPY = 0.9
#: Most epochs of a source.
REPEATS = 1.5


@dataclass(frozen=True)
class Share:
    source: str
    tokens: int
    weight: float
    budget: int  # tokens


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    total = sum(tokens.values())
    logs = {s: exponent * math.log(n / total) for s, n in tokens.items() if n > 0}
    top = max(logs.values())
    raw = {s: math.exp(x - top) for s, x in logs.items()}
    scale = math.fsum(raw.values())
    return {s: x / scale for s, x in raw.items()}


def entropy(w: dict[str, float]) -> float:
    return -math.fsum(x * math.log(x) for x in w.values() if x > 0)


def largest_exponent(fits, steps: int = 60) -> float:
    """The largest exponent in [0, 1] that fits, of a condition that holds for all smaller ones too; 0 if none does."""
    if fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def repeats(tokens: dict[str, int], w: dict[str, float], budget: float | None) -> dict[str, float]:
    """Epochs of each source. Without a budget the least repeated source gets one."""
    each = {s: x / tokens[s] for s, x in w.items()}
    scale = budget if budget is not None else 1 / min(each.values())
    return {s: x * scale for s, x in each.items()}


def plan(tokens: dict[str, int], target_entropy: float = ENTROPY, max_repeats: float = REPEATS, budget: float | None = None) -> list[Share]:
    """Weights and budgets; sources without tokens get no weight. The limit on repeats goes before the entropy; a
    budget that no mixture can fill within the limit is cut to max_repeats * all tokens."""
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return []
    if budget is not None:
        budget = min(budget, max_repeats * sum(tokens.values()))
    goal = target_entropy * math.log(len(tokens))
    flat = largest_exponent(lambda a: entropy(weights(tokens, a)) >= goal - 1e-12)
    over = lambda a: max(repeats(tokens, weights(tokens, a), budget).values()) > max_repeats * (1 + 1e-9)
    if over(flat):
        low, high = flat, 1.0  # the limit holds at 1
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if over(mid) else (low, mid)
        flat = high
    w = weights(tokens, flat)
    r = repeats(tokens, w, budget)
    return [Share(s, tokens[s], w[s], round(r[s] * tokens[s])) for s in sorted(tokens)]


def words(text: Column) -> Column:
    """Tokens of a text for the shares: its words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def block_of(place: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), place), F.lit(blocks)).cast("long")


def turn(source: Column, block: Column, epoch: Column, blocks: int) -> Column:
    """The place of a block in its source's order of an epoch; the block itself tells apart equal hashes."""
    spare = blocks.bit_length()
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(source, block, epoch), spare + 1), spare).bitwiseOR(block)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A table of sources, broadcast behind a check of its size."""
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", target_entropy: float = ENTROPY, max_repeats: float = REPEATS, budget: float | None = None) -> DataFrame:
    """docs, each row as often as the mixture takes it, with one more column, a struct of epoch, turn and place: the order
    of training within a source. It is called `mixed`, with underscores after it where docs has that name; all columns
    of docs stay as they are, whatever their names.

    Null sources count as the source "". Rows without words have no tokens: they go where their place falls, at no
    cost; a source without any token keeps its rows once. Equal rows share a place and go together, so a budget may
    be missed by one place. An empty table gives no rows. Texts of any length are counted whole.
    """
    spark = docs.sparkSession
    blocks = max(BLOCKS, 1 << max(0, docs.count() // BLOCK_ROWS).bit_length())
    own, cut_name, out_name = free_name("own", docs.columns), free_name("cut", docs.columns), free_name("mixed", docs.columns)
    source, place = F.coalesce(docs[source_column].cast("string"), F.lit("")), F.xxhash64(docs[id_column], docs[text_column])
    named = docs.withColumn(own, F.struct(source.alias("source"), place.alias("place"), block_of(place, blocks).alias("block")))
    field = lambda name: F.col(f"{own}.{name}")
    counted = named.select(field("source").alias("source"), field("block").alias("block"), field("place").alias("place"), F.col(text_column).alias("text"))
    sums = materialise(counted.groupBy("source", "block").agg(F.sum(words(F.col("text"))).alias("tokens")), "blocks")
    totals = {r["source"]: int(r["n"]) for r in sums.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    shares = plan(totals, target_entropy, max_repeats, budget)
    rows = [(s.source, s.budget // s.tokens, s.budget % s.tokens) for s in shares] + [(s, 1, 0) for s, n in totals.items() if not n]
    whole = spark.createDataFrame(rows, "source string, full long, rest long")
    turned = sums.join(_small(whole, len(rows)), "source").withColumn("turn", turn(F.col("source"), F.col("block"), F.col("full"), blocks))
    # One row for each block of a source.
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("turn")) - F.col("tokens")
    last = turned.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))
    # The first such block: where tokens are 0 there may be none after it.
    last = last.groupBy("source").agg(F.min_by("block", "turn").alias("block"), F.min("turn").alias("last"), F.min_by(F.col("rest") - F.col("before"), "turn").alias("left"))
    # Of the block where the budget ends, places in order until it is reached: one block of each source.
    inside = counted.join(_small(last, len(rows)), ["source", "block"])
    inside = inside.groupBy("source", "place", "left").agg(F.sum(words(F.col("text"))).alias("tokens"))
    reached = F.sum("tokens").over(Window.partitionBy("source").orderBy("place"))
    ends = inside.withColumn("reached", reached).where(F.col("reached") >= F.col("left")).groupBy("source").agg(F.min("place").alias("end"))
    cut = whole.join(last.select("source", "last"), "source", "left").join(ends, "source", "left")
    cut = materialise(cut.select(F.struct("source", "full", "last", "end").alias(cut_name)), "cuts")
    found = named.join(_small(cut, len(rows)), field("source") == F.col(f"{cut_name}.source"))
    at = lambda epoch: turn(field("source"), field("block"), epoch, blocks)
    limit = lambda name: F.col(f"{cut_name}.{name}")
    part = F.coalesce((at(limit("full")) < limit("last")) | ((at(limit("full")) == limit("last")) & (field("place") <= limit("end"))), F.lit(False))
    epochs = limit("full") + part.cast("int")
    epoch = free_name("epoch", found.columns)
    out = found.where(epochs > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)))
    return out.select(*docs.columns, F.struct(F.col(epoch).alias("epoch"), at(F.col(epoch)).alias("turn"), field("place").alias("place")).alias(out_name))


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row for each place a document takes: doc_id, source, epoch, block order, place, and its tokens."""
    rows = docs.select("doc_id", "text", "source")
    return mix(rows).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("mixed.epoch").alias("epoch"), F.col("mixed.turn").alias("turn"), F.col("mixed.place").alias("place"), words(F.col("text")).alias("n_tokens"))
