"""Quality rules with risk-controlled thresholds.

Base rules are fixed; beyond them each text gets a few ratios, and a document is rejected where a ratio passes the
cutoff of its stratum. Cutoffs come from labelled documents: within a stratum and a ratio, candidates are tried from
the mildest to the strictest, and the last one is taken whose exact (Clopper-Pearson) upper bound on the share of
good documents rejected stays within the ratio's part of the allowed risk. This fixed sequence needs no correction
among the candidates of one ratio; the confidence is divided by the number of strata and ratios (Bonferroni), and the
risk by the number of ratios, so that with the stated confidence no stratum loses more than `risk` of its good texts.
The bound counts independent trials, so a text counts once, however many rows hold it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.llm.common import WORD_SPACE, map_batches, materialise

SYMBOLS = b"#*$%&|<>"
#: Ratios that a cutoff may act on, in whole bins of whole numbers.
RATIOS = ("symbols", "dup_lines", "upper", "word_length")
#: Upper ends of strata by number of words; the last is open.
STRATA = (100, 400)
BINS = 40
SCHEMA = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, hash long"


def repeated_words(words: list[bytes], window: int) -> int:
    """Words in windows that are found twice or more, the first one included: windows get numbers by joining the numbers
    of shorter ones, so equal numbers are equal words and memory is a few numbers a word."""
    if len(words) <= window or window < 1:
        return 0
    known: dict[bytes, int] = {}
    unit = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    grams, width = unit, 1
    while width < window:
        step = width if 2 * width <= window else 1
        tail = grams if step > 1 else unit
        n = len(words) - width - step + 1
        grams = np.unique(grams[:n] * (int(tail.max()) + 1) + tail[width : width + n], return_inverse=True)[1]
        width += step
    often = np.bincount(grams)[grams] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_counts(text: bytes | None, window: int = 5) -> tuple[int, ...]:
    """The numbers of SCHEMA after id. Null and empty texts, and texts of white space alone, give zeros but for lines.

    A word is a run of bytes other than blank and \\x09-\\x0D; a line has words or does not count.
    """
    text = text or b""
    words = text.split()
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(bytes([c])) for c in WORD_SPACE)
    lines = [x for x in text.split(b"\n") if x.strip(WORD_SPACE)]
    repeated = repeated_words(words, window)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper


def _count_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
    rows = [text_counts(x.as_py()) for x in texts]
    columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), batch.column(2)]
    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of counts for each document, whole texts; repeated rows stay repeated."""
    return map_batches(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("hash")), _count_batch, SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratio_bins() -> dict[str, Column]:
    """Each ratio in whole bins 0..BINS: the higher, the worse. Without words all are 0."""
    per = lambda a, b, scale: F.when(F.col(b) > 0, F.least(F.lit(BINS), F.floor(F.col(a) * scale / F.col(b)))).otherwise(F.lit(0)).cast("int")
    return {
        "symbols": per("n_symbols", "n_words", 20),
        "dup_lines": per("n_dup_lines", "n_lines", BINS),
        "upper": per("n_upper", "word_chars", BINS),
        "word_length": per("word_chars", "n_words", 1),
    }


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for i in reversed(range(len(STRATA))):
        out = F.when(F.col("n_words") < STRATA[i], F.lit(i)).otherwise(out)
    return out


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate p at which k or fewer of n still have probability delta or more."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def tail(p: float) -> float:
        each = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)]
        top = max(each)
        return math.exp(top) * sum(math.exp(x - top) for x in each)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if 0 < mid < 1 and tail(mid) >= delta:
            low = mid
        else:
            high = mid
    return high


def choose_cutoffs(counts: dict[tuple[int, str, int], tuple[int, int]], risk: float, delta: float) -> dict[tuple[int, str], int]:
    """Cutoffs by (stratum, ratio): a document is rejected if its bin is at or above it. counts: good, bad by bin.

    A ratio with no certified candidate, or one that rejects no labelled bad document, gets none.
    """
    strata = sorted({s for s, _, _ in counts})
    each_delta, each_risk = delta / max(1, len(strata) * len(RATIOS)), risk / len(RATIOS)
    out = {}
    for s in strata:
        for name in RATIOS:
            good = [counts.get((s, name, b), (0, 0))[0] for b in range(BINS + 1)]
            bad = [counts.get((s, name, b), (0, 0))[1] for b in range(BINS + 1)]
            n, best = sum(good), None
            for cut in range(BINS, 0, -1):
                k = sum(good[cut:])
                if k > each_risk * n or upper_bound(k, n, each_delta) > each_risk:
                    break
                if bad[cut]:
                    best = cut
            if best is not None:
                out[s, name] = best
    return out


def learn_cutoffs(measured: DataFrame, labels: DataFrame, risk: float, delta: float, id_column: str = "doc_id", label_column: str = "quality") -> dict[tuple[int, str], int]:
    """Counts over all labelled rows; what comes to the driver has one row for each stratum, ratio and bin.

    Rows without a label, or with a label other than 0 and 1, teach nothing. Equal texts are one trial; ids or texts
    that have both labels teach nothing either.
    """
    marks = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label")).where("label in (0, 1)")
    one = lambda df, key, *more: df.groupBy(key).agg(F.min("label").alias("label"), F.max("label").alias("other"), *more).where("label = other")
    bins = F.first(F.struct(stratum().alias("stratum"), F.array(*ratio_bins().values()).alias("bins"))).alias("own")
    joined = one(measured.where(~base_failed()).join(one(marks, "id").select("id", "label"), "id"), "hash", bins)
    joined = joined.select("label", F.col("own.stratum").alias("stratum"), F.posexplode("own.bins").alias("ratio", "bin"))
    rows = joined.groupBy("stratum", "ratio", "bin").agg(F.sum(F.col("label")).alias("good"), F.count("*").alias("n")).collect()
    return choose_cutoffs({(r["stratum"], RATIOS[r["ratio"]], r["bin"]): (int(r["good"]), r["n"] - int(r["good"])) for r in rows}, risk, delta)


def verdict(measured: DataFrame, cutoffs: dict[tuple[int, str], int]) -> DataFrame:
    """Adds base_failed, failed_rules (names of the ratios past their cutoff) and kept."""
    bins, where = ratio_bins(), stratum()
    failed = [F.when((where == s) & (bins[name] >= cut), F.lit(name)) for (s, name), cut in sorted(cutoffs.items())]
    rules = F.array_distinct(F.array_compact(F.array(*failed))) if failed else F.array().cast("array<string>")
    return measured.withColumns({"base_failed": base_failed(), "failed_rules": rules}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Counts, base rules and the verdict of each document: id, the counts, base_failed, failed_rules, kept.

    Null and empty texts have no words and fail the base rules; repeated rows stay repeated; texts of any length are
    counted whole; ties in a bin go together; an empty table gives no rows, and without labels only the base rules
    act. Columns other than id and text are not looked at.
    """
    measured = materialise(measure(docs), "counts")  # numbers only: texts are read once and never shuffled
    return verdict(measured, learn_cutoffs(measured, labels, risk, delta))
