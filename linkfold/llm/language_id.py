"""Language ID by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A document is parsed against each automaton into phrases, each
the longest match with any part of that text. A letter unknown to it stands alone and counts as two phrases, as it
can't be pointed at and needs an escape before it. The number of phrases
times the logarithm of the text's length, by character, estimates the cross entropy, and the language with the lowest
wins. Texts are lower-cased, runs of other characters than letters become one blank.

Transitions of all automata lie in one hash table over states and letters, so an alphabet may have any size. Parsing goes
over segments of SEGMENT characters at once and for all languages, so memory is bounded for texts of any length. Segments
don't change the phrases: where the last phrase of a segment ends beyond it, the next segment is parsed again from
there, up to the first place where both parses begin a phrase, from which on they are the same.

Each language learns from a stretch of `train_chars` characters of labelled texts chosen by hash: a fixed bound.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.llm.common import filter_batches, map_batches, release_memory, slices, text_buffer
from linkfold.llm.quality_classifier import fold

TRAIN_CHARS = 40_000
#: All languages together; with many languages each gets less.
TOTAL_CHARS = 400_000
#: Texts drawn for each language at least, where there are so many.
TRAIN_TEXTS = 20
SEGMENT = 1024
#: Text whose segments advance together, and characters times languages of one round of parsing.
CALL_BYTES, ROUND = 4 << 20, 16 << 20
UNKNOWN = "und"
#: Least share of the best language for a text to be kept.
MIN_SCORE = 0.35
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normalise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (letters, and single blanks for all else), the offsets of the texts, and their numbers of letters."""
    low = [t.lower() if t else "" for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    off = np.r_[0, np.cumsum([len(t) for t in low])]
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters stays, as the blank
    firsts = off[:-1][off[:-1] < off[1:]]
    keep[firsts] = letter[firsts]
    kept = np.r_[0, np.cumsum(keep)]
    return codes[keep], kept[off], np.diff(np.r_[0, np.cumsum(letter)][off])


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of each state, of which 0 is the root."""
    steps: list[dict[int, int]] = [{}]
    links, lengths = [-1], [0]
    last = 0
    for c in text:
        new = len(steps)
        steps.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = links[p]
        if p >= 0:
            q = steps[p][c]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                clone = len(steps)
                steps.append(dict(steps[q]))
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = links[p]
                links[q] = links[new] = clone
        last = new
    return steps


class Transitions:
    """A map from key (state and symbol) to the next state, 0 where there is none, with open addressing. A slot holds
    both in one number."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = np.int64(max(1, int(values.max(initial=0)).bit_length()))
        self.log2 = max(4, math.ceil(math.log2(max(1, 3 * len(keys)))))
        self.mask = np.int64((1 << self.log2) - 1)
        held = np.full(1 << self.log2, -1, np.int64)
        at, rest, packed = self._slot(keys), np.arange(len(keys)), keys << self.shift | values
        while len(rest):
            free = rest[held[at[rest]] < 0]
            held[at[free]] = packed[free]  # of several for one slot, the last stays
            rest = rest[held[at[rest]] != packed[rest]]
            at[rest] = (at[rest] + 1) & self.mask
        self.held = held

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - self.log2)).view(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.held.take(at)
        differ = (found >> self.shift) != keys
        found &= (np.int64(1) << self.shift) - 1
        rest = differ.nonzero()[0]
        if len(rest):
            found[rest] = 0
            at, keys = at[rest], keys[rest]
            entry = self.held[at]
            while True:
                some = (entry >= 0).nonzero()[0]
                if not len(some):
                    break
                rest, at, keys = rest[some], (at[some] + 1) & self.mask, keys[some]
                entry = self.held[at]
                hit = (entry >> self.shift) == keys
                found[rest[hit]] = entry[hit] & ((np.int64(1) << self.shift) - 1)
                entry[hit] = -1
        return found


class Parser:
    """Automata of all languages over one alphabet. `texts`: the labelled text of each language."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.languages = sorted(texts)
        parts = [normalise([texts[k]])[0] for k in self.languages]
        self.alphabet = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)
        # Symbol 0 is any letter that no language knows.
        self.width = len(self.alphabet) + 1
        self.bits = np.array([math.log2(max(2, len(x))) for x in parts])
        #: Of each language, the state after one symbol.
        self.first = np.zeros((len(parts), self.width), np.int64)
        keys, values, base = [], [], 1
        for k, part in enumerate(parts):
            steps = suffix_automaton(self.symbols(part).tolist())
            for c, to in steps[0].items():
                self.first[k, c] = base + to
            count = np.fromiter(map(len, steps), np.int64, len(steps))
            state = np.repeat(base + np.arange(len(steps), dtype=np.int64), count)
            keys.append(state * self.width + np.fromiter((c for x in steps for c in x), np.int64, len(state)))
            values.append(np.fromiter((base + to for x in steps for to in x.values()), np.int64, len(state)))
            base += len(steps)
            del steps
        empty = np.empty(0, np.int64)
        self.next = Transitions(np.concatenate([empty, *keys]), np.concatenate([empty, *values]))
        release_memory()

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros(len(codes), np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1).astype(np.int32)
        return np.where(self.alphabet[at] == codes, at + 1, 0)

    def phrases(self, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Numbers of phrases by text and language, an unknown letter counting twice."""
        n, k = len(off) - 1, len(self.languages)
        out = np.zeros((n, k), np.int64)
        if not len(codes) or not k:
            return out
        symbols = self.symbols(codes)
        some = max(1, ROUND // len(codes))
        for a in range(0, k, some):
            out[:, a : a + some] = self._phrases(symbols, off, np.arange(a, min(a + some, k)))
        return out

    def _phrases(self, symbols: np.ndarray, off: np.ndarray, languages: np.ndarray) -> np.ndarray:
        n, length = len(off) - 1, len(symbols)
        pieces = -(-np.diff(off) // SEGMENT)
        owner = np.repeat(np.arange(n), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, stop = off[owner] + within * SEGMENT, off[owner + 1]
        end = np.minimum(begin + SEGMENT, stop)
        # Lanes: all segments of the first language, then of the next; their marks tell where phrases begin.
        lanes = np.arange(len(owner) * len(languages))
        segment, row = lanes % len(owner), lanes // len(owner)
        marks = np.zeros(length * len(languages), bool)
        entry = begin[segment].copy()
        leave = self._parse(lanes, entry, segment, row, symbols, end, stop, languages, marks, again=False)
        follows = np.flatnonzero(within[segment] > 0)
        while True:
            now = leave[follows - 1]
            moved = follows[entry[follows] != now]
            if not len(moved):
                break
            now = leave[moved - 1]
            # What lies before the place where the segment is entered belongs to the phrase that goes on there.
            old, new = entry[moved], np.minimum(now, end[segment[moved]])
            low, size = np.minimum(old, new), np.abs(new - old)
            at = np.arange(int(size.sum())) + np.repeat(row[moved] * length + low - np.r_[0, np.cumsum(size)[:-1]], size)
            marks[at] = False
            entry[moved] = now
            inside = moved[now < end[segment[moved]]]
            leave[moved] = np.where(now < end[segment[moved]], leave[moved], now)
            left = self._parse(inside, entry[inside], segment[inside], row[inside], symbols, end, stop, languages, marks)
            leave[inside] = np.where(left >= 0, left, leave[inside])
        out, some = np.zeros((n, len(languages)), np.int64), np.flatnonzero(pieces)
        for j, known in enumerate(self.first[languages]):
            count = marks[j * length : (j + 1) * length].view(np.int8) + (known == 0).astype(np.int8).take(symbols)
            out[some, j] = np.add.reduceat(count, off[some], dtype=np.int64)
        return out

    def _parse(self, lanes: np.ndarray, at: np.ndarray, segment: np.ndarray, row: np.ndarray, symbols: np.ndarray, end: np.ndarray, stop: np.ndarray, languages: np.ndarray, marks: np.ndarray, again: bool = True) -> np.ndarray:
        """Parses each lane from `at`, marking where phrases begin, until a phrase would begin beyond the segment: that
        place is returned; -1 where the parse, if `again`, met a mark that was there before, and so the parse behind it."""
        out = np.full(len(lanes), -1, np.int64)
        live, at, first = np.arange(len(lanes)), at.copy(), self.first[languages].ravel()
        end, stop, base, root = end[segment], stop[segment], row * len(symbols), row * self.width
        state = np.zeros(len(lanes), np.int64)  # 0: a phrase begins here
        while len(live):
            c = symbols.take(at)
            state = self.next[state * self.width + c]
            starts = (state == 0).nonzero()[0]
            state[starts] = first[root[starts] + c[starts]]
            place, over = base[starts] + at[starts], at[starts] >= end[starts]
            out[live[starts[over]]] = at[starts[over]]
            done = starts[over]
            if again:
                met = ~over & marks[place]
                done = starts[over | met]
                inside = at < end
                marks[(base + at)[inside]] = False
            marks[place[~over]] = True
            at += 1
            ended = at >= stop
            ended[done] = False
            if len(done) or ended.any():
                out[live[ended]] = at[ended]
                keep = ~ended
                keep[done] = False
                live, at, state, root, end, stop, base = (x[keep] for x in (live, at, state, root, end, stop, base))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the share of the best language when each has weight 2^-(4 * bits by
        character). `und` and 0 where no letter is, or nothing was learned. Ties go to the first name."""
        codes, off, letters = normalise(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        rate = self.phrases(codes, off) * self.bits / np.maximum(np.diff(off), 1)[:, None]
        best = rate.argmin(axis=1)
        weight = np.exp2(-4 * (rate - rate.min(axis=1, keepdims=True)))
        known = letters > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, 1 / weight.sum(axis=1), 0.0)


@functools.lru_cache(maxsize=1)
def _parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    """One for each Python worker."""
    return Parser(dict(texts))


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", folds: int = 4, held: int = 2, train_chars: int = TRAIN_CHARS, total_chars: int = TOTAL_CHARS) -> tuple[tuple[str, str], ...]:
    """Labelled text of each language: texts of any length in order of their hash, equal ones once, up to the bound. Of a
    text beyond the bound a stretch from a place chosen by its hash teaches; the last text is cut at the bound.

    Only rows with text and language whose fold is not `held` teach; without any, nothing is learned. What comes to the
    driver for a language is about three times its bound, plus TRAIN_TEXTS texts of at most that.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & (F.coalesce(fold(F.col("id"), folds), F.lit(-1)) != held))
    keyed = rows.select("lang", "text", F.xxhash64("text").alias("hash"), F.length("text").cast("long").alias("size"))
    # Distinct hashes are counted approximately; the share only sizes the draw, which is cut exactly below.
    counts = keyed.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n"), F.avg(F.least("size", F.lit(train_chars))).alias("size")).collect()
    if not counts:
        return ()
    each = max(1, min(train_chars, total_chars // len(counts)))
    share = {r["lang"]: max(3 * each / max(1.0, r["n"] * min(r["size"], each)), 1.3 * TRAIN_TEXTS / r["n"]) for r in counts}
    limit = F.create_map(*[F.lit(x) for lang, part in share.items() for x in (lang, min(2**63 - 1, -(2**63) + int(min(1.0, part) * 2**64)))])
    start = F.when(F.col("size") > each, F.pmod(F.col("hash"), F.col("size") - each + 1)).otherwise(0).cast("int")
    drawn = keyed.where(F.col("hash") <= limit[F.col("lang")]).select("lang", "hash", F.col("text").substr(start + 1, F.lit(each)).alias("text"))
    out: dict[str, str] = {}
    for r in sorted(drawn.groupBy("lang", "hash").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["lang"], r["hash"])):
        have = out.get(r["lang"], "")
        if len(have) < each:
            out[r["lang"]] = f"{have}\n{r['text']}"[: each + 1]
    return tuple(sorted(out.items()))


def identify(docs: DataFrame, texts: tuple[tuple[str, str], ...], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, lang_pred and score of each row of docs."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parser = _parser(texts)
        _, off = text_buffer(batch.column(1))
        for i, j in slices(off, CALL_BYTES):
            lang, score = parser.predict(batch.column(1)[i:j].to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return map_batches(source, run, "id long, lang_pred string, score double")


def keep_known(docs: DataFrame, texts: tuple[tuple[str, str], ...], languages: Sequence[str] | None = None, min_score: float = MIN_SCORE, text_column: str = "text") -> DataFrame:
    """Rows of docs whose text is predicted to be in one of `languages` (all that were learned, without them) with at least
    `min_score`, all columns kept. Null texts and texts without any letter go. Where nothing was learned, all rows stay."""
    if not texts:
        return docs

    def known(column: pa.Array) -> np.ndarray:
        parser, wanted = _parser(texts), None if languages is None else set(languages)
        _, off = text_buffer(column)
        keep = [np.zeros(0, bool)]
        for i, j in slices(off, CALL_BYTES):
            found, score = parser.predict(column[i:j].to_pylist())
            keep.append(np.array([x != UNKNOWN and (wanted is None or x in wanted) for x in found], bool) & (score >= min_score))
        return np.concatenate(keep)

    return filter_batches(docs, text_column, known)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs."""
    found = identify(docs, learn(docs))
    return found.select(F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
