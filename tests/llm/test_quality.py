import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from linkfold.llm import quality_classifier as qc
from linkfold.llm import quality_rules as qr
from linkfold.llm.common import text_buffer

ODD = [None, "", " \n\t", "x", "# $ %", "a b c d e a b c d e", "one\n\none\n one\none", "A B\x0bC\x0cD\x85E é f", "w " * 300, "line!!\n" * 12]


def plain(text):
    """The base numbers, written down afresh from their definitions."""
    text = text or ""
    runs, run = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if run:
                runs.append(run)
            run = ""
        else:
            run += c
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    grams = [tuple(runs[i : i + 5]) for i in range(len(runs) - 4)]
    often = Counter(grams)
    in_repeat = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    return len(runs), sum(map(len, runs)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(in_repeat)


@pytest.mark.parametrize("text", ODD)
def test_counts(text):
    assert qr.text_counts(text.encode() if text is not None else None)[:5] == plain(text)


def test_counts_of_random_texts_and_a_long_one():
    r = random.Random(7)
    for _ in range(200):
        text = "".join(r.choice(["a ", "b ", "a b ", "c\n"]) for _ in range(r.randint(0, 40)))
        assert qr.text_counts(text.encode())[:5] == plain(text)
    long = " ".join(f"w{i % 30_011}" for i in range(400_000))
    assert qr.text_counts(long.encode())[4] == 400_000 and qr.text_counts(b"x" * 3_000_000)[0] == 1


def test_equal_texts_are_one_trial_and_both_labels_none(spark):
    text = lambda i: " ".join(f"v{i}x{j}" for j in range(20))
    rows = [(i, text(0)) for i in range(30)] + [(100 + i, text(1 + i)) for i in range(5)] + [(200, text(50)), (201, text(50))]
    labels = [(i, 1) for i in range(30)] + [(100 + i, 1) for i in range(5)] + [(100, 0), (200, 0), (201, 1), (101, 1)]
    seen = {}
    real = qr.choose_cutoffs
    try:
        qr.choose_cutoffs = lambda counts, risk, delta: seen.update(counts) or real(counts, risk, delta)
        qr.learn_cutoffs(qr.measure(spark.createDataFrame(rows, "doc_id long, text string")), spark.createDataFrame(labels, "doc_id long, quality int"), 0.05, 0.05)
    finally:
        qr.choose_cutoffs = real
    assert {sum(g + b for (_, name, _), (g, b) in seen.items() if name == ratio) for ratio in qr.RATIOS} == {5}


def test_exact_bound():
    for k, n, delta in [(0, 100, 0.05), (3, 50, 0.01), (20, 400, 0.001)]:
        p = qr.upper_bound(k, n, delta)
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(delta, rel=1e-6)
    assert qr.upper_bound(0, 0, 0.1) == 1 and qr.upper_bound(5, 5, 0.1) == 1


def test_cutoffs_hold_the_risk():
    counts = {(0, "symbols", b): (1000 if b == 0 else 1 if b < 5 else 0, 0 if b < 5 else 10) for b in range(qr.BINS + 1)}
    cut = qr.choose_cutoffs(counts, 0.06, 0.05)
    assert cut[0, "symbols"] >= 2
    lost = sum(g for (_, n, b), (g, _) in counts.items() if b >= cut[0, "symbols"])
    assert lost <= 0.01 * 1004
    assert qr.choose_cutoffs({(0, "symbols", 30): (3, 50)}, 0.06, 0.05) == {}
    assert qr.choose_cutoffs({}, 0.06, 0.05) == {}


def rows_and_labels(n=400):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, " ".join(word() + ("###" if bad else "") for _ in range(40)), f"s{i}"))
        labels.append((i, 0 if bad else 1, 0))
    return rows + [(n, None, None), (n + 1, "", None), (None, "x", "y"), (3, rows[3][1], "again")], labels + [(5, None, 0), (None, 1, 0)]


def test_rules_as_a_query(spark):
    rows, labels = rows_and_labels()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, n_words string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = qr.quality_rules(docs, marks, risk=0.3).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(t for i, t, _ in rows if i == r["id"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(text)
        assert not (r["kept"] and r["base_failed"])
        if r["id"] is not None and r["id"] < 400:
            assert r["kept"] == (r["id"] % 4 != 0)
    assert qr.quality_rules(docs.limit(0), marks).count() == 0


def test_classifier_on_rows_it_has_not_seen(spark):
    rows, labels = rows_and_labels()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = qc.classify(docs, marks).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] < 400:
            assert r["predicted"] == (r["doc_id"] % 4 != 0)
    assert qc.classify(docs.limit(0), marks).count() == 0
    kept = qc.keep_good(docs, qc.learn(docs, marks))
    assert kept.columns == docs.columns and 250 < kept.count() < 320
    one = qc.classify(docs, marks.where("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in one)


def test_margins_are_sums_over_distinct_features():
    texts = [t for t in ODD if t] + ["short", "two words"]
    raw, off = text_buffer(pa.array([*texts, None]))
    w = np.random.default_rng(0).normal(size=1 << qc.BITS).astype(np.float32)
    model = qc.Model(w, 0.5, 1.0, 0.0)
    expected = [float(w[s].sum(dtype=np.float64)) + 0.5 for s in qc.feature_sets(raw, off)]
    assert np.allclose(model.margins(raw, off), expected)
    alone = [qc.feature_sets(*text_buffer(pa.array([t])))[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(alone, qc.feature_sets(raw, off), strict=False))


def small_problem(seed=3, n=40, width=30):
    r = np.random.default_rng(seed)
    labels = (r.random(n) < 0.6).astype(np.int64)
    sets = [np.flatnonzero(r.random(width) < np.where(np.arange(width) < 10, 0.15 + 0.3 * y, 0.2)).astype(np.int32) for y in labels]
    return sets, labels


def test_log_ratios_by_their_definition(monkeypatch):
    monkeypatch.setattr(qc, "BITS", 5)
    sets, labels = small_problem()
    counts = {y: [1 + sum(f in set(s.tolist()) for s, l in zip(sets, labels, strict=True) if l == y) for f in range(32)] for y in (0, 1)}
    want = [math.log(counts[1][f] / sum(counts[1])) - math.log(counts[0][f] / sum(counts[0])) for f in range(32)]
    assert np.allclose(qc.log_ratios(sets, labels), want, atol=1e-6)


def test_dual_coordinate_descent_reaches_the_optimum():
    sets, labels = small_problem()
    values = np.linspace(-1.5, 1.5, 32)
    cost = np.where(labels > 0, 0.4, 0.7)
    w, bias = qc.dual_coordinate_descent(sets, values, labels, cost, epochs=3000, tolerance=1e-9)
    x = np.zeros((len(sets), 33))
    for i, s in enumerate(sets):
        x[i, s] = values[s]
    x[:, 32] = 1  # the bias is one more weight
    sign = np.where(labels > 0, 1.0, -1.0)
    # The same dual by projected gradient, from nothing but its definition.
    gram = (sign[:, None] * x) @ (sign[:, None] * x).T
    alpha, step = np.zeros(len(sets)), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    assert np.allclose(np.r_[w, bias], (alpha * sign) @ x, atol=1e-3)
    assert loss(np.r_[w, bias]) == pytest.approx(alpha.sum() - 0.5 * alpha @ gram @ alpha, rel=1e-4)


def test_scores_of_odd_rows_ties_and_clashing_names(spark):
    rows, labels = rows_and_labels(200)
    long = " ".join(f"w{i % 900}" for i in range(200_000))
    docs = [(i, t, "a", 0.5) for i, t, _ in rows] + [(900, long, "b", 0.1), (901, long, "c", 0.2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, label string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = qc.classify(frame, marks).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= qc.THRESHOLD) for r in out)
    score = {r["doc_id"]: r["score"] for r in out}
    assert score[900] == score[901] and score[200] == score[201]  # equal texts, and null like empty
    kept = qc.keep_good(frame, qc.learn(frame, marks))
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in out if r["score"] >= qc.THRESHOLD)
    assert qc.classify(frame.limit(0), marks).count() == 0
