import random
import zlib

import numpy as np
import pytest

from linkfold.llm import language_id as li


def longest_match_phrases(text, corpus):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in corpus:
            k += 1
        n += 1 if k > 1 else 2
        i += max(k - 1, 1)
    return n


@pytest.mark.parametrize("segment", [1024, 16, 5, 1])
@pytest.mark.parametrize("seed", range(5))
def test_phrases_are_longest_matches(seed, segment, monkeypatch):
    monkeypatch.setattr(li, "SEGMENT", segment)
    r = random.Random(seed)
    corpus = {lang: "".join(r.choices("abc ", weights, k=300)).strip() for lang, weights in {"x": (5, 2, 1, 2), "y": (1, 2, 5, 2)}.items()}
    parser = li.Parser(corpus)
    texts = ["".join(r.choices("abcz ", k=r.randint(0, 90))) for _ in range(12)] + [corpus["x"][20:200], corpus["y"] * 2, "zzz", "azaz"]
    codes, off, _ = li.normalise(texts)
    counts = parser.phrases(codes, off)
    for j, lang in enumerate(parser.languages):
        known = "".join(map(chr, li.normalise([corpus[lang]])[0]))
        for i in range(len(texts)):
            assert counts[i, j] == longest_match_phrases("".join(map(chr, codes[off[i] : off[i + 1]])), known)


def test_every_letter_of_large_alphabets_counts():
    r = random.Random(3)
    scripts = {"a": [chr(0x4E00 + i) for i in range(300)], "b": [chr(0x5E00 + i) for i in range(300)]}
    parser = li.Parser({k: "".join(r.choices(v, k=3000)) for k, v in scripts.items()})
    texts = [("ab"[i % 2], "".join(r.choices(scripts["ab"[i % 2]], k=r.randint(1, 30)))) for i in range(300)]
    assert parser.predict([t for _, t in texts])[0] == [k for k, _ in texts]


def test_languages_of_long_texts_alone_are_learned(spark):
    r = random.Random(2)
    word = {"de": ["der", "hund", "geht", "nach", "hause"], "en": ["the", "dog", "walks", "home", "again"]}
    rows = [(i, " ".join(r.choices(word["de"], k=12_000)), "de") for i in range(12)] + [(100 + i, " ".join(r.choices(word["en"], k=20)), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = dict(li.learn(docs, train_chars=5000))
    assert set(learned) == {"de", "en"} and all(len(x) <= 5001 for x in learned.values()) and len(learned["de"]) > 4000
    assert {(x["lang_pred"], r[2]) for x, r in zip(sorted(li.language_id(docs).collect(), key=lambda x: x["doc_id"]), rows, strict=True)} == {("de", "de"), ("en", "en")}


def test_ties_go_to_the_first_name():
    parser = li.Parser({"q": "same text", "p": "same text"})
    lang, score = parser.predict(["same", "text same"])
    assert lang == ["p", "p"] and list(score) == [0.5, 0.5]


def test_the_filter_rejects_by_language_and_score(spark):
    texts = (("a", "the cat sat on the mat and the dog lay by the door " * 8), ("b", "le chat est sur la table et le chien dort dehors " * 8))
    rows = [(1, "the dog sat by the cat", "u"), (2, "le chien est sur la table", "v"), (3, "xq zv kj wq", "w"), (4, None, "n"), (5, "", "e"), (6, "12 !", "d"), (None, "the mat", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    assert ids(li.keep_known(docs, texts, min_score=0.9)) == ["1", "2", "None"]
    assert ids(li.keep_known(docs, texts, ["b"], min_score=0.9)) == ["2"]
    assert li.keep_known(docs, texts).columns == docs.columns
    assert ids(li.keep_known(docs, ())) == ids(docs)
    assert ids(li.keep_known(docs.limit(0), texts)) == []


def test_long_texts_and_segments(monkeypatch):
    parser = li.Parser({"a": "the cat sat on the mat and the dog " * 30, "b": "le chat est sur la table et le chien " * 30})
    lang, score = parser.predict(["the dog " * 20_000, "le chien " * 3, "", None, "123 !", "ß"])
    assert lang[:5] == ["a", "b", "und", "und", "und"] and score[2] == 0 and (score >= 0).all() and (score <= 1).all()


def test_query(spark):
    r = random.Random(1)
    words = {"aa": ["foo", "bar", "bazo", "qua"], "bb": ["lim", "tel", "mip", "est"]}
    rows = [(i, " ".join(r.choices(words[lang], k=30)), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    rows += [(200, None, "aa"), (201, "", None), (202, "99", "bb"), (None, "foo bar", "aa"), (3, rows[3][1], "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = li.language_id(docs).collect()
    assert len(out) == len(rows)
    for x in out:
        if x["doc_id"] is not None and x["doc_id"] < 200:
            assert x["lang_pred"] == ("aa", "bb")[x["doc_id"] % 2]
            assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
        if x["doc_id"] in (200, 201, 202):
            assert x["lang_pred"] == "und"
    assert li.language_id(docs.limit(0)).count() == 0
    score = {x["doc_id"]: x["score"] for x in out}
    assert sorted(str(x["doc_id"]) for x in li.keep_known(docs, li.learn(docs)).collect()) == sorted(str(i) for i, t, _ in rows if t not in (None, "", "99") and score[i] >= li.MIN_SCORE)
    assert np.array_equal(li.learn(docs), li.learn(docs.repartition(5)))
