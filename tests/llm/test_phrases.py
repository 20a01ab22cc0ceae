import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyweave.llm import phrases
from skyweave.llm.perfect_hash import PerfectHash

from .cases import LONG, documents, got


@settings(deadline=None, max_examples=60)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_perfect_hash_numbers_its_keys_and_no_others(keys, others):
    h = PerfectHash(np.array(sorted(keys), np.uint64))
    slots = h.find(np.array(sorted(keys), np.uint64))
    assert sorted(slots.tolist()) == list(range(len(keys)))
    strange = np.array([k for k in others if k not in keys], np.uint64)
    assert (h.find(strange) == -1).all()


def test_perfect_hash_of_many_keys_is_small():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 200_000, np.uint64))
    h = PerfectHash(keys)
    assert len(np.unique(h.find(keys))) == len(keys) and h._bits.nbytes * 8 < 5 * len(keys)


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(phrases.xxhash, "xxh64_intdigest", lambda w, seed=0: len(w) + (0 if seed < 2 else sum(w) * 1000))
    block = phrases.Words([b"ab x", b"cd x", b"efg x"], 5)
    assert sorted(block.find([b"ab x", b"cd x", b"efg x"]).tolist()) == [5, 6, 7]
    assert block.find([b"zz x", b"ba x"]).tolist() == [-1, -1]


def brute(docs, s):
    """Plain counts of strings; docs are (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, s.words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= s.least}
    longer = Counter()
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(longer[lang, p[i : i + m]], a)
    out = []
    for lang in {k[0] for k in cand}:
        rows = []
        for (own, p), a in cand.items():
            if own == lang and not 100 * longer[own, p] >= s.contained * a:
                score, _, l, r = min((10**6 * a * a // (f[own, p[:k]] * f[own, p[k:]]), k, f[own, p[:k]], f[own, p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -sc) for i, (sc, a, p, l, r) in enumerate(sorted(rows)[: s.top], 1)]
    return sorted(out)


def texts(seed, rows, vocabulary=12):
    rng = np.random.default_rng(seed)
    signs = ["", "", "", "", ".", ",", "!", "\n", "\x0b", "  ", "\t"]
    words = [*(f"W{i}" for i in range(vocabulary)), "é", "東", "#", "\x1c"]
    out = []
    for i in range(rows):
        text = " ".join(words[int(rng.zipf(1.5)) % len(words)] + signs[rng.integers(len(signs))] for _ in range(rng.integers(0, 60)))
        out.append((text if rng.random() > 0.05 else None, ["en", "de", None, "und"][rng.integers(4)]))
    return out


@pytest.mark.parametrize("s", [phrases.Settings(), phrases.Settings(words=5, least=4, top=30, contained=60), phrases.Settings(block=16, buffer=50, least=3), phrases.Settings(words=2, contained=30)])
def test_against_plain_counts(spark, s):
    docs = texts(3, 250)
    df = spark.createDataFrame([(t, lang, "x", 1) for t, lang in docs], "text string, lang string, word string, slot int").repartition(5)
    out = phrases.collocations(df, s)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got(out) == sorted(brute(docs, s), key=repr)


def test_long_texts_are_not_cut(spark, monkeypatch):
    docs = [(LONG, "en"), (LONG.replace("fox", "ox."), None), (None, "en"), ("", "fr")]
    df = spark.createDataFrame(docs, "text string, lang string")
    assert got(phrases.collocations(df)) == sorted(brute(docs, phrases.Settings()), key=repr)


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="aB .,\t\né", max_size=200))
def test_words_do_not_depend_on_where_texts_are_read(text):
    whole = [w for ws in phrases.word_lists(text.encode()) for w in ws]
    before, phrases._CHUNK = phrases._CHUNK, 3
    try:
        assert [w for ws in phrases.word_lists(text.encode()) for w in ws] == whole
    finally:
        phrases._CHUNK = before


def test_edge_rows_and_no_rows(spark):
    from pyspark.sql import functions as F

    df = documents(spark).withColumn("lang", F.lit("en"))
    assert phrases.collocations(df).count() > 0
    assert phrases.collocations(documents(spark, []).withColumn("lang", F.lit("en"))).count() == 0
    assert phrases.collocations(spark.createDataFrame([("a b", None)], "text string, lang string")).count() == 0


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(3 * 10**12 + 1, 10**13 + 7, 9 * 10**12 + 5)], "a long, l long, r long")
    a, l, r = df.first()
    assert df.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * a * a // (l * r)
