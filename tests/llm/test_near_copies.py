import random
import re

import pytest

import corpus_pipeline
from skyweave.llm import near_copies
from tests.oracle import SMALL


def shingled(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def grouped(items):
    """The smallest key of each key's group, by all pairs."""
    sets, root = {k: shingled(t) for k, t in items}, {k: k for k, _ in items}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and near(sets[a], sets[b]) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {k: top(k) for k in sets}


def planted(texts, seed=3):
    """The texts, and copies with one word, 1 %, 2 % and 3 % of the words replaced."""
    r, out = random.Random(seed), list(texts)
    for text in texts:
        for share in (0, 0.01, 0.02, 0.03):
            words = text.split()
            for i in r.sample(range(len(words)), max(1, int(share * len(words)))):
                words[i] = f"other{r.randint(0, 9**9)}"
            out.append(" ".join(words))
    return out


def test_planted_near_copies_go(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").orderBy("doc_id").limit(60).collect()]
    items = list(enumerate(planted([t for t in texts if t and 40 < len(t.split()) < 1000])))
    docs = spark.createDataFrame(items, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect())
    want = grouped(items)
    assert kept == sorted(set(want.values())) and len(kept) < len(items) / 2


def test_a_shard_of_several_groups(spark, monkeypatch):
    # all rows in one shard, whose first row is near none
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: [7] * near_copies.BANDS)
    one = [f"w{i}" for i in range(60)]
    two = [f"v{i}" for i in range(60)]
    texts = ["none of this", *(" ".join([*w[:k], "new", *w[k + 1 :]]) for w in (one, two) for k in (0, 1, 59, 58)), "", None, " \n "]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    roots, want = {r.node: r.root for r in near_copies.groups(rows).collect()}, grouped(list(enumerate(texts)))
    assert {k: roots.get(k, k) for k, _ in enumerate(texts)} == want and len(set(want.values())) == 4


@pytest.mark.parametrize("n", [600, 2400])
def test_equal_sets_are_searched_once(spark, monkeypatch, n):
    """However many rows have one set, by case, white space or repeated lines."""
    sent, linked = [], near_copies._linked
    monkeypatch.setattr(near_copies, "_linked", lambda dealt, *more: sent.append(dealt.count()) or linked(dealt, *more))
    line = " ".join(f"w{i}" for i in range(30))
    texts = [(line.upper() if k % 2 else line) + " " * (k % 5) if k % 3 else None for k in range(n)]
    texts += [" ".join([*line.split()[:-1], "new"]), "other words than those"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    roots = {r.node: r.root for r in near_copies.groups(rows).collect()}
    assert sum(sent) <= 4 * near_copies.BANDS
    assert {k: roots.get(k, k) for k in range(len(texts))} == {**{k: 0 if texts[k] is None else 1 for k in range(n)}, n: 1, n + 1: n + 1}


def test_no_rows(spark):
    assert near_copies.groups(spark.createDataFrame([], "row long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    copies = [" ".join([*words[:k], "new", *words[k + 1 :]]) for k in (0, 59)]
    others = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    text = " ".join(words)

    def kept(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()), key=repr)

    clean = [(None, others[0]), (None, others[1]), (3, others[2])]
    assert kept([(None, copies[0]), *clean, (1, text), (3, copies[1])]) == sorted([*clean, (1, text)], key=repr)
    assert kept([(None, text), (None, copies[0]), *clean, (None, copies[1])]) in [sorted([*clean, (None, t)], key=repr) for t in (text, *copies)]
    assert kept([(5, text), (5, copies[0]), (5, others[3]), (6, copies[1])]) in [sorted([(5, others[3]), (5, t)], key=repr) for t in (text, copies[0])]
