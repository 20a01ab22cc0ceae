import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skyweave.llm import decontam, queries
from tests.oracle import SMALL

from .cases import DOCS, documents, got

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    owners = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[i : i + window]), set()).add(item_id)
    lengths = sorted({len(p) for p in owners})
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in owners:
                    hit.update(range(i, i + n))
                    found |= owners[p]
        ids = ",".join(sorted("" if i is None else str(i) for i in found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def digest(found):
    from pyspark.sql import functions as F

    return found.select("doc_id", "n_words", decontam.n_hit(F.col("spans")).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), decontam.items_sha256(F.col("item_ids")).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = got(queries.op2_benchmark_decontamination(spark, SMALL))
    assert rows == brute(docs, items)
    assert any(r[5] for r in rows)


ITEMS = [(1, "the quick brown fox the quick brown fox the quick brown fox"), (2, "Alpha BETA"), (3, None), (4, "..."), (5, "東京 😀"), (5, "alpha beta"), (6, "gamma"), (6, "gamma"), (None, "only here"), (None, "alpha")]


def test_edge_rows_in_small_shards_and_blocks(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for shard, block in ((1 << 20, 10**6), (5, 4)):
        assert got(digest(decontam.find_spans(documents(spark), items, shard_words=shard, block_words=block))) == brute(DOCS, ITEMS)
        # blocks are stored between, never chained
        plan = decontam.find_spans(documents(spark), items, shard_words=shard, block_words=block)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
    assert decontam.find_spans(documents(spark, []), items).count() == 0
    assert not any(r[5] for r in got(digest(decontam.find_spans(documents(spark), items.limit(0)))))


def test_removed_text_is_clean(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, [(1, "x, alpha-beta; y"), (2, "alpha beta"), (3, None), (4, "clean")])
    for block in (10**6, 4):
        for rows in (decontam.remove_spans(decontam.find_spans(docs, items, block_words=block)), decontam.find_spans(docs, items, block_words=block, cut=True)):
            assert {r.doc_id: r.text for r in rows.collect()} == {1: "x, ; y", 3: None, 4: "clean"}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=6), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=6), max_size=4))
def test_index_finds_what_scanning_finds(docs, items):
    named = lambda xs: [b"w%d" % x for x in xs]
    phrases = decontam.Phrases([(str(k), named(x)) for k, x in enumerate(items)], 3)
    spans, found = decontam.search_shard([np.array([phrases.vocabulary.get(b"w%d" % x, 0) for x in d], np.int64) for d in docs], phrases)
    for d, s, f in zip(docs, spans, found, strict=True):
        hit, owners = set(), set()
        for k, item in enumerate(items):
            for i in range(max(1, len(item) - 2)):
                p = item[i : i + 3]
                for at in range(len(d) - len(p) + 1):
                    if d[at : at + len(p)] == p:
                        hit.update(range(at, at + len(p)))
                        owners.add(k)
        assert {x for a, b in s for x in range(a, b)} == hit
        assert sorted(phrases.items[i] for i in f) == sorted(map(str, owners))
