from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyweave.llm import queries, token_counts
from skyweave.sources.shared import scratch_path
from tests.oracle import SMALL


def rollup(spark):
    return token_counts.TokenRollup(spark, scratch_path(spark, "test-rollup"), queries.tokenizer(), "v1")


def docs(spark, n, source="s"):
    return spark.createDataFrame([(source, "en", f"text {i}") for i in range(n)], "source string, lang string, text string")


def counts(own):
    return {r.source: r.n_docs for r in own.totals().collect()}


def test_query_sums_signed_batches(spark, monkeypatch):
    made, totals = [], token_counts.TokenRollup.totals
    monkeypatch.setattr(token_counts.TokenRollup, "totals", lambda self: made.append(self) or totals(self))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.op7_token_counts(spark, SMALL).collect()}
    assert sorted(b for names in made[0].committed().values() for b in names) == ["load", "revision"]
    assert [n.startswith("base-") for n in made[0].committed()] == [True]
    parts = {n.split("-")[1]: spark.read.parquet(f"{made[0]._path}/{n}").collect() for n in made[0]._folder.names() if n.startswith("batch-")}
    assert any(r.source.startswith("unsorted/") for r in parts["load"]) and min(r.n_docs for r in parts["revision"]) < 0 < max(r.n_docs for r in parts["revision"])
    n_docs, n_tokens = Counter(), Counter()
    for r in token_counts.count_tokens(spark.read.parquet(f"{SMALL}/documents.parquet"), queries.tokenizer()).collect():
        n_docs[r.source, r.lang] += 1
        n_tokens[r.source, r.lang] += r.n_tokens
    assert got == {k: (n_docs[k], n_tokens[k]) for k in n_docs}


def test_a_batch_committed_while_another_compacts_counts_once(spark, monkeypatch):
    own = rollup(spark)
    own.commit("one", docs(spark, 1))
    other, listed = token_counts.TokenRollup(spark, own._path, queries.tokenizer(), "v1"), own.committed

    def meanwhile():
        held = listed()
        monkeypatch.undo()
        other.commit("two", docs(spark, 1))
        return held

    monkeypatch.setattr(own, "committed", meanwhile)
    own.compact()
    assert counts(own) == {"s": 2}
    own.compact()
    own.commit("three", docs(spark, 1, "t"))
    assert counts(own) == {"s": 2, "t": 1}


def test_a_batch_committed_twice_at_once_counts_once(spark, monkeypatch):
    own = rollup(spark)
    monkeypatch.setattr(own, "committed", dict)  # neither sees the other
    assert own.commit("one", docs(spark, 3)) and own.commit("one", docs(spark, 3))
    monkeypatch.undo()
    assert counts(own) == {"s": 3} and not own.commit("one", docs(spark, 3))


def test_deletes_revisions_nulls_and_empty_batches(spark):
    own = rollup(spark)
    own.commit("load", spark.createDataFrame([(None, None, None), ("a", "en", "x"), ("a", "en", "y")], "source string, lang string, text string"))
    own.commit("none", docs(spark, 0))
    own.commit("delete", spark.createDataFrame([("a", "en", "x", -1), ("a", "en", "y", -1), ("b", "en", "y", 1)], "source string, lang string, text string, sign int"), "sign")
    assert counts(own) == {None: 1, "b": 1}


def test_folded_folders_go_with_the_next_compaction(spark):
    own = rollup(spark)
    for n in range(6):
        own.commit(f"b{n}", docs(spark, 1))
        own.compact()
        assert counts(own) == {"s": n + 1} and len(own._folder.names()) <= 6
    assert not own.commit("b0", docs(spark, 1)) and not own.commit("b5", docs(spark, 1))


def test_other_folders_are_left_alone(spark):
    own = rollup(spark)
    own.commit("one", docs(spark, 1))
    for name in ("batch-x", "base-y", "notes"):
        docs(spark, 1).write.parquet(f"{own._path}/{name}")
    own.compact(), own.compact()
    assert counts(own) == {"s": 1} and {"batch-x", "base-y", "notes"} <= set(own._folder.names())


@pytest.mark.parametrize("sign", [None, 5, 0])
def test_odd_signs_fail_their_batch(spark, sign):
    own = rollup(spark)
    odd = docs(spark, 3).withColumn("sign", F.when(F.col("text") != "text 1", 1).otherwise(F.lit(sign).cast("int")))
    with pytest.raises(Exception, match="1 or -1"):
        own.commit("odd", odd, "sign")
    assert counts(own) == {} and own.commit("odd", odd.withColumn("sign", F.lit(1)), "sign") and counts(own) == {"s": 3}
