import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import quality, queries
from tests.oracle import SMALL

from .cases import DOCS, LONG, documents, got
from .test_toxicity import auc


def test_held_out_rows(spark):
    sf = SMALL.replace("0.001", "0.01")
    out = {r.doc_id: r for r in queries.op13_quality(spark, sf).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert set(out) == docs and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in out and out[r.doc_id].held_out}
    y, p = np.array(list(labels.values())), np.array([out[i].score for i in labels])
    assert auc(p, y) > 0.97 and np.mean((p >= 0.5) == y) > 0.95


def test_statistics_are_what_plain_python_gives(spark):
    texts = ["", None, "One two two THREE!\nOne two", "a | b | c\n\n\n", "WWW.x.org <p> 12 3", LONG, " \t\n", "Ünï Ünï ß"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", *(c.alias(k) for k, c in quality.statistics(F.col("text")).items())).collect()
    for r in rows:
        t = texts[r.i] or ""
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
        n = len(w)
        per = lambda a, b: a / b if b else 0.0
        want = {
            "words": n, "word_length": per(len(t), n), "words_in_line": per(n, len(lines)), "distinct_words": per(len(set(w)), n), "distinct_lines": per(len(set(lines)), len(lines)),
            "repeated_words": per(len(re.findall(r"(?<!\S)(\S+)\s+\1(?!\S)", t)), n), "capitals": per(sum(c.isupper() for c in t), len(t)), "capital_words": per(sum(x[0].isupper() for x in w), n),
            "digits": per(sum(c in "0123456789" for c in t), len(t)), "shouts": per(sum(c in "!?" for c in t), n), "short_words": per(sum(len(x) < 4 for x in w), n), "stops": per(len(re.findall(r"[.!?](?!\S)", t)), n),
        }
        assert {k: r[k] for k in want} == pytest.approx(want), t[:40]


def plain(rows, model):
    """A model's score of statistics, rule by rule."""
    out = []
    for r in rows:
        z = model.bias + sum(w for rule, w in model.weights.items() if all(low < r[k] <= high for k, low, high in rule.bounds))
        out.append(1 / (1 + math.exp(-max(-35, min(35, z)))))
    return out


ROWS = [(i, ("good calm words, all of them. " * 4 if i % 2 else "$$$ BUY | NOW ### !! " * (1 + i % 5)) + f"filler{i}", i % 2) for i in range(400)]


def small(spark, rows=ROWS, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    return quality.train(df, df, quality.Settings(trees=8, **more))


def test_compiled_rules_are_what_plain_rules_give(spark):
    model = small(spark)
    docs = spark.createDataFrame([(i, t) for i, t, _ in ROWS], "doc_id long, text string")
    stats = docs.select("doc_id", *(c.alias(k) for k, c in quality.statistics(F.col("text")).items())).orderBy("doc_id").collect()
    assert [r.score for r in quality.score(docs, model).orderBy("doc_id").collect()] == pytest.approx(plain(stats, model))
    assert 0 < len(model.weights) and all((r.score >= 0.5) == r.doc_id % 2 for r in quality.score(docs, model).collect())


def test_rules_are_paths_of_trees_and_lasso_drops_most(spark):
    strong, weak = small(spark, l1=0.2), small(spark, l1=1e-4)
    assert len(strong.weights) <= len(weak.weights) < 8 * 14
    assert all(low < high and k in quality.STATISTICS for r in weak.weights for k, low, high in r.bounds)
    assert all(1 <= len(r.bounds) <= 3 for r in weak.weights)


def test_edge_rows_and_names_of_statistics(spark):
    model = small(spark)
    docs = documents(spark).withColumn("words", F.lit("x")).withColumn("_Words", F.lit(1))
    scored = quality.score(docs, model)
    assert len(got(scored)) == len(DOCS) and all(0 <= r[-1] <= 1 for r in got(scored))
    assert scored.columns == [*(c for c in docs.columns if c != "score"), "score"]
    assert quality.score(documents(spark, []), model).count() == 0


@pytest.mark.parametrize("rows,want", [([], 0.5), ([(1, "a", None)], 0.5), ([(1, "a", 1), (2, "b", 1)], 3 / 4), ([(1, "a", 0)], 1 / 3), ([(1, "a", 0), (2, "a", 1)], None)])
def test_few_rows(spark, rows, want):
    model = small(spark, rows)
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    scores = [r.score for r in quality.score(docs, model).collect()]
    assert all(0 <= x <= 1 for x in scores) and (want is None or scores == pytest.approx([want] * 2))


def test_repeated_and_odd_labels_count_once(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, label int")
    more = [(i, t, 7 if label else 0) for i, t, label in ROWS] + [(i, t, 1) for i, t, label in ROWS if not label] + [(None, "x", 1), (3, "x", None), (10**6, "none", 0)]
    a = quality.train(docs, docs, quality.Settings(trees=4))
    b = quality.train(docs, spark.createDataFrame(more, "doc_id long, text string, label int"), quality.Settings(trees=4))
    assert {str(r): round(w, 6) for r, w in a.weights.items()} == {str(r): round(w, 6) for r, w in b.weights.items()}
