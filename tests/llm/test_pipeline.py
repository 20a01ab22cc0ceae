from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from skyweave.llm import queries
from tests.oracle import SMALL

from .test_decontam import brute as hits
from .test_exact_dedup import brute as copies
from .test_near_copies import grouped
from .test_packing import check


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    scores = {r.doc_id: r.score for r in queries.op10_toxicity(spark, SMALL).collect()}
    step = stages["toxicity"](spark, docs, SMALL)
    assert step.columns == docs.columns and texts(step) == {i: t for i, t in texts(docs).items() if scores[i] < 0.5}
    before = texts(step)
    step = stages["exact_dedup"](spark, step, SMALL)
    kept = {r[0] for r in copies(before.items()) if r[3]}
    assert step.columns == docs.columns and texts(step) == {i: before[i] for i in kept}
    before = texts(step)
    step = stages["simhash_near_dedup"](spark, step, SMALL)
    kept = set(grouped(before.items()).values())
    assert step.columns == docs.columns and texts(step) == {i: before[i] for i in kept}
    before = texts(step)
    step = stages["benchmark_decontamination"](spark, step, SMALL)
    after, hit = texts(step), {r[0]: r for r in hits(before.items(), items)}
    assert step.columns == docs.columns and set(after) == {i for i, r in hit.items() if r[2] < r[1] or not r[1]}
    assert {i for i in after if after[i] != before[i]} == {i for i in after if hit[i][5]}
    check(stages["best_fit_packing"](spark, step, SMALL).collect(), list(after.items()))


def test_run_is_its_stages(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    bins = defaultdict(int)
    for r in rows:
        bins[r.sequence_id] += r.length
    assert rows and max(bins.values()) <= 2048


def test_edge_rows_go_through(spark):
    from .cases import documents

    docs = documents(spark).selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "CAST(length(text) AS LONG) AS n_chars", "path")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SMALL)
            assert rows.columns == docs.columns, name
        assert (corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).count() > 0) == (docs.limit(0).count() == 0 and rows.count() > 0)


def test_other_columns_go_through_whatever_their_names(spark):
    names = ["_row", "spans", "item_ids", "n_words", "score", "first", "row", "node", "root", "a.b", "column 2", "_id", "label"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = docs.select("doc_id", *(F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names), "text", "n_chars")
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], [more] * 4, strict=True):
        out = stage(spark, rows, SMALL)
        assert out.columns == more.columns, name
        want = sorted(r.doc_id for r in stage(spark, docs, SMALL).select("doc_id").collect())
        found = out.collect()
        assert sorted(r.doc_id for r in found) == want, name
        assert all(r[n] == f"{n} {r.doc_id}" for r in found for n in names), name


def test_copies_go_by_row(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "c"), (None, "c"), (None, "d e"), (None, "d  e"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, (r.text or "").strip()) for r in corpus_pipeline.drop_copies(spark, docs, SMALL).collect()), key=repr)
    assert [(i, " ".join(t.split())) for i, t in kept] == sorted([(1, "a b"), (1, "c"), (None, "d e"), (2, "")], key=repr)


def test_runs_leave_no_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    corpus_pipeline.drop_copies(spark, docs, SMALL).count()
    assert {t.name for t in spark.catalog.listTables()} == before
