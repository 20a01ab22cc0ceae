import hashlib
import random
import re
import uuid
from collections import defaultdict

import pytest

from skyweave.llm import exact_dedup, queries
from skyweave.sources.shared import scratch_path
from tests.oracle import SMALL, compare, views

from .cases import DOCS, documents, got

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(doc_id)
    out = []
    for sha, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, order[0], len(ids), n == 0, sha) for n, i in enumerate(order)]
    return sorted(out, key=repr)


def index(spark):
    return exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")


def test_edge_rows(spark):
    assert got(index(spark).ingest(documents(spark)).select(COLUMNS)) == brute(DOCS)


def test_empty_table(spark):
    assert index(spark).ingest(documents(spark, [])).count() == 0


def test_query(spark):
    assert not compare(queries.op1_exact_dedup(spark, SMALL), queries.ORACLE_SQL["op1_exact_dedup"], views())


def test_later_batches_keep_what_came_first(spark):
    own = index(spark)
    own.ingest(documents(spark, [(5, "a b"), (6, "c")])).count()
    later = {r.doc_id: (r.keep_id, r.kept) for r in own.ingest(documents(spark, [(1, "a  b"), (2, "d"), (3, "d")])).collect()}
    assert later == {1: (5, False), 2: (2, True), 3: (2, False)}
    again = {r.doc_id: (r.keep_id, r.kept) for r in own.ingest(documents(spark, [(1, "a  b"), (2, "d"), (3, "d")])).collect()}
    assert again == later
    assert spark.table(own.table).count() == 3
    own.drop()


def in_batches(batches):
    """Verdicts batch by batch; batches are (name, rows)."""
    known, out = {}, []
    for name, rows in batches:
        groups = defaultdict(list)
        for i, t in rows:
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
        verdicts = []
        for text, ids in groups.items():
            order = sorted(ids, key=lambda i: (i is None, i or 0))
            keep, brought = known.setdefault(text, (order[0], name))
            verdicts += [(i, keep, len(ids), n == 0 and brought == name, hashlib.sha256(text.encode()).hexdigest()) for n, i in enumerate(order)]
        out.append(sorted(verdicts, key=repr))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_batches_with_nulls_repeats_and_replays(spark, seed):
    rng = random.Random(seed)
    batches = [(f"b{n}", [(rng.choice([None, *range(8)]), rng.choice([None, "", "one", "two", "two ", "three", "on e"])) for _ in range(rng.randint(0, 9))]) for n in range(4)]
    batches.insert(3, batches[1])  # replays
    batches.append(batches[2])
    for named in (True, False):
        own = index(spark)
        names = {repr(sorted(rows, key=repr)): name for name, rows in batches}  # unnamed batches are what their rows are
        want = in_batches(batches if named else [(names[repr(sorted(rows, key=repr))], rows) for _, rows in batches])
        for (name, rows), verdicts in zip(batches, want, strict=True):
            assert got(own.ingest(documents(spark, rows), batch=name if named else None).select(COLUMNS)) == verdicts
        own.drop()


def test_rows_of_another_batch_never_stay_again(spark):
    own = index(spark)
    assert [r.kept for r in own.ingest(documents(spark, [(None, "x"), (9, "two")])).collect()] == [True, True]
    assert {(r.doc_id, r.keep_id, r.kept) for r in own.ingest(documents(spark, [(None, "x"), (3, "two"), (9, "two")])).collect()} == {(None, None, False), (3, 9, False), (9, 9, False)}
    own.drop()


def test_the_index_outlives_the_catalog(spark):
    path, name = scratch_path(spark, "test-index"), f"digests_{uuid.uuid4().hex}"
    exact_dedup.DigestIndex(spark, name, 8, path).ingest(documents(spark, [(5, "a b"), (6, "c")]))
    spark.sql(f"DROP TABLE {name}")  # as another session finds it
    for again in (lambda: exact_dedup.DigestIndex(spark, name, 8, path), lambda: exact_dedup.DigestIndex(spark, f"{name}_b", path=path), lambda: exact_dedup.DigestIndex(spark.newSession(), name, path=path)):
        own = again()
        assert {r.doc_id: (r.keep_id, r.kept) for r in own.ingest(documents(spark, [(1, "a  b"), (6, "c")])).collect()} == {1: (5, False), 6: (6, False)}
        assert own._spark.table(own.table).count() == 2
    with pytest.raises(ValueError, match="8 buckets, not 16"):
        exact_dedup.DigestIndex(spark, name, 16, path)
    own.drop()


def test_the_index_is_found_by_its_name(spark):
    own = index(spark)
    own.ingest(documents(spark, [(5, "a b")]))
    assert spark.table(exact_dedup.DigestIndex(spark, own.table).table).count() == 1
    spark.sql(f"DROP TABLE {own.table}")
    assert spark.table(exact_dedup.DigestIndex(spark, own.table).table).count() == 1
    own.drop()


def test_nothing_else_is_taken_for_an_index(spark):
    path, name = scratch_path(spark, "test-index"), f"digests_{uuid.uuid4().hex}"
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError, match="isn't empty"):
        exact_dedup.DigestIndex(spark, name, path=path)
    spark.range(3).write.saveAsTable(name)
    with pytest.raises(ValueError, match="another table"):
        exact_dedup.DigestIndex(spark, name)
    assert spark.table(name).count() == 3 and spark.read.parquet(path).count() == 3


def test_a_merge_neither_shuffles_nor_sorts_the_index(spark):
    own = index(spark)
    groups = spark.range(1000).selectExpr("unhex(sha2(CAST(id AS STRING), 256)) AS digest", "id AS first_id")

    def above_scan():
        with own.in_order():
            plan = own.unseen(groups)._jdf.queryExecution().executedPlan().toString()
        side = plan[: plan.index("FileScan parquet")].splitlines()
        depth = len(plan[: plan.index("FileScan parquet")].splitlines()[-1])
        return [x for x in side[side.index(next(x for x in side if "SortMergeJoin" in x)) :] if ("Sort " in x or "Exchange" in x) and x.index(re.search("Sort |Exchange", x)[0]) < depth and side.index(x) > max(k for k, y in enumerate(side) if "Range" in y or "SortMergeJoin" in y)]

    own.ingest(documents(spark, [(i, f"text {i}") for i in range(500)]))
    assert not above_scan()
    own.ingest(documents(spark, [(i, f"other {i}") for i in range(500)]))
    assert above_scan()  # two files a bucket
    own.compact()
    assert not above_scan() and spark.table(own.table).count() == 1000
    own.compact()
    own.compact()
    assert own._folder.names() == ["gen-000002", "gen-000003", "layout"]
    assert {r.kept for r in own.ingest(documents(spark, [(900 + i, f"text {i}") for i in range(500)])).collect()} == {False}
    own.drop()


def test_query_leaves_no_index(spark):
    before = {t.name for t in spark.catalog.listTables()}
    queries.op1_exact_dedup(spark, SMALL).count()
    assert {t.name for t in spark.catalog.listTables()} == before
