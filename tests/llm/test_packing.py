from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from skyweave.llm import packing, queries
from tests.oracle import SMALL

from .cases import DOCS, documents
from .test_tokens import ENCODE, crc


def best_fit(lengths, capacity):
    """How many bins best-fit decreasing needs, one piece at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def check(rows, texts, capacity=2048):
    ids = [(doc_id, [*ENCODE(t), 0]) for doc_id, t in texts]
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    expected = defaultdict(list)
    for doc_id, own in ids:
        n = max(1, -(-len(own) // capacity))
        first = len(own) - (n - 1) * capacity
        at = [0, *range(first, len(own), capacity)]
        expected[doc_id] += [(k, a, b - a, crc(own[a:b])) for k, (a, b) in enumerate(zip(at, [*at[1:], len(own)], strict=True))]
    assert {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in x) for d, x in pieces.items()} == {d: sorted(x) for d, x in expected.items()}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == best_fit([r.length for r in rows], capacity)


def test_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op3_best_fit_packing(spark, SMALL).collect(), texts)


def test_edge_rows(spark):
    check(packing.pack(documents(spark), queries.tokenizer()).collect(), DOCS)
    assert packing.pack(documents(spark, []), queries.tokenizer()).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 12), max_size=12))
def test_plan_is_best_fit_decreasing(histogram):
    plan = packing.plan_best_fit(histogram, 30)
    places, at = [], 0
    used = defaultdict(list)
    for k, (length, rank, first, each, offset) in enumerate(plan.tolist()):
        last = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else histogram[length]
        for step in range(last - rank):
            used[first + step // each].append((offset + step % each * length, length))
            places.append(length)
    assert sorted(places) == sorted(n for n, c in histogram.items() for _ in range(c))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 30
    assert len(used) == best_fit(places, 30)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 40)), st.integers(0, 40))
def test_tree_finds_the_tightest(held, least):
    tree = packing.CapacityTree(40)
    for c in held:
        tree.set(c, True)
    assert tree.tightest(least) == min((c for c in held if c >= least), default=None)
