import re
from collections import defaultdict

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from skyweave.llm import queries, simhash
from tests.oracle import SMALL

from .cases import DOCS, documents, got


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=2):
    """doc_id, fingerprint and component of rows (doc_id, fp), by all pairs."""
    by_fp = defaultdict(list)
    for doc_id, fp in rows:
        by_fp[fp].append(doc_id)
    todo, out = set(by_fp), []
    while todo:
        stack, found = [todo.pop()], []
        while stack:
            a = stack.pop()
            found.append(a)
            near = {b for b in todo if (a ^ b).bit_count() <= radius}
            todo -= near
            stack += near
        ids = [i for f in found for i in by_fp[f]]
        least = min((i for i in ids if i is not None), default=None)
        out += [(i, f"{f:016x}", least) for f in found for i in by_fp[f]]
    return sorted(out, key=repr)


def test_query(spark):
    rows = [(r.doc_id, fingerprint(r.text)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = components(rows)
    assert got(queries.op9_simhash_near_dedup(spark, SMALL)) == want
    assert len({r[2] for r in want}) < len(want)


def test_edge_rows(spark):
    assert got(simhash.near_duplicates(documents(spark))) == components([(i, fingerprint(t)) for i, t in DOCS])
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def crowd(seed=7, n=260):
    import random

    r, out = random.Random(seed), []
    while len(out) < n:
        base = r.getrandbits(64) if r.random() < 0.4 or not out else r.choice(out)
        out.append(base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))))
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_at_every_shard_size(spark):
    prints = [*crowd(), 0, (1 << 64) - 1, 1 << 63]
    want = {f: c for _, f, c in components([(signed(f), f) for f in prints])}
    for cap in (20_000, 2):
        df = spark.createDataFrame([(signed(f),) for f in sorted(set(prints))], "fp long")
        roots = {r.node: r.root for r in simhash.components(simhash.near_links(df, 2, cap)).collect()}
        group = lambda f: roots.get(signed(f), signed(f))
        assert {frozenset(x for x in prints if group(x) == group(f)) for f in prints} == {frozenset(x for x in prints if want[f"{x:016x}"] == want[f"{f:016x}"]) for f in prints}


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 2**10 - 1), unique=True, max_size=40), st.integers(0, 3))
def test_tree_links_what_all_pairs_link(values, radius):
    links = simhash.spanning_links(values, radius)
    assert all((a, b) for a, b in links)
    want = {frozenset(int(f, 16) for _, f, c in rows) for rows in _by_component(components([(v, v) for v in values], radius))}
    groups = {v: {v} for v in values}
    for a, b in links:
        merged = groups[a] | groups[b]
        for v in merged:
            groups[v] = merged
    assert {frozenset(g) for g in groups.values()} == want


def _by_component(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[2]].append(r)
    return out.values()


def test_long_chain_of_links(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    assert {tuple(r) for r in simhash.components(chain).collect()} == {(i, 0) for i in range(1, 301)}
