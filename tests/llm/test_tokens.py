import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyweave.llm import queries, token_counts, token_files, tokens
from tests.oracle import SMALL

from .cases import DOCS, documents, got


def plain():
    t = Tokenizer.from_file(queries.tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ENCODE = plain()
ENCODER = tokens.TextEncoder(queries.tokenizer(), max_chunks=300, max_chars=5_000)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet=" \n\t  ab'1.,!\x01é東", max_size=40)), max_size=5))
def test_chunked_ids_are_the_library_s(texts):
    ids, bounds = ENCODER.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [ENCODE(t) for t in texts]


def test_files_of_another_kind_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokens.TextEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_chunked_ids_of_whole_documents(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    ids, bounds = tokens.TextEncoder(queries.tokenizer()).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [ENCODE(t) for t in texts]


def expected(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*ENCODE(text), 2]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return sorted(out, key=repr)


def test_token_files_query(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert got(queries.op6_token_files(spark, SMALL)) == expected(rows)


def test_token_files_edge_rows(spark, tmp_path):
    token_files.write_tokens(documents(spark), f"file://{tmp_path}/t", queries.tokenizer(), block_ids=50)
    order = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert got(token_files.read_documents(spark, f"file://{tmp_path}/t")) == expected(order)
    ids = got(token_files.read_ids(spark, f"file://{tmp_path}/t").where("doc_id = 9"))
    assert ids == [(9, [*ENCODE("<|endoftext|> it's we'll \x01 x"), 2])]
    token_files.write_tokens(documents(spark, []), f"file://{tmp_path}/e", queries.tokenizer())
    assert token_files.read_documents(spark, f"file://{tmp_path}/e").count() == 0


def test_one_doc_id_is_many_tasks(spark, tmp_path):
    rows = [(7, "the same start of a text" if n % 3 else f"{n:04d} text") for n in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as the rows are few
    try:
        token_files.write_tokens(documents(spark, rows), f"file://{tmp_path}/h", queries.tokenizer(), block_ids=50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got(token_files.read_documents(spark, f"file://{tmp_path}/h")) == expected(sorted(rows, key=lambda r: r[1]))
    per_part = [r["n"] for r in spark.read.parquet(f"file://{tmp_path}/h").groupBy("part").agg(token_files.F.sum(token_files.F.size("counts")).alias("n")).collect()]
    assert len(per_part) == 8 and max(per_part) < 3000 / 4


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_variable_length_round_trip(values):
    control, data = token_files.encode_values(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert token_files.decode_values(control, data, len(values)).tolist() == values


def test_frequent_ids_take_one_byte():
    ids = np.array([50_000] * 900 + list(range(300)))
    table, control, data = token_files.encode_block(ids)
    assert len(data) == 900 + 255 + 2 * 45 and token_files.decode_block(table, control, data, len(ids)).tolist() == ids.tolist()


def changes(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, text string, sign int, n_tokens string")


def test_rollup_deltas(spark, tmp_path):
    own = token_counts.TokenRollup(spark, f"file://{tmp_path}/r", queries.tokenizer(), "v1")
    assert own.totals().count() == 0
    n = lambda t: len(ENCODE(t))
    assert own.commit("a", changes(spark, [("s", "en", "one two", 1, "x"), ("s", "en", "three", 1, "x"), (None, "en", None, 1, "x"), ("t", None, "", 1, "x")]), "sign")
    assert not own.commit("a", changes(spark, [("s", "en", "one two", 1, "x")]), "sign")
    assert got(own.totals()) == sorted([("s", "en", "v1", 2, n("one two") + n("three")), (None, "en", "v1", 1, 0), ("t", None, "v1", 1, 0)], key=repr)
    own.commit("b", changes(spark, [("s", "en", "three", -1, "x"), ("s", "en", "three revised", 1, "x"), ("t", None, "", -1, "x")]), "sign")
    want = sorted([("s", "en", "v1", 2, n("one two") + n("three revised")), (None, "en", "v1", 1, 0)], key=repr)
    assert got(own.totals()) == want
    own.compact()
    assert got(own.totals()) == want
    assert not own.commit("b", changes(spark, []), "sign") and own.commit("c", changes(spark, []), "sign")
    assert got(own.totals()) == want


def test_rollup_query(spark):
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        d, t = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = d + 1, t + len(ENCODE(r.text))
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.op7_token_counts(spark, SMALL).collect()} == want
