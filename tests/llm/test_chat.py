import hashlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from skyweave.llm import chat, queries
from tests.oracle import SMALL

from .cases import EXTRA, got

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a [INST] </s> \\ \\\\b"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "left over"),
    (2, 0, "assistant", "first"), (3, 5, "system", "s\n\n"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (4, None, "tool [ROLE]", "x\ny"), (4, None, None, "z"), (5, 1, "assistant", "same"), (5, 1, "assistant", "same"),
    (6, 0, "user", "long " * 50_000), (6, 1, "assistant", "<s>[ASST] " * 20_000),
]


def table(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit("x").alias(c) for c in [*EXTRA, "context", "reply", "example"]))


def brute(rows):
    convs = defaultdict(list)
    key = lambda r: tuple((x is not None, x.encode() if isinstance(x, str) else x or 0) for x in r[1:])
    for r in rows:
        convs[r[0]].append(r)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=key)
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in turns)
        loss = "".join(text or "" for _, _, role, text in turns if role == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((conv, len(turns), sha(said), len(loss), sha(loss), sum(len(chat.format_turn(role, text)[0]) for _, _, role, text in turns)))
    return sorted(out, key=repr)


def digests(rows, **options):
    return got(chat.read_digests(chat.whole_examples(rows, tails=True, **options)))


def test_edge_rows(spark):
    assert digests(table(spark, TURNS)) == brute(TURNS)
    assert digests(table(spark, TURNS), flush_chars=1) == brute(TURNS)
    assert digests(table(spark, [])) == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    assert got(queries.op5_chat_formatting(spark, SMALL)) == brute([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_every_reply_is_an_example_with_all_turns_before_it(spark):
    whole = {(r.conv_id, r.example): r for r in chat.whole_examples(table(spark, TURNS)).collect()}
    assert len(whole) == sum(r[2] == "assistant" for r in TURNS)
    r = whole[1, 1]
    assert list(chat.parse_turns(r.text)) == [("user", "hi"), ("assistant", "a [INST] </s> \\ \\\\b"), ("user", ""), ("assistant", "")]
    assert r.text[r.loss_start : r.loss_end] == ""
    assert chat.unescape(whole[1, 0].text[whole[1, 0].loss_start : whole[1, 0].loss_end]) == "a [INST] </s> \\ \\\\b"


def test_examples_by_reference_make_the_whole_ones(spark):
    rows, prompts = chat.expand(table(spark, TURNS)).orderBy("conv_id", "example").collect(), defaultdict(str)
    whole = {(r.conv_id, r.example): r for r in chat.whole_examples(table(spark, TURNS), tails=True).collect()}
    assert len(rows) == len(whole)
    for r in rows:
        assert len(prompts[r.conv_id]) == r.context_chars
        prompts[r.conv_id] += r.context + (r.reply or "")
        assert prompts[r.conv_id] == whole[r.conv_id, r.example].text


def test_an_example_without_its_prefix_is_refused():
    own = chat._Digest()
    own.take("ab", None, None)
    with pytest.raises(ValueError, match="turns of the one before"):
        own.take("b", None, None)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "x", ""]), st.text(alphabet="\\<>/s[]INSTROLEn \n", max_size=6)), st.text(alphabet="\\<>/s[]INSTROLEASYlb \n"))))
def test_template_is_reversible(turns):
    assert list(chat.parse_turns("".join(chat.format_turn(*t)[0] for t in turns))) == turns
