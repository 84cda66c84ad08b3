from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partweave.llm.tokens import PATTERN, VOCABULARY, Encoder, PerfectHash, encode_documents, merge_bytes, read_vocabulary

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="the vocabulary is not here")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PerfectHash(read_vocabulary()))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_vocabulary(), special_tokens={})


def test_perfect_hash_is_minimal_and_finds_its_keys():
    for n in (0, 1, 2, 5, 1000):
        values = {f"key{i}".encode(): i * 3 for i in range(n)}
        table = PerfectHash(values)
        assert table.find(list(values)) == list(values.values())
        assert table.find([b"other", b""]) == [-1, -1]
        if n:
            assert sorted(table.slots(list(values)).tolist()) == list(range(n))


TEXTS = ["", " ", "Hello, world!", "<|endoftext|> don't", "a" * 5000, "naïve café 交換済み 🙂👨‍🔧", "\r\n\t x y​", "قطعة 12", "1234567890" * 30, "\x00\x01"]


def test_equals_tiktoken_on_odd_texts(encoder, reference):
    assert encoder.encode(TEXTS) == [reference.encode_ordinary(t) for t in TEXTS]


def test_merging_alone_gives_the_same(encoder, reference):
    for t in TEXTS[1:]:
        pieces = encoder.split(t)
        assert [i for p in pieces for i in merge_bytes(p.encode(), encoder.ranks)] == reference.encode_ordinary(t)


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_equals_tiktoken_and_round_trips(encoder, reference, text):
    ids = encoder.encode([text])[0]
    assert ids == reference.encode_ordinary(text)
    assert reference.decode(ids) == text


def test_documents(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_documents(df).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t, _ in rows}
    assert encode_documents(df.limit(0)).count() == 0
