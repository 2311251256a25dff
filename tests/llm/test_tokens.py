"""The encoder against the public library, and lists of empty and null texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folio.llm import tokens


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    return t


TEXTS = ["", "a", "aaaaaaa", "Hello  world\n\n\n x", "<|endoftext|>", "سلام دنیا ۱۲", "can't I'LL we've", "\t\r\n", "👩‍🔧é é", "x" * 3000, " " * 50, "\x00\x01"]


def ids(texts):
    flat, offsets = tokens.encoder(tokens.TOKENIZER, tokens.read_tokenizer).encode(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_same_as_library(library):
    assert ids(TEXTS) == [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text(text):
    t = Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    assert ids([text]) == [t.encode(text, add_special_tokens=False).ids]


def test_frame(spark, data, library):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "hi", 9), (3, "hi", 9)], "doc_id bigint, text string, ids int")
    assert sorted((r.doc_id, r.ids) for r in tokens.encode_ids(df).collect()) == [(1, []), (2, []), (3, library.encode("hi").ids), (3, library.encode("hi").ids)]
    assert tokens.encode_ids(df.limit(0)).count() == 0
    assert sorted(r.tokens for r in tokens.token_counts(df, ["doc_id"]).collect()) == [0, 0, 1, 1]
    documents = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in tokens.encode_ids(documents).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert all(got[r.doc_id] == library.encode(r.text or "", add_special_tokens=False).ids for r in rows)
