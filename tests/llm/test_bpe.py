import functools
import hashlib
import json
import struct
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from streamlearn.llm import bpe
from streamlearn.llm import queries as Q


@functools.cache
def both():
    with open(Q.vocabulary(), encoding="utf-8") as f:
        return Tokenizer.from_file(Q.vocabulary()), bpe.Codec(json.load(f))


@pytest.fixture
def library():
    return both()[0]


@pytest.fixture
def own():
    return both()[1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", " The", "'ll", "'RE", "  ", "\n\n", "\x1c", "\x85", "\xa0", " ", "　", "日本", "é", "é", "😀", "123", " 9", "<|endoftext|>", "###", "​", "a" * 50]) | st.text(max_size=6), max_size=14))
def test_equals_the_library(parts):
    text = "".join(parts)
    lib, mine = both()
    ids = lib.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False) == text


def test_long_texts_pass_in_blocks(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 50)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 80)
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(3000)) + "<|endoftext|> x" + "a" * 5000
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_shared_prefixes_are_walked_once(own):
    words = sorted({b" token", b" tokens", b" tokenize", b" tokenizer", b"x"})
    assert [i for _, i in own.v.encode_words(words)] == [own.v.merge(w) for w in words]


def digests(library, i, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_query(spark, sf_dir, small_dir, library):
    for d in (sf_dir, small_dir):
        rows = Q.read(spark, d, "documents").collect()
        assert Counter(map(tuple, Q.op5_bpe(spark, d).collect())) == Counter(digests(library, r.doc_id, r.text) for r in rows)


def test_empty_and_ids(spark, empty_docs, odd_docs, library):
    assert bpe.encode_documents(empty_docs, Q.vocabulary()).count() == 0
    out = bpe.encode_documents(odd_docs, Q.vocabulary(), with_ids=True).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert all(r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids for r in out)
