import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from basketry.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "a", "a" * 5000, "ab" * 3000 + " ", "x'S 't it's", "\0 \n\0", "  two  blanks\n\n\ttab", "é漢字　 \x1c\x85²1'll", "word. word, word!!", " lead", "trail ", "\n", "a\nb \nc"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab 's\n\t.é漢²1　\x1c\x85"), st.characters(codec="utf-8")), max_size=50), min_size=1, max_size=6))
def test_encoder_equals_library(texts):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(PATH, P.PATTERN).merger.ranks, special_tokens={})
    e = bpe.encoder(PATH, P.PATTERN)
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(t)
        assert e.decode(ids.tolist()) == t.encode()


def test_long_and_short_pieces_merge_alike():
    m = bpe.encoder(PATH, P.PATTERN).merger
    pieces = [b"abcabcabcabc", b"tionement", "éèéè".encode() * 6, b"zz", b"qqqqqqqqqqqqqqqqqqqqq"]
    for p in pieces:
        assert list(memoryview(m.merge_many([p])[0]).cast("I")) == m.merge_long(p)


def test_a_small_memory_changes_nothing(library):
    e = bpe.Encoder(PATH, P.PATTERN)
    e.memory._limit = 5
    texts = [f"some words {k} and more. words, again" for k in range(20)]
    for k in range(0, 20, 4):
        assert [x.tolist() for x in e.encode(texts[k:k + 4])] == [library.encode_ordinary(t) for t in texts[k:k + 4]]


def test_digests_and_round_trip(spark, docs, library):
    texts = [*ODD, None, "same", "same"]
    df = docs(texts)
    got = {r.doc_id: r for r in bpe.digests(df, PATH, P.PATTERN).collect()}
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.digests(docs([]), PATH, P.PATTERN).count() == 0
