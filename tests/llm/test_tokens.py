"""Byte-level BPE and token counts against the public libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from readlens.llm import bpe, pretokens, textvec, tokencount

from .conftest import EDGES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", " ", "  ", "\n", "\t", " ", "　", "1", "²", "é", "中", "!", "?", "\U0001f600", "S", "\x1c", "\x85", "<|endoftext|>", "the", " the", "\r\n"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=5))
def test_encoding_equals_library(codec, library, texts):
    ids, places = codec.encode(texts)
    for text, own, offsets in zip(texts, ids, places):
        assert own.tolist() == library.encode_ordinary(text)
        assert codec.decode(own) == text.encode()
        assert offsets[0] == 0 and offsets[-1] == len(own)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(codec, text):
    assert codec.decode(codec.encode([text])[0][0]) == text.encode()


def test_block_borders_do_not_matter():
    rng = random.Random(3)
    text = "".join(rng.choice(PIECES) for _ in range(2000))
    whole = pretokens.slices([text])[0]
    assert "".join(whole) == text
    assert pretokens.slices(["x" * 127 + " " + text])[0][-50:] == whole[-50:]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=5))
def test_counts_equal_library(texts):
    tokenizer = Tokenizer.from_file(JSON)
    assert tokencount.Counter(tokencount.read_merges(JSON)).texts(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_long_run_stays_fast(codec, library):
    text = "ab" * 20_000
    assert codec.encode([text])[0][0].tolist() == library.encode_ordinary(text)


def test_digests_of_edge_cases(spark, edges, nothing, library):
    rows = bpe.digests(edges, RANKS).collect()
    assert len(rows) == len(EDGES)
    wanted = sorted(
        (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for t in (e[1] for e in EDGES) for ids in [library.encode_ordinary(t or "")]
    )
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == wanted
    assert bpe.digests(nothing, RANKS).count() == 0


def test_encode_then_decode_frames(edges):
    out = bpe.decode(bpe.encode(edges, RANKS), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in out) == sorted((e[1] or "").encode() for e in EDGES)


def test_token_counts_of_edge_cases(edges, nothing):
    tokenizer = Tokenizer.from_file(JSON)
    rows = tokencount.count_tokens(edges, JSON, 512).collect()
    wanted = sorted((len((t or "").encode()), n, n > 512) for t in (e[1] for e in EDGES) for n in [len(tokenizer.encode(t or "", add_special_tokens=False).ids)])
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == wanted
    assert tokencount.count_tokens(nothing, JSON, 512).count() == 0


def test_chunks_keep_order_and_nulls():
    assert [t for c in textvec.chunks(["a", None, "b" * 10, "c"], chars=5) for t in c] == ["a", "", "b" * 10, "c"]
