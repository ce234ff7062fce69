"""BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import tiktoken
from llm_cases import SCHEMA, corpus, with_clashes, workers  # noqa: F401  (workers: a fixture)
from hypothesis import given, settings
from hypothesis import strategies as st

from vsframe.llm import bpe
from vsframe.llm.common import utf8

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
VOCABULARY = bpe.Vocabulary(RANKS)
PEER = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(texts):
    ids, cuts = VOCABULARY.encode(*utf8(pa.array(texts, pa.string())))
    for i, text in enumerate(texts):
        own = ids[cuts[i] : cuts[i + 1]]
        assert own.tolist() == PEER.encode_ordinary(text or ""), repr(text)[:80]
        data, offsets = VOCABULARY.decode(own)
        assert data.tobytes() == (text or "").encode() and offsets[-1] == len(data)


def test_edge_cases():
    check(["", None, "'s", "it's'sam 'tis  we'll\n'llama", " ", "  a", "\n a", " \na", "a \n", "'", "''s", "9's", "'r", "'re", "x'l"])
    check(["x" * 5000, "ab" * 3000 + "  ", " " * 3000, "'" * 999, "é" * 700, "\x85\xa0　 \x1c\x1f", "<|endoftext|>"])
    check(["".join(chr(c) + " a1" + chr(c) * 2 for c in range(b, b + 512) if not 0xD800 <= c < 0xE000) for b in range(0, 0x30000, 512)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'stlredvm 19 \n\t²é中🙂!-\x85É́"), max_size=40), max_size=5))
def test_random_texts(texts):
    check(texts)


def test_cache_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SLICES", 50)
    rnd = random.Random(4)
    for _ in range(5):
        check(["".join(rnd.choices("abcde fgh", k=600))])


def test_operators(spark):
    rows = corpus(5, 30)
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    both = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((r.text or "") for r in both) == sorted((t or "") for _, t, _ in rows)
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.key == 7 for r in both)
    got = bpe.round_trip(df, PATH, packed="token_ids")
    assert "text" not in got.columns and got.count() == len(rows)
    ids = {r.doc_id: r for r in got.collect()}
    for i, text, _ in rows:
        if i is not None:
            want = PEER.encode_ordinary(text or "")
            assert ids[i].n_tokens == len(want) and len(ids[i].token_ids) == 4 * len(want)
            assert ids[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert ids[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.round_trip(empty, PATH).collect() == [] and bpe.encode(empty, PATH).collect() == []


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "n int, token_ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(df, PATH).collect()] == [b"", b""]


