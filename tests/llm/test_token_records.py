"""Framed token records against the tokenizers library, Python checksums and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SCHEMA, corpus, with_clashes, workers  # noqa: F401  (workers: a fixture)
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vsframe.llm import token_records as tr
from vsframe.llm.common import utf8
from vsframe.session import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
PEER = Tokenizer.from_file(PATH)
PEER.encode_special_tokens = True
ENCODER = tr.WordEncoder(PATH)


def peer(text):
    return PEER.encode(text or "", add_special_tokens=False).ids + [2]


def masked(data):
    register = 0xFFFFFFFF
    for byte in data:
        register ^= byte
        for _ in range(8):
            register = (register >> 1) ^ 0x82F63B78 if register & 1 else register >> 1
    crc = register ^ 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums_against_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**32, 3000, dtype=np.uint32)
    starts, counts = np.array([0, 0, 3, 10, 100, 900, 2999, 7]), np.array([0, 1, 2, 256, 257, 2000, 1, 513])
    got = tr.masked_checksums(words, starts, counts)
    assert got.tolist() == [masked(words[a : a + n].tobytes()) for a, n in zip(starts, counts)]
    assert not len(tr.masked_checksums(words, starts[:0], counts[:0]))


def check(texts):
    ids, counts = ENCODER.encode(*utf8(pa.array(texts, pa.string())), 2)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == peer(text), repr(text)[:80]


def test_encoding_edge_cases():
    check(["", None, "İstanbul ΑΣ ΑΣ. é Éx H̱.a a̱", "x.'s it's 'Tis we'LL'd don't.'t", "a\xa0b c\x85d", "A.̸b a≠b"])
    check(["<|endoftext|>.<|startoftext|>a", "1.2.3 a1b 12ab.c", "KÅ \x01 a\x01b \x01\x01", "x" * 3000, ".́a .́ b", "\x1c\x1fa"])
    check(["".join(f"{chr(c)} a{chr(c)}.A{chr(c)}s'S" for c in range(b, b + 512) if not 0xD800 <= c < 0xE000) for b in range(0, 0x30000, 512)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abS'tLredvm.,-19 \n\t²é中🙂!\x85́İΣ\x01"), max_size=40), max_size=5))
def test_random_texts(texts):
    check(texts)


def test_cache_overflow(monkeypatch):
    monkeypatch.setattr(tr, "CACHE_WORDS", 50)
    rnd = random.Random(4)
    for _ in range(4):
        check([" ".join("".join(rnd.choices("abcdefgh", k=4)) for _ in range(n)) for n in (20, 200)])


def expected(rows):
    """doc_id, start, n_tokens, ids_crc32 by ids of distinct documents."""
    out, start = {}, 0
    for i, text in sorted(((i, t) for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0])):
        ids = peer(text)
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_records_and_index(spark):
    rows = [r for r in corpus(3, 60) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(None, "no id", "en"), (-5, "below zero", "en"), (2**62, "x " * 40000, "en")]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tr.token_record_report(df, PATH).collect()}
    assert got == expected(rows)
    # files of one frame or a few, read through the index in another order
    path = shared_dir(spark, "small-files")
    tr.write_records(df, path, PATH, 2, file_bytes=3000)
    index = tr.offset_index(spark, path).cache()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in index.collect()} == expected(rows)
    sizes = index.groupBy("path").agg(F.sum("length").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sizes) > 10 and all(r["size"] <= 3000 or r.n == 1 for r in sizes)
    wanted = index.where("n_tokens % 2 = 0").orderBy(F.xxhash64("doc_id", F.lit(5)))
    read = {r.doc_id: r.token_ids for r in tr.read_records(spark, path, wanted).collect()}
    assert read == {i: peer(t) for i, t, *_ in rows if len(peer(t)) % 2 == 0}


def test_repeats_nulls_and_empty(spark):
    rows = [(7, "same text", "en")] * 40 + [(7, "other", "en"), (None, None, None), (None, "", None), (8, "end", "en")]
    got = tr.token_record_report(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert len(got) == len(rows)
    at = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert [a for a, _, _ in at] == np.cumsum([0, *(n for _, n, _ in at[:-1])]).tolist()
    assert [i for *_, i in at] == [None, None, *[7] * 41, 8]
    empty = tr.token_record_report(spark.createDataFrame([], SCHEMA), PATH)
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_widths():
    lists = [[2], [70000, 5, 2], [], [9] * 300 + [65535], [4, 2]]
    ids, counts = np.array(sum(lists, []), np.uint32), np.array([len(x) for x in lists])
    numbers, known = np.array([5, -7, 0, 2**62, 1]), np.array([True, True, False, True, True])
    for narrow in (False, True):
        words, offsets = tr.frames(numbers, known, ids, counts, narrow)
        same, cuts = tr.parse_frames(words.tobytes() + b"\n")
        assert [tr.token_ids(same, a, b).tolist() for a, b in zip(cuts, cuts[1:])] == [[i % 65536 if narrow else i for i in x] for x in lists]
        assert tr._doc_ids(same, cuts[:-1]).to_pylist() == [5, -7, None, 2**62, 1]


def test_damage_is_found():
    ids, counts = ENCODER.encode(*utf8(pa.array(["some words here", "and more"])), 2)
    words, offsets = tr.frames(np.array([1, 2]), np.array([True, True]), ids, counts, True)
    whole = words.tobytes() + b"\n"
    assert tr.parse_frames(whole)[1].tolist() == offsets.tolist() and len(tr.parse_frames(b"")[1]) == 1
    for at in (0, 9, 20, len(whole) - 3):
        broken = bytearray(whole)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            tr.parse_frames(bytes(broken))
    with pytest.raises(ValueError):
        tr.parse_frames(whole[:-1])
