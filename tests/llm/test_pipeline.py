"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from llm_cases import SCHEMA, corpus, prose, with_clashes, workers  # noqa: F401  (workers: a fixture)
from test_exact_and_lines import expected_lines
from test_models import expected_contamination
from test_suffix_and_join import expected_components, near_copies

from vsframe.llm import bpe
from vsframe.llm.langid import classify, train_prototypes
from vsframe.session import shared_dir


def tables(spark):
    rnd = random.Random(21)
    items = [(k, prose(rnd, "en", 20)) for k in range(4)]
    rows = [r for r in corpus(17, 60) if r[0] is not None] + near_copies(4, 12)
    rows += [(9001, "st " * 900, None), (9002, "".join(rnd.choices("qxzwkjvy ", k=4000)), None)]
    rows += [(8000 + k, prose(rnd, "en", 30) + " " + items[k % 4][1], "en") for k in range(6)]
    folder = shared_dir(spark, "pipeline-tables")
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet"), items


def test_stages(spark):
    folder, docs, items = tables(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_duplicates", "decontamination", "byte_level_bpe",
    ]
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.lang) for r in out.collect()]
        columns = out.columns
        path = shared_dir(spark, name)
        stage(spark, out, folder).write.parquet(path)
        source, out = out, spark.read.parquet(path)
        rows = out.collect()
        if name != "byte_level_bpe":
            assert out.columns == columns and all(r.key == 7 for r in rows)
        if name == "language_id":
            scored = classify(source, train_prototypes(source), out=("p", "s", "size")).collect()
            noise = sorted(r.size * (1 / r.s**2 - 1) for r in scored if r.p == r.lang and r.size >= 64)
            floor = {r.size: (r.size / (r.size + 8 * noise[(len(noise) - 1) // 2])) ** 0.5 - 3 / 32 for r in scored if r.size}
            known = {r.doc_id for r in scored if r.p != "und" and (r.size < 64 or r.s >= floor[r.size])}
            assert {r.doc_id for r in rows} == known
            assert not {2000, 2001, 2002, 9001, 9002} & known
            prose_ids = {i for i, t, _ in before if t and i < 9000 and len(set(t.split())) > 2}
            assert prose_ids <= known and {2004, 2006} - known == {2006}
        elif name == "line_dedup":
            got = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows}
            assert got == {(k[0], k[3]) for k in expected_lines(before)} and len(rows) == len(before)
            assert all(r.n_chars in (7, len(r.text)) for r in rows)
        elif name == "near_duplicates":
            assert {r.doc_id for r in rows} == {i for i, n, c in expected_components(before) if c is None or i == c or n == 0}
            assert len(rows) < len(before) - 10
        elif name == "decontamination":
            assert {r.doc_id for r in rows} == {k[0] for k in expected_contamination(before, items) if not k[5]}
            assert len(rows) < len(before)
        else:
            ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            peer = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            texts = {i: t for i, t, _ in before}
            for r in rows:
                assert memoryview(r.token_ids).cast("I").tolist() == peer.encode_ordinary(texts[r.doc_id])
                assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
            assert len(rows) == len(before) > 20


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, two linked texts of one id, and groups without ids."""
    rnd = random.Random(31)
    a, b, c, d = (prose(rnd, "en", 80) for _ in range(4))
    rows = [(1, a, "en")] * 3 + [(2, a, "en"), (None, a, "en")]
    rows += [(5, b, "en"), (5, b + " more", "en"), (6, b, "en")]
    rows += [(None, c, "en"), (None, c + " more", "en"), (None, c, "fr"), (None, d, "en"), (None, d, "en")]
    rows += [(9, "quite alone here with six words", "en"), (None, "no id and alone with words", "en"), (None, None, "en"), (10, "", "en"), (10, "", "en")]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    got = sorted((r.doc_id or 0, (r.text or "")[:20]) for r in out.collect())
    want = [(1, a), (5, b), (0, c), (0, d), (9, rows[-5][1]), (0, rows[-4][1]), (0, ""), (10, ""), (10, "")]
    assert out.columns == docs.columns and got == sorted((i, t[:20]) for i, t in want)


def test_run(spark):
    folder, _, _ = tables(spark)
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "lang", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"} <= set(out.columns) and "text" not in out.columns
    assert out.count() > 20


def test_empty_documents(spark):
    folder, docs, _ = tables(spark)
    out = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, folder)
    assert out.collect() == []
