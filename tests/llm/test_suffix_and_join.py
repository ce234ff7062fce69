"""Suffix dedup and the n-gram join against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SCHEMA, corpus, prose, with_clashes, workers  # noqa: F401  (workers: a fixture)
from pyspark.sql import functions as F

from vsframe.llm import ngram_join, suffix_dedup
from vsframe.llm.common import SALTS, salted_join, salted_right, salts_met
from vsframe.llm.components import components


def bag(df):
    return Counter(map(tuple, df.collect()))


def expected_suffix(texts, length, first_only=False):
    """(bytes, removed, runs, sha) of each text; texts in keeping order."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[j : j + length] for b in data for j in range(len(b) - length + 1))
    met, out = set(), []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if (w in met) if first_only else seen[w] > 1:
                gone[j : j + length] = True
            met.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((len(b), int(gone[:-1].sum()) if len(b) else 0, runs, hashlib.sha256(kept).hexdigest()))
    return out


def suffix_cases():
    rnd = random.Random(8)
    texts = [t for _, t, _ in corpus(6, 50)]
    texts += ["ab" * 400, "a" * 199, "a" * 200, "a" * 201, "x" + "q" * 700 + "y"]
    shared = prose(rnd, "en", 50)
    texts += [prose(rnd, "de", k) + shared[: 190 + k] + prose(rnd, "fr", 3) for k in range(40)]
    return [(i, t, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("group_slices", [512, 1])
def test_suffix_dedup(spark, monkeypatch, group_slices):
    monkeypatch.setattr(suffix_dedup, "GROUP_SLICES", group_slices)
    rows = suffix_cases()
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup_report(with_clashes(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = expected_suffix([t for _, t, _ in rows], 200)
    assert [got[i] for i, _, _ in rows] == want
    assert sum(w[1] for w in want) > 5000


def test_suffix_dedup_of_repeated_rows_and_null_ids(spark):
    text = "".join(random.Random(3).choices("abc ", k=500))
    rows = [(1, text, None)] * 3 + [(None, text[100:420], None), (None, None, None), (2, "short", None)]
    got = bag(suffix_dedup.suffix_dedup_report(spark.createDataFrame(rows, SCHEMA)))
    none = hashlib.sha256(b"").hexdigest()
    assert got[(1, 500, 500, 1, none)] == 3 and got[(None, 320, 320, 1, none)] == 1 and got[(None, 0, 0, 0, none)] == 1
    assert suffix_dedup.suffix_dedup_report(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("group_slices", [512, 1])
def test_first_copies_stay(spark, group_slices):
    rows = suffix_cases()
    df = spark.createDataFrame(rows, SCHEMA).select(F.col("doc_id").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = defaultdict(list)
    for r in suffix_dedup.repeated_spans(df, keep_first=True, group_slices=group_slices).collect():
        spans[r.key].append({"start": r.start, "end": r.end})
    for (i, t, _), (_, removed, runs, sha) in zip(rows, expected_suffix([t for _, t, _ in rows], 200, True)):
        got = suffix_dedup._removed((t or "").encode(), spans[i])
        assert (got[0], got[1], hashlib.sha256(got[2]).hexdigest()) == (removed, runs, sha), i


@pytest.mark.parametrize("group_slices", [512, 1])
@pytest.mark.parametrize("shared_id", [None, 7])
def test_one_id_and_one_offset_but_two_texts(spark, monkeypatch, shared_id, group_slices):
    monkeypatch.setattr(suffix_dedup, "GROUP_SLICES", group_slices)
    rnd = random.Random(5)
    header, *ends = ("".join(rnd.choices("abcdefgh ", k=n)) for n in (300, 400, 90, 250))
    texts = [header + e for e in ends]
    rows = [(shared_id, t, None) for t in texts[:2]]
    got = bag(suffix_dedup.suffix_dedup_report(spark.createDataFrame(rows, SCHEMA)))
    assert got == Counter((shared_id, *w) for w in expected_suffix(texts[:2], 200))
    assert sorted(k[2] for k in got) == [300, 300]

    keyed = [(k, shared_id, t) for k, t in enumerate(texts)]  # the first of them, by key, stays
    df = spark.createDataFrame(keyed, "key long, doc_id long, text string")
    spans = defaultdict(list)
    for r in suffix_dedup.repeated_spans(df, keep_first=True, group_slices=group_slices).collect():
        spans[r.key].append({"start": r.start, "end": r.end})
    assert [suffix_dedup._removed(t.encode(), spans[k])[0] for k, t in enumerate(texts)] == [0, 300, 300]


def test_long_text_in_segments(monkeypatch):
    data = np.frombuffer("".join(random.Random(9).choices("abcd", k=5000)).encode(), np.uint8)
    whole = suffix_dedup.anchor_runs(data, np.array([0, len(data)]), 50, 8)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 700)
    parts = suffix_dedup.anchor_runs(data, np.array([0, len(data)]), 50, 8)

    def covered(runs):
        return sorted((s + k, h) for _, s, n, h, *_ in zip(*(x.tolist() for x in runs)) for k in range(n))

    assert covered(parts) == covered(whole) and len(covered(whole)) == 4951


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab"), min_size=60, max_size=200))
def test_ranks_are_suffix_order(text):
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(len(data) - 19)
    rank, levels = suffix_dedup.suffix_ranks(data, starts, 20)
    assert [depth for depth, _ in levels] == [8, 16]
    by_text = sorted(range(len(starts)), key=lambda i: text[i : i + 20])
    order = {text[i : i + 20]: k for k, i in enumerate(by_text)}
    for a in range(len(starts) - 1):
        x, y = text[a : a + 20], text[a + 1 : a + 21]
        assert (rank[a] < rank[a + 1]) == (x < y) and (rank[a] == rank[a + 1]) == (x == y) and order


def shared_prefix(x, y):
    return next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab"), min_size=40, max_size=160), st.sampled_from([8, 13, 20, 33]), st.integers(0, 3))
def test_longest_factors(text, length, seed):
    """Longest previous and next factors of every suffix, of positions in text
    order and of shuffled ones with ties, against all pairs."""
    data, n = np.frombuffer(text.encode(), np.uint8), len(text) - length + 1
    position = np.arange(n) if not seed else np.random.default_rng(seed).integers(0, n, n)
    earlier, later = suffix_dedup.factor_matches(data, np.arange(n), position, length)
    cut = [text[i : i + length] for i in range(n)]
    for a in range(n):
        assert earlier[a] == max((shared_prefix(cut[a], cut[b]) for b in range(n) if position[b] < position[a]), default=0)
        assert later[a] == max((shared_prefix(cut[a], cut[b]) for b in range(n) if position[b] > position[a]), default=0)


def test_spans_of_a_row_that_repeats(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choices("abcdefgh ", k=900))
    rows = [(1, text, None)] * 3000 + [(2, text[200:700] + "other end", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    keyed = df.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    per_key = suffix_dedup.merged_spans(keyed).collect()
    assert len(per_key) == 2 and max(len(r.spans) for r in per_key) < 50
    got = bag(suffix_dedup.suffix_dedup_report(df))
    assert got[(1, 900, 900, 1, hashlib.sha256(b"").hexdigest())] == 3000 and len(got) == 2


def test_slices_are_told_apart_by_two_hashes():
    rnd = np.random.default_rng(3)
    data = np.concatenate([rnd.integers(97, 100, 600), rnd.integers(97, 100, 600)]).astype(np.uint8)
    data[300:900] = data[0:600]
    runs = list(zip(*(x.tolist() for x in suffix_dedup.anchor_runs(data, np.array([0, len(data)]), 50, 8))))
    raw = data.tobytes()
    by_hash, by_bytes = {}, {}
    for _, start, n, _, sh, sh2 in runs:
        by_bytes.setdefault(raw[start : start + n + 49], set()).update({("1", sh), ("2", sh2)})
        by_hash.setdefault(sh2, set()).add(raw[start : start + n + 49])
    assert all(len(v) == 2 for v in by_bytes.values()) and all(len(v) == 1 for v in by_hash.values())
    assert len(by_bytes) < len(runs)


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def expected_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _, _) in enumerate(rows):
        r = find(a)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return Counter((i, len(sets[a]), least.get(find(a))) for a, (i, _, _) in enumerate(rows))


def near_copies(seed, n):
    rnd = random.Random(seed)
    base = prose(rnd, "en", 160).split(" ")
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rnd.randrange(0, 6)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(words), None))
    return rows


def test_ngram_join(spark):
    rows = corpus(7, 90) + near_copies(1, 60) + [(5000 + k, "one two three four five " * 3 + "x" * k, None) for k in range(6)]
    rows += [(6000, "Only three words", None), (6001, "only\tTHREE\nwords", None), (6002, "only three words here", None)]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    assert bag(ngram_join.link_components(df).drop("key")) == expected_components(rows)


def test_chains_of_links(spark):
    """Each links with the next only, and the ends are far apart."""
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**9)}" for _ in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60]), None) for k in range(100)]
    want = expected_components(rows)
    assert bag(ngram_join.link_components(spark.createDataFrame(rows, SCHEMA)).drop("key")) == want
    assert {c for _, _, c in want} == {0}


@pytest.mark.parametrize("bits", [0, 20])
def test_result_does_not_rest_on_the_sketch(spark, monkeypatch, bits):
    if not bits:
        monkeypatch.setattr(ngram_join, "rarity_sketch", lambda docs, words: np.zeros(1 << ngram_join.SKETCH_BITS, np.uint32))
    rows = corpus(11, 40) + near_copies(5, 25)
    assert bag(ngram_join.link_components(spark.createDataFrame(rows, SCHEMA)).drop("key")) == expected_components(rows)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.link_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, None), (2, "", None), (2, " \n", None)]
    assert bag(ngram_join.link_components(spark.createDataFrame(rows, SCHEMA)).drop("key")) == expected_components(rows)


def test_salted_join_repeats_for_salts_that_occur_only(spark):
    rows = [(k % 500, k) for k in range(1000)] + [(1000, k) for k in range(400)] + [(None, 1), (2000, None)]
    left = spark.createDataFrame(rows, "k long, by long")
    right = left.groupBy("k").agg(F.count("*").alias("n"), salts_met("by").alias("met"))
    repeated = Counter(r.k for r in salted_right(right, met="met").collect())
    assert all(1 <= repeated[k] <= 2 for k in range(500)) and repeated[1000] == SALTS and repeated[2000] == 1
    want = Counter((k, by, 400 if k == 1000 else 1 if k == 2000 else 2) for k, by in rows if k is not None)
    assert bag(salted_join(left, right, ["k"], "by", "inner", met="met").select("k", "by", "n")) == want
    assert bag(salted_join(left, right, ["k"], "by", "left_semi", met="met")) == Counter(r for r in rows if r[0] is not None)


def test_ngram_join_holds_no_table_that_is_read(spark, monkeypatch):
    """Prefixes, a fifth of all shingles, and the shared shingles go before the
    rounds; joins to prefix shingles repeat no row for salts that don't occur."""
    live, seen, joins = set(), [], []
    materialize, discard, join = ngram_join.materialize, ngram_join.discard, ngram_join.salted_join

    def kept(df, name):
        out = materialize(df, name)
        live.add(out._written)
        seen.append((name, {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in live}))
        return out

    def gone(*tables):
        discard(*tables)
        live.difference_update(getattr(t, "_written", None) for t in tables)

    def joined(left, right, keys, *args, **more):
        if keys[0] == "token":
            joins.append(more.get("met"))
        return join(left, right, keys, *args, **more)

    for name, f in (("materialize", kept), ("discard", gone), ("salted_join", joined)):
        monkeypatch.setattr(ngram_join, name, f)
    rows = corpus(3, 30) + near_copies(2, 12)
    assert bag(ngram_join.link_components(spark.createDataFrame(rows, SCHEMA)).drop("key")) == expected_components(rows)
    assert joins and all(joins)
    rounds = [held for name, held in seen if name == "best-hubs"]
    assert rounds and not any(held & {"prefixes", "shared-shingles"} for held in rounds)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    edges += [(900, k) for k in range(901, 960)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    want = {x: find(x) for x in up}
    assert dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect())) == want
