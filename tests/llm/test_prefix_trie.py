"""The prefix trie against a dictionary of prefixes, and the radix tree against sorted keys."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import workers  # noqa: F401  (a fixture)
from pyspark.sql import functions as F

from vsframe.llm import prefix_trie as pt
from vsframe.llm.radix_tree import INDEXED, SMALL, SORTED, RadixTree

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """Sequences of (role, text) by conversation."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def expected(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in members:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(held) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, held in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if sequences[c] == path))
        up = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(held), len(path), up, len(held), kids.get(path, 0), leaves[path], saved[path], digest))
    return sorted(out, key=lambda r: r[:2])


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def conversations(seed, n, turns=6, words=3):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-250, 5 * n), n):
        for t in range(rnd.randrange(1, turns)):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["", None, "été", "hi there"][:words])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 7, 40, 1 << 15])
def test_against_dictionary(spark, monkeypatch, block):
    rows = conversations(block, 150)
    rows += [(c, t, "user", f"common {t}") for c in range(2000, 2120) for t in range(4)]
    rows += [(None, 1, "user", "no id"), (3000, None, None, None), (3000, None, "user", "x"), (3000, 2, "user", "x"), (3000, 2, "user", "x")]
    rows += [(4000, t, "user", f"long {t}") for t in range(60)] + [(4001, t, "user", f"long {t}") for t in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("ids", "key", "digest", "size", "node", "h")})
    work = pt._tries

    def small(batches):
        pt.BLOCK_TURNS = block  # in the worker
        yield from work(batches)

    monkeypatch.setattr(pt, "_tries", small)
    got = pt.conversation_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found(got) == expected(rebuilt(rows))


def test_digests_of_many_equal_conversations(spark, monkeypatch):
    work = pt._joined_ids

    def small(batches):
        pt.IDS_BYTES = 200
        yield from work(batches)

    monkeypatch.setattr(pt, "_joined_ids", small)
    rows = [(c, 0, "user", "same") for c in range(0, 70_000, 100)]
    assert found(pt.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == expected(rebuilt(rows))


def test_empty_and_turnless(spark):
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(c, 0, "user", "gone") for c in range(101, 130)]  # no conversation 100 to begin with
    got = found(pt.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == expected(rebuilt(rows)) and got[0][:4] == (101, 0, None, 29)


def walk(tree):
    """Keys and values of a tree, from its edges."""
    path, out = [], []
    for edge, node, above in tree.walk():
        del path[above:]
        path.append(edge)
        if node.value is not None:
            out.append((b"".join(path), node.value))
        held = len([k for _, k in node.children()])
        assert held <= node.layout and (node.layout == SMALL or held > {SORTED: SMALL, INDEXED: SORTED, 256: INDEXED}[node.layout])
        assert held != 1 or node.value is not None or above == 0  # compressed
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6)))
def test_radix_tree(keys):
    tree = RadixTree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    assert walk(tree) == sorted({k: i for i, k in enumerate(keys)}.items())


def test_radix_tree_layouts():
    rnd = random.Random(1)
    keys = [bytes([rnd.randrange(256) if i % 3 else 7, rnd.randrange(60), rnd.randrange(20), 5, rnd.randrange(5)]) for i in range(9000)]
    tree = RadixTree()
    for key in keys:
        tree.insert(key, key)
    assert walk(tree) == sorted({k: k for k in keys}.items())
    assert {node.layout for _, node, _ in tree.walk()} == {SMALL, SORTED, INDEXED, 256}
