"""The trie of all prefixes of conversations, by adaptive radix trees.

Each distinct turn (role and text) gets a number, and a conversation is the run
of its turns' numbers as 8-byte big-endian integers: one byte string. Equal
strings collapse first, whatever their number. The distinct ones are range
partitioned and sorted; a task cuts its range into blocks of bounded size, builds a
radix tree of each and reads the trie off it: only byte depths that are a whole
number of turns are trie nodes.

Blocks are ranges of sorted keys, so a node that several blocks hold is a prefix
of the first or last key of each of them: it lies on the block's border. Nodes
within the borders are final. Border nodes (two paths a block) go by a digest of
their path, and meet twice: for their members and children, then for the sums
over their subtrees, to which each block adds what it holds and the border nodes
that begin in it. So a first turn that any share of the conversations has is
spread over as many blocks as its conversations fill.

The digest of the conversations that end at a node is a hash of all their ids
in order. Ids are sorted by range over tasks, joined to texts of bounded size
there, and only these texts meet in one task a key, which hashes them as they come.

Nulls: a null turn number comes first, a null role or text is empty, rows with a
null conv_id belong to no conversation. Turns of one number are ordered by
their SHA-256. Repeated rows are turns of their own. Empty texts are turns of no
code points; long texts never leave the first step, which keeps their digest and
length. A conversation's turn numbers, 8 bytes a turn, are one value. An empty
table gives no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vsframe.llm.common import materialize, salted_join
from vsframe.llm.radix_tree import RadixTree

#: Turns (keys' lengths, summed) of one block: bounds a radix tree.
BLOCK_TURNS = 1 << 15
#: Bytes of ids joined to one text.
IDS_BYTES = 1 << 16
WIDTH = 8
_ROOT = hashlib.blake2b(b"", digest_size=16).digest()
#: Where a border node lies: on both borders of its block, the first's, the last's.
_BOTH, _FIRST, _LAST = 0, 1, 2
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a role and a text, null as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): each conversation's turns in order, as numbers of
    distinct turns and code points of their texts."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("size"),
    )
    turns = materialize(turns, "turns")
    numbered = turns.groupBy("digest").agg(F.min("size").alias("_size")).drop("_size")
    numbers = materialize(numbered.withColumn("id", F.monotonically_increasing_id()), "turn-numbers")
    row = F.struct("turn", "digest", "id", "size")
    runs = salted_join(turns, numbers, ["digest"], "conv_id", "inner").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    return materialize(runs.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes")), "turn-sequences")


def share_heads(sequences: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % every
    (all if it has fewer, none if there is none), then its own turns after its
    first h; h is the unsigned crc32 of c in decimal, modulo ``heads``.

    The first turns, fewer than ``heads``, of one conversation in ``every`` meet the others.
    """
    first = sequences.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("head"), *(F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in ("ids", "sizes"))
    )
    keyed = sequences.withColumns(
        {"head": F.col("conv_id") - F.col("conv_id") % every, "h": (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")}
    )

    def rebuilt(name: str) -> Column:
        empty = F.array().cast(sequences.schema[name].dataType)
        return F.concat(
            F.slice(F.coalesce(f"head_{name}", empty), F.lit(1), F.col("h")), F.slice(name, F.col("h") + 1, F.size(name))
        ).alias(name)

    return keyed.join(first, "head", "left").select("conv_id", rebuilt("ids"), rebuilt("sizes"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (kd, conv_id) as texts of bounded size: kd, first id, ids, text."""
    kd, ids, size = None, [], 0

    def out() -> pa.RecordBatch:
        columns = [pa.array([kd], pa.binary()), pa.array([ids[0]]), pa.array([len(ids)]), pa.array([",".join(map(str, ids))])]
        return pa.RecordBatch.from_arrays(columns, ["kd", "first", "n", "text"])

    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != kd or size > IDS_BYTES:
                if ids:
                    yield out()
                kd, ids, size = key, [], 0
            ids.append(conv)
            size += 20
    if ids:
        yield out()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts of ids, hashed as they come: kd, conv_id (the least), n, ends."""
    now, done = None, []

    def out() -> pa.RecordBatch:
        rows = [(kd, first, n, digest.hexdigest()) for kd, first, n, digest in done]
        types = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["kd", "conv_id", "n", "ends"])

    for batch in batches:
        for kd, first, n, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now is not None and now[0] == kd:
                now[2] += n
                now[3].update(b"," + text.encode())
            else:
                now = [kd, first, n, hashlib.sha256(text.encode())]
                done.append(now)
        if len(done) > 10_000:
            now = done.pop()
            yield out()
            done = [now]
    if done:
        yield out()


def _distinct_keys(sequences: DataFrame) -> DataFrame:
    """(key, sizes, conv_id, n, ends) of each distinct sequence."""
    key = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 2 * WIDTH, "0")), ""))
    keyed = sequences.select("conv_id", key.alias("key"), "sizes").withColumn("kd", F.unhex(F.sha2("key", 256)))
    keyed = materialize(keyed, "conversation-keys")
    ids = keyed.select("kd", "conv_id").repartitionByRange("kd", "conv_id").sortWithinPartitions("kd", "conv_id")
    texts = ids.mapInArrow(_joined_ids, "kd binary, first long, n long, text string")
    texts = texts.repartition("kd").sortWithinPartitions("kd", "first")
    ends = texts.mapInArrow(_hashed_ids, "kd binary, conv_id long, n long, ends string")
    # copies of a key are equal, so any of them will do
    one = keyed.groupBy("kd").agg(F.first("key").alias("key"), F.first("sizes").alias("sizes"))
    return materialize(one.join(ends, "kd").select("key", "sizes", "conv_id", "n", "ends"), "distinct-keys")


_NODE = pa.schema(
    [
        ("block", pa.int64()),
        ("border", pa.int32()),
        ("node", pa.binary()),
        ("parent", pa.binary()),
        ("depth", pa.int64()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("size", pa.int64()),
        ("ends", pa.string()),
    ]
)
_NODE_DDL = (
    "block long, border int, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, size long, ends string"
)


def _path_digests(key: bytes) -> list[bytes]:
    """A digest of each turn-aligned prefix of a key, from the empty one."""
    out = [_ROOT]
    for at in range(0, len(key), WIDTH):
        out.append(hashlib.blake2b(out[-1] + key[at : at + WIDTH], digest_size=16).digest())
    return out


def block_nodes(keys: list[bytes], sizes: list[np.ndarray], ends: list[tuple[int, int, str]], block: int) -> pa.RecordBatch:
    """The trie nodes of a block of sorted distinct keys.

    ``sizes``: code points of each key's turns; ``ends``: (least conv_id,
    conversations, digest) of each key. A node within the borders has its final values
    (``parent`` is set where its parent lies on a border). A border node has
    members of this block, children and subtree sums of nodes within the borders.
    """
    tree = RadixTree()
    for k, key in enumerate(keys):
        tree.insert(key, k + 1)  # key k's value; 0 is not used
    ids = np.frombuffer(b"".join(keys), ">i8").astype(np.int64)
    known, where = np.unique(ids, return_index=True)
    points = np.concatenate([*sizes, np.zeros(0, np.int64)])[where]

    first, last = keys[0], keys[-1]
    turn, parent, depth, border, value = [-1], [-1], [0], [_BOTH], [0]
    path: list[tuple[int, bytes]] = []  # per radix node above: its last trie node, bytes since
    for edge, node, above in tree.walk():
        del path[above:]
        at, tail = path[-1] if path else (0, b"")
        tail += edge
        for lo in range(0, len(tail) - WIDTH + 1, WIDTH):
            own, d, on = tail[lo : lo + WIDTH], depth[at] + 1, border[at]
            if on is not None:
                on_first = on != _LAST and first[WIDTH * d - WIDTH : WIDTH * d] == own
                on_last = on != _FIRST and last[WIDTH * d - WIDTH : WIDTH * d] == own
                on = _BOTH if on_first and on_last else _FIRST if on_first else _LAST if on_last else None
            turn.append(int.from_bytes(own, signed=True))
            parent.append(at)
            depth.append(d)
            border.append(on)
            value.append(0)
            at = len(turn) - 1
        path.append((at, tail[len(tail) - len(tail) % WIDTH :]))
        if node.value:
            value[at] = node.value

    n = len(turn)
    size = [0, *points[np.searchsorted(known, turn[1:])].tolist()]
    convs, least, kids, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):  # children come after their parents
        if value[i]:
            conv, count, _ = ends[value[i] - 1]
            convs[i] += count
            least[i] = conv if least[i] is None else min(conv, least[i])
        up = parent[i]
        if border[i] is None:
            leaves[i] += not kids[i]
            saved[i] += (convs[i] - 1) * size[i]
            kids[up] += 1
        if up >= 0:
            convs[up] += convs[i]
            leaves[up] += leaves[i]
            saved[up] += saved[i]
            least[up] = least[i] if least[up] is None else min(least[i], least[up])

    digests = {_FIRST: _path_digests(first), _LAST: _path_digests(last)}
    digests[_BOTH] = digests[_FIRST]
    own = [None if b is None else digests[b][d] for b, d in zip(border, depth)]
    above = [own[p] if p >= 0 else None for p in parent]
    columns = [
        [block] * n,
        border,
        own,
        above,
        depth,
        least,
        [None if p < 0 or border[p] is not None else least[p] for p in parent],
        convs,
        kids,
        leaves,
        saved,
        size,
        [ends[v - 1][2] if v else None for v in value],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE)], schema=_NODE)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's sorted keys, one radix tree at a time."""
    task, count = TaskContext.get().partitionId(), 0
    keys, sizes, ends, turns = [], [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for key, size, conv, n, digest in zip(*(c.to_pylist() for c in part.columns)):
                if keys and turns + len(size) > BLOCK_TURNS:
                    yield block_nodes(keys, sizes, ends, (task << 32) + count)
                    keys, sizes, ends, turns, count = [], [], [], 0, count + 1
                keys.append(key)
                sizes.append(np.array(size, np.int64))
                ends.append((conv, n, digest))
                turns += len(size) + 1
    if keys:
        yield block_nodes(keys, sizes, ends, (task << 32) + count)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The trie of ``sequences`` (conv_id, ids, sizes; one row a conversation).

    One row per distinct prefix, the empty one included: conv_id (its smallest
    member), depth, parent_conv_id, n_convs (members), n_children, n_leaves
    (childless nodes of its subtree), saved_tokens (over its subtree, members
    but one times code points of the last turn), and ends_sha256 (of the
    conversations that it is, by id, comma-joined).
    """
    ordered = _distinct_keys(sequences).repartitionByRange("key").sortWithinPartitions("key")
    nodes = materialize(ordered.mapInArrow(_tries, _NODE_DDL), "trie-nodes")
    borders = nodes.where("border IS NOT NULL")

    # members and children of border nodes, over all blocks
    met = borders.groupBy("node", "parent").agg(
        F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"),
        F.max("size").alias("size"),
        F.max("ends").alias("ends"),
        F.min("block").alias("owner"),
    )
    met = materialize(met, "trie-borders")
    kids = met.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("outer"))
    met = met.join(kids, "node", "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0)))
    met = materialize(met.drop("inner", "outer"), "trie-border-nodes")

    # a border node adds itself to its ancestors in the block where it begins;
    # deeper nodes of the same path, or of both paths below a shared node, add up
    own = met.select("node", "owner", "n_children", (F.col("n_convs") - 1).alias("more"), F.col("size").alias("last"))
    held = borders.select("block", "border", "node", "depth", "n_leaves", "saved_tokens").join(own, "node")
    begins = F.col("owner") == F.col("block")
    held = held.withColumns(
        {
            "leaf": F.when(begins & (F.col("n_children") == 0), 1).otherwise(0),
            "saving": F.when(begins, F.col("more") * F.col("last")).otherwise(0),
        }
    )
    down = [F.col("depth").desc()]
    whole = Window.partitionBy("block").orderBy(*down).rangeBetween(Window.unboundedPreceding, 0)
    side = Window.partitionBy("block", "border").orderBy(*down).rangeBetween(Window.unboundedPreceding, 0)

    def below(name: str) -> Column:
        return F.when(F.col("border") == _BOTH, F.sum(name).over(whole)).otherwise(F.sum(name).over(side))

    held = held.withColumns({"n_leaves": F.col("n_leaves") + below("leaf"), "saved_tokens": F.col("saved_tokens") + below("saving")})
    sums = held.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    names = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    above = met.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
    inner = nodes.where("border IS NULL")
    edge = salted_join(inner.where("parent IS NOT NULL"), above, ["parent"], "conv_id", "inner")
    outer = met.join(sums, "node").join(above, "parent", "left").withColumn("parent_conv_id", F.col("up"))
    found = (
        inner.where("parent IS NULL").select(*names)
        .unionByName(edge.withColumn("parent_conv_id", F.col("up")).select(*names))
        .unionByName(outer.select(*names))
    )
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return prefix_trie(share_heads(turn_sequences(conversations)))
