"""N-gram Jaccard self-join by grouped prefixes, and its linked groups.

A document's set holds its distinct word shingles; two documents link when the
Jaccard similarity of their sets reaches a threshold, exactly. Under one global
order of shingles, two sets that link share a shingle among the first
``size - ceil(t * size) + 1`` of each, its prefix. Rare shingles come first, so
that common passages rarely meet in prefixes; rarity comes from a fixed-size
count sketch of all shingles of all documents, and only the order, never the
result, rests on it.

1. Documents with equal sets are one node; nodes with equal prefixes and size
   are one group. Groups, not documents, send their prefix shingles, each with
   its position. Shingles in one prefix only cannot link and go.
2. Rounds of representatives. For each shingle and size class the group whose
   post comes soonest in its own prefix is the hub. Every component is paired with
   the hub of another that it shares most shingles with, every node, at first,
   with its group's least node: a pair a node and round, which members verify on
   whole sets. Links make components, which the next round takes for its own.
   Rounds end with one that links few.
3. What is left is joined in full: pairs of groups that share a prefix shingle
   and are not of one component, cut by size, by position, and by parity
   sketches in the join itself, so that a pair comes from its first common shingle
   and seldom from others. Pairs of groups then expand to members of different
   components, which are verified. A large group of near copies is one component
   by then, and its pairs are never made. Components are exact, but links within
   one are not all found, so neither links nor their number come back.

Texts are cut at ASCII white space after lower-casing A-Z. With fewer words
than a shingle has, the whole sequence is the one shingle; without words (null
or empty text) the set is empty and links with nothing, equal texts included.
Rows that share an id are nodes by their texts; null ids link like others, and
a component's id is null only if all its ids are. Long texts are shingled whole;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vsframe.llm.common import (
    RollingHash,
    Steps,
    discard,
    key_filter,
    lower_bytes,
    materialize,
    mix64,
    passes,
    row_chunks,
    salted_join,
    salts_met,
    text_chunks,
    utf8,
    word_spans,
)
from vsframe.llm.components import components

SHINGLE_WORDS = 5
#: Similarity threshold, a percentage, so that comparisons are of integers.
PERCENT = 80
#: Cells of the rarity sketch, and of one of its blocks.
SKETCH_BITS, BLOCK_BITS = 22, 14
#: Bits of a node's parity sketch, in longs.
PARITY_LONGS = 16
#: Sizes within a factor of 1 / threshold are one class; a group looks for hubs
#: in its own class. Steps of a post's relative position, to compare hubs by.
POSITION_STEPS = 1 << 20
#: A round that links no more than one in so many nodes is the last; pairs that
#: further rounds would find are then found by the full join.
FEW = 200
_MULTIPLIERS = mix64(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data = lower_bytes(data)
    starts, ends, counts = word_spans(data, offsets)
    hashes = RollingHash(data).slices(starts, ends)
    first = np.cumsum(counts) - counts
    full = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        full += hashes[j : j + len(full)] * _MULTIPLIERS[j]
    full = mix64(full)
    out = []
    for at, n in zip(first.tolist(), counts.tolist()):
        if n >= words:
            out.append(np.unique(full[at : at + n - words + 1]))
        elif n:
            with np.errstate(over="ignore"):
                out.append(mix64((hashes[at : at + n] * _MULTIPLIERS[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return int(mix64(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


def _parities(shingles: np.ndarray) -> np.ndarray:
    """Parities of the counts of a set's shingles in 1024 hash classes.

    Two sets' parities differ in at most as many classes as their symmetric
    difference has shingles, so many differences rule a link out for certain.
    """
    bits = PARITY_LONGS * 64
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix_size(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def rarity_sketch(docs: DataFrame, words: int) -> np.ndarray:
    """Counts of all shingles of all rows, by the top bits of their hashes.

    Tasks send compressed blocks of their counts, which are summed per block;
    the sum, 16 MiB whatever the input, goes to every task of the next step.
    """
    cells = 1 << BLOCK_BITS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for _, data, offsets in text_chunks(batches):
            sets = shingle_sets(data, offsets, words)
            if sets:
                at = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                cell, n = np.unique(at, return_counts=True)  # no temporary of the sketch's size
                counts[cell] += n.astype(np.uint32)
        blocks = counts.reshape(-1, cells)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in some], pa.binary())],
            ["block", "counts"],
        )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(counts), np.uint32)
                sums[block] = sums.get(block, np.zeros(cells, np.uint64)) + got
        packed = [np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    out = np.zeros((1 << SKETCH_BITS - BLOCK_BITS, cells), np.uint32)
    for row in docs.select("text").mapInArrow(partial, schema).repartition("block").mapInArrow(total, schema).collect():
        out[row.block] = np.frombuffer(row.counts, np.uint32)
    return out.ravel()


def prefixes(docs: DataFrame, sketch: np.ndarray, words: int, percent: int, steps: Steps) -> DataFrame:
    """(key, doc_id, node, size, grp, parity, prefix) of every row of ``docs``
    (key, doc_id, text); grp hashes prefix and size. A group's prefix stands in the
    first of its rows that a task meets, and is null in the others.
    """
    sent = steps.send(sketch)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, data, offsets in text_chunks(batches):
            nodes, sizes, groups, parities, parts = [], [], [], [], []
            for s in shingle_sets(data, offsets, words):
                counts = sent.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                prefix = s[np.argsort(counts, kind="stable")][: _prefix_size(len(s), percent)] if len(s) else s
                group = _node(np.append(prefix, np.uint64(len(s))))
                nodes.append(_node(s))
                sizes.append(len(s))
                groups.append(group)
                parities.append(_parities(s))
                parts.append(None if group in seen else prefix.view(np.int64))
                seen.add(group)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.array(groups, pa.int64()),
                    pa.array(parities, pa.list_(pa.int64())),
                    pa.array(parts, pa.list_(pa.int64())),
                ],
                ["key", "doc_id", "node", "size", "grp", "parity", "prefix"],
            )

    return docs.mapInArrow(
        work, "key long, doc_id long, node long, size int, grp long, parity array<long>, prefix array<long>"
    )


def prefix_posts(rows: DataFrame, steps: Steps) -> DataFrame:
    """(token, grp, size, pos), written, for the prefix shingles that several groups have.

    Counts of a shingle combine before their shuffle (a group counts once a
    task, so a group of copies may pass for several; its posts then pair with
    nothing). A filter of bounded size spares most other shingles the join
    that selects exactly; repeats of a post go last.
    """
    rows = rows.where("size > 0 AND prefix IS NOT NULL").select("grp", "size", "prefix")
    shared = materialize(
        rows.select(F.explode("prefix").alias("token"), "grp")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), salts_met("grp").alias("met"))
        .where("n > 1")
        .select("token", "met"),
        "shared-shingles",
    )
    steps.end()
    sent = steps.send(key_filter(shared.select("token")))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            token = lists.flatten().to_numpy()
            n = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            some = passes(sent.value, token)
            row = row[some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(token[some]),
                    pa.array(batch.column(0).to_numpy()[row]),
                    pa.array(batch.column(1).to_numpy()[row]),
                    pa.array(pos[some], pa.int32()),
                ],
                ["token", "grp", "size", "pos"],
            )

    likely = rows.mapInArrow(post, "token long, grp long, size int, pos int")
    posts = materialize(salted_join(likely, shared, ["token"], "grp", "left_semi", met="met").distinct(), "prefix-posts")
    steps.end()
    discard(shared)
    return posts


def _wanted_texts(docs: DataFrame, heads: DataFrame, pairs: DataFrame, steps: Steps) -> DataFrame:
    """(node, text) for the nodes in ``pairs``, each read from one of its rows.

    A filter of bounded size spares other texts the shuffle; what it lets
    through in excess finds no node in the join.
    """
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(heads.select("node", "key").join(ids, "node", "left_semi"), "wanted-nodes")
    sent = steps.send(key_filter(wanted.select("key")))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a row that repeats goes once a task
        for batch in batches:
            keys = batch.column(0).to_numpy()
            likely = passes(sent.value, keys)
            for i in np.flatnonzero(likely).tolist():
                likely[i] = int(keys[i]) not in seen
                seen.add(int(keys[i]))
            yield batch.filter(pa.array(likely))

    rows = docs.select("key", "text")
    texts = materialize(rows.mapInArrow(screen, rows.schema).join(wanted, "key").select("node", "text"), "wanted-texts")
    discard(wanted)
    return texts


def _attach(pairs: DataFrame, table: DataFrame, columns: list[str], side: str, other: str) -> DataFrame:
    """``pairs`` with ``columns`` of its ``side``'s node. A node in many pairs is
    salted by the other side, its row repeated for the salts that occur only."""
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64(other, F.lit(3)), F.lit(64)))
    keys = salted.select(side, "_salt").distinct()
    named = [F.col(c).alias(f"{c}_{side}") for c in columns]
    found = keys.join(table.select(F.col("node").alias(side), *named), side)
    return salted.join(found, [side, "_salt"]).drop("_salt")


def sieve(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parities don't rule out; loses no link."""
    columns = ["size", "parity"]
    full = _attach(_attach(pairs, heads, columns, "a", "b"), heads, columns, "b", "a")
    differ = F.aggregate(
        F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x
    )
    total = F.col("size_a") + F.col("size_b")
    near = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    return full.where(near & ((100 + percent) * differ <= (100 - percent) * total)).select("a", "b")


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) of ``pairs`` (a, b) whose whole sets link; sets are
    made from the texts again, which are a fraction of their size."""

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = utf8(column)
        for lo, hi in row_chunks(offsets):
            yield from shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    full = _attach(_attach(pairs, texts, ["text"], "a", "b"), texts, ["text"], "b", "a")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(work, "u long, v long")


def row_key() -> Column:
    """A hash of a row's id and text; rows without text and with an empty one agree."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _group_components(heads: DataFrame, found: DataFrame | None) -> DataFrame:
    """(grp, x, node, y, members): each group's least component, a node of it,
    its greatest component if that is another, and its number of nodes."""
    named = heads if found is None else heads.join(found, "node", "left")
    own = F.col("node") if found is None else F.coalesce("component", "node")
    grouped = named.select("grp", "node", own.alias("c")).groupBy("grp")
    return grouped.agg(F.min(F.struct("c", "node")).alias("least"), F.max("c").alias("y"), F.count(F.lit(1)).alias("members")).select(
        "grp",
        F.col("least.c").alias("x"),
        F.col("least.node").alias("node"),
        F.when(F.col("y") != F.col("least.c"), F.col("y")).alias("y"),
        "members",
    )


def _open_posts(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """``posts`` with their groups' components x and y, those whose shingle
    several components have."""
    named = posts.join(groups.select("grp", "x", "y"), "grp")
    span = [F.min("x").alias("lo"), F.max(F.coalesce("y", "x")).alias("hi"), salts_met("grp").alias("met")]
    mixed = named.groupBy("token").agg(*span).where("lo <> hi").select("token", "met")
    return salted_join(named, mixed, ["token"], "grp", "left_semi", met="met")


def hub_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """(x, g, h): for each component x, its group g and the hub h of another
    component that share most shingles.

    ``posts``: token, grp, size, pos, x. A hub is the post of a shingle and size
    class that comes first in its own prefix: what precedes it there is in no
    common set, so the sooner it comes, the more others may link with it. Hubs
    combine before their shuffle, and the join to a hot shingle's is salted.
    """
    by_size = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100 / percent)))
    place = F.floor(F.col("pos").cast("long") * F.lit(POSITION_STEPS) / F.col("size"))
    classed = posts.select("token", "grp", "x", by_size.alias("class"), place.alias("place"))
    first = F.min(F.struct("place", F.col("grp").alias("h"), F.col("x").alias("of")))
    hubs = classed.groupBy("token", "class").agg(first.alias("hub"), salts_met("grp").alias("met"))
    hubs = hubs.select("token", "class", F.col("hub.h").alias("h"), F.col("hub.of").alias("of"), "met")
    met = salted_join(classed.drop("place"), hubs, ["token", "class"], "grp", "inner", met="met").where("x <> of")
    votes = met.groupBy("x", F.col("grp").alias("g"), "h").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("x").agg(F.max_by(F.struct("g", "h"), F.struct("n", "g", "h")).alias("best"))
    return best.select("x", "best.*")


def open_group_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """(g, h): pairs of groups that may hold linked nodes of different components.

    ``posts``: token, grp, size, pos, x, y (the least component, and another if
    there is one) and parity (null for groups of several nodes). Sets that share nothing before
    the shingle at positions i and j have at most the rest of each in common; this
    holds at their first common shingle, where a pair that may link passes.
    """
    p, q = posts.alias("p"), posts.alias("q")
    total = F.col("p.size") + F.col("q.size")
    most = F.least(F.col("p.size") - F.col("p.pos"), F.col("q.size") - F.col("q.pos"))
    one = F.col("p.y").isNull() & F.col("q.y").isNull() & (F.col("p.x") == F.col("q.x"))
    differ = sum(
        (F.bit_count(F.col("p.parity")[k].bitwiseXOR(F.col("q.parity")[k])) for k in range(PARITY_LONGS)), F.lit(0)
    )
    return (
        p.join(q, F.col("p.token") == F.col("q.token"))
        .where((F.col("p.grp") < F.col("q.grp")) & ~one & ((100 + percent) * most >= percent * total))
        .where(F.coalesce((100 + percent) * differ <= (100 - percent) * total, F.lit(True)))
        .where(100 * F.least("p.size", "q.size") >= percent * F.greatest("p.size", "q.size"))
        .select(F.col("p.grp").alias("g"), F.col("q.grp").alias("h"))
        .distinct()
    )


def _expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): nodes of different components for each pair of groups (g, h);
    ``members``: grp, node, component."""
    left = members.select(F.col("grp").alias("g"), F.col("node").alias("m"), F.col("component").alias("c"))
    right = members.select(F.col("grp").alias("h"), F.col("node").alias("o"), F.col("component").alias("d"))
    both = pairs.join(left, "g").join(right, "h").where("c <> d")
    return both.select(F.least("m", "o").alias("a"), F.greatest("m", "o").alias("b"))


def link_components(
    docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, component: str | None = None
) -> DataFrame:
    """(key, doc_id, n_shingles, component_id) for every row of ``docs``
    (doc_id, text); key is ``row_key``. ``component`` names one more column, that
    tells components apart whose ids are null or shared; null without words."""
    docs = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    steps = Steps(docs.sparkSession)
    rows = materialize(prefixes(docs, rarity_sketch(docs, words), words, percent, steps), "prefixes")
    steps.end()
    heads = materialize(
        rows.where("size > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), *(F.max(c).alias(c) for c in ("size", "grp", "parity"))),
        "nodes",
    )
    posts = prefix_posts(rows, steps)
    prefixed, rows = rows, materialize(rows.select("key", "doc_id", "node", "size"), "rows")
    discard(prefixed)  # a prefix is a fifth of its set

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose whole sets link."""
        tried = materialize(sieve(pairs, heads, percent), "pairs")
        texts = _wanted_texts(docs, heads, tried, steps)
        out = materialize(verify(tried, texts, words, percent), "links")
        steps.end()
        discard(tried, texts)
        return out

    def stars(found: DataFrame) -> DataFrame:
        return found.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))

    # rounds of representatives
    nodes = heads.count()
    groups = materialize(_group_components(heads, None), "groups")
    several = groups.where("members > 1").select("grp", F.col("node").alias("a"))
    inside = salted_join(heads.select("grp", F.col("node").alias("b")), several, ["grp"], "b", "inner").where("a <> b").select("a", "b")
    named, found, tried = posts.withColumn("x", F.col("grp")), None, []
    while True:
        best = materialize(hub_pairs(named, percent), "best-hubs")
        steps.end()
        node = groups.select("grp", "node")
        met = best.join(node.select(F.col("grp").alias("g"), F.col("node").alias("m")), "g").join(
            node.select(F.col("grp").alias("h"), F.col("node").alias("o")), "h"
        )
        pairs = met.select(F.least("m", "o").alias("a"), F.greatest("m", "o").alias("b"))
        pairs = (pairs if tried else pairs.unionByName(inside)).distinct()
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        tried.append(materialize(pairs, "hub-pairs"))
        new = linked(tried[-1])
        links = new.count()
        if links:
            was, found = found, materialize(components(new if found is None else stars(found).unionByName(new)), "components")
            discard(was)
        discard(best)
        few = links * FEW <= nodes
        if few and len(tried) > 1:
            break  # the posts' components of the round before are right, if not the fewest
        discard(groups, named)
        groups = materialize(_group_components(heads, found), "groups")
        named = materialize(_open_posts(posts, groups), "open-posts")
        steps.end()
        if few:
            break

    # all pairs between different components
    label = F.col("node") if found is None else F.coalesce("component", "node")
    own = heads if found is None else heads.join(found, "node", "left")
    labelled = materialize(own.select("node", "grp", label.alias("component"), "parity"), "labelled-nodes")
    single = groups.where("members = 1").select("grp").join(labelled.select("grp", "parity"), "grp")
    carried = materialize(named.select("token", "grp", "size", "pos", "x", "y").join(single, "grp", "left"), "posts-with-parities")
    across = materialize(open_group_pairs(carried, percent), "group-pairs")
    steps.end()
    discard(named, carried, posts)
    # a group with nodes in several components makes a pair with itself
    itself = groups.where("y IS NOT NULL").select(F.col("grp").alias("g"), F.col("grp").alias("h"))
    rest = _expanded(across.unionByName(itself), labelled).distinct()
    for before in tried:
        rest = rest.join(before, ["a", "b"], "left_anti")
    more = linked(rest)
    discard(labelled, groups, across, *tried)
    final = components(more if found is None else stars(found).unionByName(more))

    named = heads.join(final, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    more_columns = [] if component is None else [F.col("component").alias(component)]
    of_node = salted_join(named, ids, ["component"], "node", "inner").select("node", "component_id", *more_columns)
    return salted_join(rows.select("key", "doc_id", "node", "size"), of_node, ["node"], "key", "left").select(
        "key",
        "doc_id",
        F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        *([] if component is None else [F.col(component)]),
    )
