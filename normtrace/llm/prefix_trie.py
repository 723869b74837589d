"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, a tree per range shard.

1. A turn is read as the SHA-256 of its role (after its length) and text. Distinct digests get ids from
   a written dictionary, so that from here on a turn is one long and texts stay where they were.
2. The turns of a conversation make one array of ids. Equal sequences are counted as one, with their
   smallest member; the digest over all members of a sequence comes from a sorted stream of them.
3. Distinct sequences are sorted over range shards, about ``SHARD_TURNS`` turns each. A shard inserts
   its sequences into a ternary search tree, medians first, so the tree is balanced whatever the order.
   One iterative traversal adds up members, leaves and savings from the bottom to the top.
4. Only nodes on the paths of the first and last sequence of a shard can be shared with other shards.
   They come out as partial rows and are merged in the order of the shards by a stack as deep as the
   longest path: two paths a shard, whatever their subtrees hold. All other nodes are final.

Defined results: rows without conv_id belong to no conversation; a null turn comes first, equal turns
follow each other by that digest; null roles and texts are empty; repeated rows are
turns of their own; an empty table gives no rows; other columns are ignored. The ids of one conversation
(8 bytes a turn, no texts) have to fit a row; any number of conversations may share a sequence or prefix.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtrace.llm.batches import record_batch
from normtrace.session import settle_packed

SHARD_TURNS = 1 << 17
GROUP = 5
HEADS = 9
CHUNK_BYTES = 1 << 16
ROWS_AT_ONCE = 1 << 12
NOTHING = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, digest, bytes)`` of every turn that belongs to a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def encoded(conversations: DataFrame) -> DataFrame:
    """``(conv_id, ids, bytes)``: every conversation's turns as ids in order, and the bytes of their texts.

    The dictionary has a row per distinct turn, counted on the map side; the join back is left to
    adaptive execution, which splits the partition of a turn that very many rows share.
    """
    turns = settle_packed(_turns(conversations), "turns")
    ids = settle_packed(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    placed = F.array_sort(F.collect_list(F.struct("turn", "digest", "id", "bytes")))
    lists = turns.join(ids, "digest").groupBy("conv_id").agg(placed.alias("t"))
    return lists.select("conv_id", F.col("t.id").alias("ids"), F.col("t.bytes").alias("bytes"))


def rebuilt(sequences: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """``sequences`` with the first turns of each replaced by those of the first conversation of its group.

    Conversation c takes h = crc32(c) mod ``heads`` turns (all, if fewer) of conversation c - c mod
    ``group``, and its own turns after its first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = sequences.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_first"), *[F.slice(c, 1, heads - 1).alias(f"_{c}") for c in ("ids", "bytes")])
    both = sequences.join(first, F.col("conv_id") - F.col("conv_id") % group == F.col("_first"), "left").withColumn("_h", h)

    def spliced(c: str) -> Column:
        none = F.array().cast("array<long>")
        own = F.slice(c, F.col("_h") + 1, F.greatest(F.size(c) - F.col("_h"), F.lit(0)))
        return F.concat(F.coalesce(F.slice(f"_{c}", F.lit(1), F.col("_h")), none), own).alias(c)

    return both.select("conv_id", spliced("ids"), spliced("bytes"))


def member_digests(members: DataFrame) -> DataFrame:
    """``(seq, sha)``: SHA-256 of the ascending conv_ids of ``members(seq, conv_id)``, joined by commas.

    Ids are sorted over all partitions and joined to chunks there, so that a sequence with very many
    members is spread; a digest then reads the chunks of its sequence in order, as a stream.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"seq": pa.int64(), "first": pa.int64(), "part": pa.string()}
        now, first, held, size = None, None, [], 0
        for batch in batches:
            out = []
            for seq, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seq != now or size > CHUNK_BYTES:
                    if held:
                        out.append((now, first, ",".join(held)))
                    now, first, held, size = seq, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield record_batch(types, out)
        if held:
            yield record_batch(types, [(now, first, ",".join(held))])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"seq": pa.int64(), "sha": pa.string()}
        now, total = None, None
        for batch in batches:
            out = []
            for seq, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seq == now:
                    total.update(b"," + part.encode())
                    continue
                if total:
                    out.append((now, total.hexdigest()))
                now, total = seq, hashlib.sha256(part.encode())
            yield record_batch(types, out)
        if total:
            yield record_batch(types, [(now, total.hexdigest())])

    parts = members.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(chunks, "seq long, first long, part string")
    return parts.repartition("seq").sortWithinPartitions("seq", "first").select("seq", "part").mapInArrow(digests, "seq long, sha string")


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """``(ids, bytes, n, conv_id, sha)``: each distinct sequence, its members, the smallest, and their digest."""
    counted = settle_packed(sequences.groupBy("ids").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
                     .withColumn("seq", F.monotonically_increasing_id()), "sequences")
    shared = counted.where("n > 1").select("ids", "seq")
    shas = member_digests(sequences.select("conv_id", "ids").join(shared, "ids"))
    own = F.sha2(F.col("conv_id").cast("string"), 256)
    return counted.join(shas, "seq", "left").select("ids", "bytes", "n", "conv_id", F.coalesce("sha", own).alias("sha"))


class Tree:
    """A ternary search tree over id sequences, its nodes in flat arrays.

    ``lo`` and ``hi`` are other turns at the same place, ``eq`` is what follows; node 0 is the root of
    the trie, before any turn. ``end`` is the sequence that ends at a node.
    """

    def __init__(self) -> None:
        self.id, self.lo, self.hi, self.eq, self.end, self.bytes = (array("q", [x]) for x in (-1, -1, -1, -1, -1, 0))

    def _node(self, turn: int, size: int) -> int:
        for column, value in ((self.id, turn), (self.lo, -1), (self.hi, -1), (self.eq, -1), (self.end, -1), (self.bytes, size)):
            column.append(value)
        return len(self.id) - 1

    def _step(self, at: int, turn: int, size: int | None) -> int:
        """The child of a node by a turn, made if ``size`` is given."""
        column, where = self.eq, at
        while column[where] >= 0:
            where = column[where]
            if turn == self.id[where]:
                return where
            column = self.lo if turn < self.id[where] else self.hi
        made = self._node(turn, size)
        column[where] = made
        return made

    def insert(self, ids: list[int], sizes: list[int], number: int) -> None:
        at = 0
        for turn, size in zip(ids, sizes):
            at = self._step(at, turn, size)
        self.end[at] = number

    def path(self, ids: list[int]) -> list[int]:
        out = [0]
        for turn in ids:
            out.append(self._step(out[-1], turn, None))
        return out

    def insert_medians(self, ids: list[list[int]], sizes: list[list[int]]) -> None:
        """All sequences, given in order: the median first, then both halves likewise."""
        open_ = [(0, len(ids))]
        while open_:
            a, b = open_.pop()
            if a < b:
                middle = (a + b) // 2
                self.insert(ids[middle], sizes[middle], middle)
                open_ += [(middle + 1, b), (a, middle)]

    def preorder(self) -> tuple[array, array, array]:
        """Nodes with every parent before its children, siblings in order, and parent and depth of each node."""
        order, parent, depth = array("q"), array("q", [-1]) * len(self.id), array("q", [0]) * len(self.id)
        open_ = [(0, True)]
        while open_:
            at, enter = open_.pop()
            if not enter:
                order.append(at)
                below = self.eq[at]
                if below >= 0:
                    parent[below], depth[below] = at, depth[at] + 1
                    open_.append((below, True))
                continue
            hi, lo = self.hi[at], self.lo[at]
            for side in (lo, hi):
                if side >= 0:
                    parent[side], depth[side] = parent[at], depth[at]
            open_ += [(x, e) for x, e in ((hi, True), (at, False), (lo, True)) if x >= 0]
        return order, parent, depth


# What a shard gives: final nodes, and partial ones (``place`` set) on the paths of its first and last sequence.
SHARD = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
         "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "shard": pa.int64(), "up": pa.int64(), "place": pa.int64(), "id": pa.int64(), "bytes": pa.int64()}
SHARD_DDL = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in SHARD.items())


def shard_nodes(rows: list[tuple[list[int], list[int], int, int, str]], shard: int) -> Iterator[tuple]:
    """All nodes of the sorted distinct sequences ``(ids, bytes, n, conv_id, sha)`` of a shard.

    A partial node counts its members, and of its children, leaves and savings only what final nodes
    add; ``place`` numbers the partial nodes in order, ``up`` is the place of a partial parent.
    """
    tree = Tree()
    tree.insert_medians([r[0] for r in rows], [r[1] for r in rows])
    order, parent, depth = tree.preorder()
    size = len(order)
    partial = dict.fromkeys(tree.path(rows[0][0]) + tree.path(rows[-1][0]))
    members, least, children, leaves, saved = (array("q", [x]) * size for x in (0, (1 << 63) - 1, 0, 0, 0))
    places: list[int] = []
    for at in reversed(order):
        end, up = tree.end[at], parent[at]
        if end >= 0:
            members[at] += rows[end][2]
            least[at] = min(least[at], rows[end][3])
        if at not in partial:
            leaves[at] += not children[at]
            saved[at] += (members[at] - 1) * tree.bytes[at]
        if up >= 0:
            members[up] += members[at]
            least[up] = min(least[up], least[at])
            children[up] += at not in partial
            leaves[up] += leaves[at] if at not in partial else 0
            saved[up] += saved[at] if at not in partial else 0
    for at in order:
        if at in partial:
            partial[at] = len(places)
            places.append(at)
        up, end = parent[at], tree.end[at]
        above = partial.get(up) if up >= 0 else None
        sha = rows[end][4] if end >= 0 else None
        if at in partial:
            yield (least[at], depth[at], None, members[at], children[at], leaves[at], saved[at], sha, shard, above, partial[at], tree.id[at], tree.bytes[at])
        else:
            yield (least[at], depth[at], least[up] if above is None else None, members[at], children[at], leaves[at], saved[at], sha or NOTHING, shard, above, None, None, None)


def _batches(rows: Iterator[tuple], types: dict) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_AT_ONCE:
            yield record_batch(types, held)
            held = []
    yield record_batch(types, held)


def trie_shards(distinct: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of every range shard of ``distinct_sequences``: final ones, and partial ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        if rows:
            yield from _batches(shard_nodes(rows, TaskContext.get().partitionId()), SHARD)

    turns = distinct.agg(F.sum(F.size("ids"))).first()[0] or 0
    shards = distinct.repartitionByRange(turns // shard_turns + 1, "ids").sortWithinPartitions("ids")
    return shards.select("ids", "bytes", "n", "conv_id", "sha").mapInArrow(run, SHARD_DDL)


# A merged node (``no``, ``up_no`` of its parent) when it closes, or which node a partial row went to.
MERGED = {"no": pa.int64(), "up_no": pa.int64(), "conv_id": pa.int64(), "depth": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
          "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "shard": pa.int64(), "place": pa.int64()}
MERGED_DDL = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in MERGED.items())
PARTIAL = ("shard", "place", "depth", "id", "bytes", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def merged_rows(partial: Iterator[tuple]) -> Iterator[tuple]:
    """Partial nodes in the order of shards and places, merged; only the open path is held."""
    path: list[dict] = []
    count = 0

    def close(upto: int) -> Iterator[tuple]:
        while len(path) > upto:
            node = path.pop()
            node["leaves"] += not node["children"]
            node["saved"] += (node["n"] - 1) * node["bytes"]
            if path:
                path[-1]["leaves"] += node["leaves"]
                path[-1]["saved"] += node["saved"]
            yield (node["no"], node["up"], node["conv"], len(path), node["n"], node["children"], node["leaves"], node["saved"], node["sha"] or NOTHING, None, None)

    for shard, place, depth, turn, size, conv, n, children, leaves, saved, sha in partial:
        if depth >= len(path) or path[depth]["id"] != turn:
            yield from close(depth)
            if path:
                path[-1]["children"] += 1
            path.append({"no": count, "up": path[-1]["no"] if path else None, "id": turn, "bytes": size, "conv": conv, "n": 0, "children": 0, "leaves": 0, "saved": 0, "sha": None})
            count += 1
        node = path[depth]
        node["conv"] = min(node["conv"], conv)
        node["n"] += n
        node["children"] += children
        node["leaves"] += leaves
        node["saved"] += saved
        node["sha"] = node["sha"] or sha
        yield (node["no"], None, None, None, None, None, None, None, None, shard, place)
    yield from close(0)


def merge_partial(nodes: DataFrame) -> DataFrame:
    """The partial nodes of all shards merged: two paths a shard, read in order by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        yield from _batches(merged_rows(rows), MERGED)

    return nodes.where("place IS NOT NULL").select(*PARTIAL).repartition(1).sortWithinPartitions("shard", "place").mapInArrow(run, MERGED_DDL)


def trie_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every node of the prefix trie of ``sequences(conv_id, ids, bytes)``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, and over
    the subtree ``n_leaves`` and ``saved_tokens``; ``ends_sha256`` of the members that end here.
    """
    shards = settle_packed(trie_shards(settle_packed(distinct_sequences(sequences), "distinct"), shard_turns), "shards")
    merged = settle_packed(merge_partial(shards), "merged")
    top = merged.where("depth IS NOT NULL")
    named = top.select(F.col("no").alias("_no"), F.col("conv_id").alias("_conv"))
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = top.join(named, F.col("up_no") == F.col("_no"), "left").select("conv_id", "depth", F.col("_conv").alias("parent_conv_id"), *counts)
    places = merged.where("depth IS NULL").join(named, F.col("no") == F.col("_no")).select(F.col("shard").alias("_shard"), F.col("place").alias("_place"), "_conv")
    own = shards.where("place IS NULL").join(places, (F.col("shard") == F.col("_shard")) & (F.col("up") == F.col("_place")), "left")
    return shared.unionByName(own.select("conv_id", "depth", F.coalesce("parent_conv_id", "_conv").alias("parent_conv_id"), *counts))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the rebuilt ``conversations(conv_id, turn, role, text)``."""
    sequences = settle_packed(rebuilt(settle_packed(encoded(conversations), "encoded")), "rebuilt")
    return trie_nodes(sequences, shard_turns)
