"""Prefix trie of conversations as a burst trie: heads over containers of suffixes, containers swept in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import durable
from .textbatch import bounded_batches

#: A container of more sequences, or of more turns than this, bursts.
SEQUENCES, TURNS = 2048, 65_536
#: Ids that one piece of a node's list of ends has.
PIECE = 4096
_SEQUENCE = "key string, first bigint, n bigint, ids array<binary>, words array<bigint>"
_NODE = "cid string, above string, top boolean, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, key string"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: one row for each non-null conv_id, turns as structs of (turn, id, words) in order.

    Null turns come first; of turns with one number the one of the smaller id does. id is a digest of
    128 bits of role and text (nulls are empty), words the number of words of the text. Texts stay
    where they are read; a conversation is one row of some 32 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    number = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn"), number.alias("id"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def shared_openings(turns: DataFrame, period: int = 20, most: int = 4) -> DataFrame:
    """``(conv_id, ids, words)``: each conversation's first h turns replaced by those of conversation c - c % ``period``.

    h is the unsigned CRC-32 of the decimal conv_id modulo ``most``; what is absent gives no turns.
    """
    heads = turns.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    own = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % period).withColumn("h", h)
    none = F.slice("turns", 1, 0)
    both = own.join(heads, "base", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("t")
    )
    return both.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def _sequences(convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence: its key, smallest conv_id, number of conversations, ids and words."""
    same = convs.groupBy("key").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"))
    return same.join(convs.select(F.col("conv_id").alias("first"), "ids", "words"), "first").select("key", "first", "n", "ids", "words")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) -> (key, first, text): runs of at most ``PIECE`` ids, joined by commas."""
    key, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "first", "text"])

    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == PIECE):
                yield piece()
                ids = []
            key = k
            ids.append(i)
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, first, text) -> (key, ends_sha256), piece by piece."""
    key, digest = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    yield row()
                key, digest = k, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if key is not None:
        yield row()


def list_digests(members: DataFrame) -> DataFrame:
    """``(key, conv_id)`` -> ``(key, ends_sha256)``: SHA-256 of a key's ids, ascending and comma-joined.

    Ids are dealt by ranges of (key, id), so that the ids of a large group are joined to pieces by many
    tasks; the digest itself goes over the pieces in order, of which one at a time is in memory.
    """
    ranges = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ranges.mapInArrow(_joined_ids, "key string, first bigint, text string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key string, ends_sha256 string")


class _Node:
    """A node on the path that a sweep is at."""

    __slots__ = ("children", "depth", "first", "key", "leaves", "n", "rows", "saved", "words")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.n, self.first, self.children, self.leaves, self.saved = depth, words, 0, None, 0, 0, 0
        self.key: str | None = None
        self.rows: list[tuple] = []  # finished children, which wait for this node's smallest member

    def add(self, n: int, first: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)


def _closed(path: list[_Node], out: list[tuple], cid: str, above: str | None, parent: int | None) -> None:
    """Take the last node off the path: its figures go to its parent, its children's rows go out."""
    node = path.pop()
    leaves = node.leaves or 1
    saved = node.saved + ((node.n - 1) * node.words if node.depth else 0)
    out += [(*row[:5], node.first, *row[6:]) for row in node.rows]
    row = (cid, above, not path, node.first, node.depth, parent, node.n, node.children, leaves, saved, node.key)
    if not path:
        out.append(row)
        return
    up = path[-1]
    up.add(node.n, node.first)
    up.children += 1
    up.leaves += leaves
    up.saved += saved
    up.rows.append(row)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences in the order of (container, ids) -> nodes, by one path from the container's top."""
    names = [f.split(" ")[0] for f in _NODE.split(", ")]
    types = [pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 7, pa.string()]
    path: list[_Node] = []
    at: tuple = (None, None, None)
    before: list[bytes] = []
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for part in batches:
        for cid, above, parent, top, key, first, n, ids, words in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if cid != at[0]:
                while path:
                    _closed(path, out, *at)
                at, before = (cid, above, parent), ids
                path = [_Node(top, words[top - 1] if top else 0)]
            common = top
            while common < min(len(ids), len(before)) and common < path[-1].depth and ids[common] == before[common]:
                common += 1
            while path[-1].depth > common:
                _closed(path, out, *at)
            path += [_Node(d + 1, words[d]) for d in range(common, len(ids))]
            path[-1].add(n, first)
            path[-1].key = key
            before = ids
        if len(out) > 10_000:
            yield batch()
            out.clear()
    while path:
        _closed(path, out, *at)
    yield batch()


def _common(a, b):
    """How many first elements two arrays have in common."""
    apart = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(apart == 0, F.size(a)).otherwise(apart - 1).cast("bigint")


def _burst(live: DataFrame, sequences: int, turns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Containers that stay, the heads of those that burst, and the containers under these heads."""
    held = F.sum(F.size("ids") - F.col("top"))
    sizes = live.groupBy("cid").agg(F.count("*").alias("k"), held.alias("held"), F.min("ids").alias("least"), F.max("ids").alias("most"), F.min("first").alias("head"), F.sum("n").alias("n_convs"))
    sizes = durable(sizes.select("cid", "head", "n_convs", ((F.col("k") > sequences) | ((F.col("held") > turns) & (F.col("k") > 1))).alias("large"), _common("least", "most").alias("bottom")), "sizes")
    small = live.join(sizes.where("not large").select("cid"), "cid", "left_semi")
    large = live.join(sizes.where("large").drop("large"), "cid")
    ends = large.where(F.size("ids") == F.col("bottom")).select("cid", "key")
    some = large.where("first = head").select("cid", "above", "parent", "top", "bottom", F.col("head").alias("first"), "n_convs", "words")
    heads = some.join(ends, "cid", "left")
    number = F.md5(F.concat(F.col("cid").cast("binary"), F.element_at("ids", (F.col("bottom") + 1).cast("int"))))
    below = large.where(F.size("ids") > F.col("bottom")).select(
        number.alias("cid"), F.col("cid").alias("above"), F.col("head").alias("parent"), (F.col("bottom") + 1).alias("top"), "key", "first", "n", "ids", "words"
    )
    return small, heads, below


def _head_nodes(heads: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of heads, each with the path down to where it bursts, from the tops of the containers below."""
    sums = tops.groupBy(F.col("above").alias("cid")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    rows = heads.join(sums, "cid").withColumn("depth", F.explode(F.sequence("top", "bottom")))
    own = F.slice("words", F.greatest("depth", F.lit(1)).cast("int"), (F.col("bottom") - F.greatest("depth", F.lit(1)) + 1).cast("int"))
    saved = F.col("below") + (F.col("n_convs") - 1) * F.aggregate(own, F.lit(0).cast("bigint"), lambda s, x: s + x)
    top, bottom = F.col("depth") == F.col("top"), F.col("depth") == F.col("bottom")
    return rows.select(
        "cid", "above", top.alias("top"), F.col("first").alias("conv_id"), "depth", F.when(top, F.col("parent")).otherwise(F.col("first")).alias("parent_conv_id"),
        "n_convs", F.when(bottom, F.col("c")).otherwise(F.lit(1)).cast("bigint").alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.when(bottom, F.col("key")).alias("key"),
    )


def prefix_trie(convs: DataFrame, sequences: int = SEQUENCES, turns: int = TURNS) -> DataFrame:
    """``(conv_id, ids, words)`` -> one row for each node of the prefix trie.

    conv_id (the smallest member's), depth, parent_conv_id, n_convs, n_children, n_leaves (childless
    nodes in the subtree), saved_tokens (over the subtree, (n_convs - 1) times the words of a node's
    last turn) and ends_sha256 (digest of the ids of the conversations that end in the node).

    conv_ids are distinct and not null. Equal sequences are one, with a count, so copies never make a
    container large. A container of more than ``sequences`` sequences, or of more than ``turns`` turns
    in them, bursts: its sequences' common path becomes a head, and each goes on by its next
    turn to a container below it, until all are small. One round takes a whole common path, so the number
    of rounds is that of nested branchings. The remaining containers are sorted by Spark and swept
    into nodes; sums go up from container to head, round by round. An empty table gives no node.
    """
    key = F.md5(F.array_join(F.transform("ids", F.hex), ","))
    convs = durable(convs.select("conv_id", key.alias("key"), "ids", "words"), "rebuilt")
    seqs = _sequences(convs)
    none = F.lit(None)
    live = seqs.select(F.lit("").alias("cid"), none.cast("string").alias("above"), none.cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("top"), *seqs.columns)
    live = durable(live, "containers")
    kept, rounds = [], []
    while True:
        small, heads, below = _burst(live, sequences, turns)
        kept.append(small)
        heads = durable(heads, "heads")
        if heads.isEmpty():
            break
        rounds.append(heads)
        live = durable(below, "containers")
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("cid", "above", "parent", "top", "key", "first", "n", "ids", "words")
    swept = bounded_batches(rows.repartition("cid").sortWithinPartitions("cid", "ids")).mapInArrow(_sweep, _NODE)
    nodes = durable(swept, "nodes")
    tops = nodes.where("top")
    for heads in reversed(rounds):
        found = durable(_head_nodes(heads, tops), "nodes")
        nodes, tops = nodes.unionByName(found), tops.where(F.lit(True)).unionByName(found.where("top"))
    ends = durable(list_digests(convs), "ends")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return nodes.join(ends, "key", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


def conversation_trie(conversations: DataFrame, period: int = 20, most: int = 4, sequences: int = SEQUENCES, turns: int = TURNS) -> DataFrame:
    """The prefix trie of conversations whose openings are shared (``turn_lists``, ``shared_openings``).

    ``conversations`` has conv_id, turn, role and text; rows without a conv_id take no part, other
    columns are ignored. Null roles and texts are empty, repeated rows are turns of their own.
    """
    lists = durable(turn_lists(conversations), "turns")
    return prefix_trie(shared_openings(lists, period, most), sequences, turns)
