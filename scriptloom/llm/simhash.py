"""SimHash near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import durable
from .textbatch import ASCII_LOWER, bounded_batches, byte_table, chunks, mix, runs

SEED = 42
#: The white space between words: blank and the control characters 9 to 13.
_SPACE = byte_table([32, *range(9, 14)])
_SLICE = 1 << 16


def _shingles(starts: np.ndarray, ends: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of ``shingle`` words; of all words where there are fewer."""
    n = len(starts)
    if n > shingle:
        return starts[: n - shingle + 1], ends[shingle - 1 :]
    return starts[:1], ends[-1:]


def fingerprint(words: bytes, starts: np.ndarray, ends: np.ndarray, shingle: int = 3, size: int = 1) -> list[int]:
    """SimHash of one text in ``size`` words of 64 bits, as signed integers.

    words is space-joined, starts and ends bound its words. The first word is of the shingles'
    XXH64, each other one of those hashes mixed anew.
    """
    if not len(starts):
        return [0] * size
    starts, ends = _shingles(starts, ends, shingle)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((size, 64), dtype=np.int64)
    for at in range(0, len(starts), _SLICE):  # bounds the memory that a very long text takes
        spans = zip(starts[at : at + _SLICE].tolist(), ends[at : at + _SLICE].tolist(), strict=True)
        hashes = np.array([digest(words[a:b], SEED) for a, b in spans], dtype=np.uint64)
        for k in range(size):
            own = hashes if not k else mix((hashes + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93))
            ones[k] += np.unpackbits(own.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * x > len(starts)).tobytes(), "big", signed=True) for x in ones]


def _joined(chunk) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(row, its words joined by blanks, their starts and ends) for each row of a chunk."""
    space = _SPACE[chunk.data]
    starts, ends, first = runs(~space, chunk.offsets)
    keep = ~space
    keep[ends[ends < len(keep)]] = True
    joined = ASCII_LOWER[chunk.data]
    joined[space] = 32
    lengths = ends - starts
    for i in range(len(chunk)):
        lo, hi = first[i], first[i + 1]
        a, b = int(chunk.offsets[i]), int(chunk.offsets[i + 1])
        to = np.cumsum(lengths[lo:hi] + 1) - 1
        yield i, joined[a:b][keep[a:b]].tobytes().lstrip(b" "), to - lengths[lo:hi], to


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, size: int = 1) -> DataFrame:
    """``(doc_id, fp, more)`` with one row per row of ``docs``.

    fp is the 64-bit SimHash as a long, more an array of ``size`` - 1 further words of it.

    Lower-cases A-Z, takes runs of anything but ASCII white space as words and hashes each run of
    ``shingle`` words (repeats count; a shorter text is one shingle). A null, empty or blank text
    has fingerprint 0. Ids may be null or repeated; other columns are ignored.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, size), dtype=np.int64)
            for chunk in chunks(batch.column(1)):
                for i, words, starts, ends in _joined(chunk):
                    out[chunk.first + i] = fingerprint(words, starts, ends, shingle, size)
            more = pa.FixedSizeListArray.from_arrays(pa.array(out[:, 1:].ravel()), size - 1) if size > 1 else pa.nulls(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[:, 0]), more.cast(pa.list_(pa.int64()))], ["doc_id", "fp", "more"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(one, f"doc_id {kind}, fp bigint, more array<bigint>")


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """``(u, v)``: every pair of distinct fingerprints that differ in 1 to ``radius`` bits (3 at most).

    Multi-index hashing with two segments of 32 bits: of at most three differing bits, one
    segment holds one at most. The table has each segment's value; a probe asks for its own value
    and for those with one of its 0 bits set (of two values that differ in one bit, one has the 0,
    so asking in one direction meets each pair). Full distances are verified within the join, and
    only links leave it. Keys are near random over 2^32 values; AQE splits a hot one.
    """
    if not 1 <= radius <= 3:
        raise ValueError("two segments with balls of one bit cover a radius of 1 to 3")
    distinct = fps.select("fp").where("fp is not null").distinct()
    segment = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))]
    table = distinct.select(
        F.col("fp").alias("v"),
        F.explode(F.array(*[part + F.lit(k << 32) for k, part in enumerate(segment)])).alias("key"),
    )

    def ball(k: int, part):
        at = lambda i: F.lit(1).cast("bigint").bitwiseAND(F.call_function("shiftrightunsigned", part, i)) == 0
        zeros = F.filter(F.sequence(F.lit(0), F.lit(31)), at)
        flipped = F.transform(zeros, lambda i: part + F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
        return F.transform(F.concat(F.array(part), flipped), lambda x: x + F.lit(k << 32))

    probes = distinct.select(
        F.col("fp").alias("u"),
        F.explode(F.concat(*[ball(k, part) for k, part in enumerate(segment)])).alias("key"),
    )
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).between(1, radius)
    return probes.join(table, "key").where(near).select("u", "v")


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per row of ``docs``.

    Two fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest id
    that can be reached over links, the own id included. Copies share one fingerprint and so are
    one node however many they are. Texts without words all have fingerprint 0 and are one group.
    A null id takes part but never names a group (component_id is null if the group has no id).
    An empty table gives an empty result.
    """
    return _grouped(durable(fingerprints(docs, id_col, text_col, shingle), "fingerprints"), radius)


def _grouped(fps: DataFrame, radius: int) -> DataFrame:
    by_fp = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "by_fp")
    labels = durable(connected_components(links(by_fp, radius)), "labels")
    # the smallest id of each linked component; fingerprints without links keep their own
    named = labels.join(by_fp, labels.node == by_fp.fp).groupBy("label").agg(F.min("first_id").alias("component_id"))
    linked = labels.join(named, "label").select(F.col("node").alias("fp"), "component_id")
    groups = by_fp.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    groups = durable(groups, "groups")  # both sides are dealt afresh, so that AQE can split a hot fingerprint
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")


#: Documents, about, that are looked at for frequent shingles, whatever the size of the corpus.
SAMPLE = 20_000
#: Frequent shingles that the order of shingles knows.
FREQUENT = 100_000
#: Buckets of a set's sketch, and shingles from which on a set has counts as well.
BUCKETS, COUNTED = 1024, 1024
#: Bits of the table of document ids that is sent to all tasks: 2^24, 262,144 rows at most.
ID_BITS = 24


def shingle_sets(docs: DataFrame, shingle: int, take) -> DataFrame:
    """``(doc_id, node, fp, sketch, counts, n, keys)`` of ``(doc_id, text)``, one row per row.

    A text's set are the XXH64 of its distinct shingles: node is a digest of the whole set, fp its
    SimHash, sketch has for each of ``BUCKETS`` hash buckets whether an odd number of shingles is in
    it (as longs), counts are ``bucket_counts``, n is the size and keys what ``take`` returns (all of it as unsigned integers).
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            nodes, fps, sketches, counts, sizes, keys = [], [], [], [], [], []
            for chunk in chunks(batch.column(1)):
                for _, words, starts, ends in _joined(chunk):
                    spans = zip(*(x.tolist() for x in _shingles(starts, ends, shingle)), strict=True)
                    own = np.unique(np.fromiter((digest(words[a:b], SEED) for a, b in spans), dtype=np.uint64))
                    nodes.append(digest(own.tobytes(), SEED))
                    fps.append(_majority(own))
                    odd = np.bincount((own & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS) & 1
                    sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                    counts.append(bucket_counts(own))
                    sizes.append(len(own))
                    keys.append(take(own).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *keys])
            columns = [
                batch.column(0),
                pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)),
                pa.array(fps, pa.int64()),
                pa.array(sketches, pa.list_(pa.int64())),
                pa.array(counts, pa.binary()),
                pa.array(np.array(sizes, dtype=np.int64)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "fp", "sketch", "counts", "n", "keys"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(one, "doc_id bigint, node bigint, fp bigint, sketch array<bigint>, counts binary, n bigint, keys array<bigint>")


def bucket_counts(own: np.ndarray) -> bytes | None:
    """How many shingles of a long set are in each hash bucket, 255 at most, a byte each; some 4 to 8 shingles are in one.

    Short sets have none: their sketch of bits says enough.
    """
    if len(own) < COUNTED:
        return None
    buckets = 1 << (len(own) - 1).bit_length() - 3
    counts = np.bincount((own & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def counts_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the shingles that only one of two sets has: the difference of their buckets, the finer ones folded."""
    wide, narrow = sorted((np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in (a, b)), key=len, reverse=True)
    return int(np.abs(wide.reshape(-1, len(narrow)).sum(axis=0) - narrow).sum())


def _majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have set, as a signed integer."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        ones += np.unpackbits(hashes[at : at + _SLICE].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) that many documents of a sample have, and in how many they are.

    They only order the shingles; which pairs are found doesn't depend on them.
    """
    share = max(1, docs.count() // SAMPLE)
    some = shingle_sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), shingle, lambda own: own)
    found = some.select("node", "keys").dropDuplicates(["node"]).select(F.explode("keys").alias("key")).groupBy("key").count()
    table = found.where("count > 2").orderBy(F.desc("count"), "key").limit(FREQUENT).toArrow()
    keys = table.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column("count").to_numpy()[order].astype(np.int64)


def rare_prefix(similarity: float, frequent: np.ndarray, counts: np.ndarray):
    """Of a set of n its n - ceil(similarity n) + 1 first shingles, rare ones before frequent ones.

    Two sets as alike as asked for share ``similarity`` of the larger at least, so in any common
    order their prefixes share a shingle.
    """

    def take(own: np.ndarray) -> np.ndarray:
        n = len(own)
        size = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
            own = own[np.argsort(np.where(frequent[at] == own, counts[at], 0), kind="stable")]
        return own[:size]

    return take


#: Texts on a shingle's list from which on the shingle counts as frequent, though the sample didn't show it.
LONG_LIST = 1000


def _shared_keys(sets: DataFrame) -> DataFrame:
    """``(key, node, place, k, nodes)`` of the prefix shingles that a node has in common with another.

    k is on how many nodes' lists a shingle is, nodes a digest of these nodes. Copies are one node before
    anything is taken apart; a shingle's rows meet once, so they are shuffled once.
    """
    place = F.shiftleft(F.col("n"), 32) + F.col("at")
    keys = sets.select("node", "n", "keys").dropDuplicates(["node"]).select("node", "n", F.posexplode("keys").alias("at", "key")).select("key", "node", place.alias("place")).repartition("key")
    digest, own = F.xxhash64("node"), Window.partitionBy("key")
    sums = {"k": F.count("*").over(own), "s": F.sum(F.pmod(digest, F.lit(1 << 40))).over(own), "x": F.bit_xor(digest).over(own)}
    return durable(keys.withColumns(sums).where("k > 1").select("key", "node", "place", "k", F.xxhash64("k", "s", "x").alias("nodes")), "shared")


def _places_of(rows: DataFrame) -> DataFrame:
    """Rows of ``_shared_keys`` -> ``(key, node, n, at)``.

    Shingles that the same nodes have are one key, at the place of the first of them: the order of
    shingles is the same in every node, so a pair's first common shingle is still there. That
    leaves one row for a passage instead of one for each of its shingles.
    """
    first = rows.groupBy(F.col("nodes").alias("key"), "node").agg(F.min("place").alias("place"))
    return first.select("key", "node", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"))


def short_lists(docs: DataFrame, sets: DataFrame, shingle: int, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(sets, their shared places), with what turned out to be frequent moved to the end of the order.

    A shingle that a sample has missed, but that is on the prefixes of more than ``LONG_LIST`` texts (a
    template's, say), would bring all these texts together. Such shingles, ``FREQUENT`` at most, are ordered
    behind the rare ones by their counts, and the prefixes of the texts that had them are taken anew;
    all other prefixes are the same in the new order. Any order finds every pair.
    """
    rows = _shared_keys(sets)
    long = rows.where(F.col("k") > LONG_LIST).select("key", "k").distinct()
    found = long.orderBy(F.desc("k"), "key").limit(FREQUENT).select("key", "k").toArrow()
    keys = found["key"].to_numpy().astype(np.int64).view(np.uint64)
    new = ~np.isin(keys, frequent)
    if not new.any():
        return sets, _places_of(rows)
    every = np.concatenate([frequent, keys[new]])
    number = np.concatenate([counts, found["k"].to_numpy().astype(np.int64)[new]])
    order = np.argsort(every)
    known = sets.sparkSession.createDataFrame([(int(x),) for x in keys[new].view(np.int64)], "key bigint")
    nodes = durable(rows.join(known, "key", "left_semi").select("node").distinct(), "templates")
    ids = durable(sets.join(nodes, "node", "left_semi").select("doc_id").distinct(), "ids")
    again = shingle_sets(_of_ids(docs, ids), shingle, rare_prefix(similarity, every[order], number[order]))
    sets = durable(sets.join(ids, "doc_id", "left_anti").unionByName(again), "sets")
    return sets, _places_of(_shared_keys(sets))


def _may_be_alike(similarity: float, a: str, b: str):
    """Whether two sets whose first common shingle is this one may be alike enough.

    Of sets of n and m, alike ones share s / (1 + s) (n + m); from the first common shingle on
    both must have as many left. This is exact: every alike pair passes at its first common one.
    """
    needed = F.lit(similarity / (1 + similarity)) * (F.col(f"{a}n") + F.col(f"{b}n")) - 1e-6
    return (F.col(f"{a}n") - F.col(f"{a}at") >= needed) & (F.col(f"{b}n") - F.col(f"{b}at") >= needed)


def _simhash_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of sets whose SimHash differs in 3 bits at most: one set of each SimHash stands for it."""
    nodes = sets.select("node", "fp").distinct()
    first = durable(nodes.groupBy("fp").agg(F.min("node").alias("first")), "by_fp")
    same = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    u, v = first.toDF("u", "first_u"), first.toDF("v", "first_v")
    near = links(first).join(u, "u").join(v, "v").select(F.least("first_u", "first_v").alias("u"), F.greatest("first_u", "first_v").alias("v"))
    return same.union(near).distinct()


def _star_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs of the texts of each shingle with the one of them that has the fewest rarer shingles.

    In a group of near copies that is the least edited one.
    """
    first = F.min(F.struct(F.col("at").alias("bat"), F.col("node").alias("b"), F.col("n").alias("bn")))
    per = rows.groupBy("key").agg(first.alias("f")).select("key", "f.*")
    a = rows.select("key", F.col("node").alias("a"), F.col("n").alias("an"), F.col("at").alias("aat"))
    near = a.join(per, "key").where((F.col("a") != F.col("b")) & _may_be_alike(similarity, "a", "b"))
    return near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _other_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs of texts that share a shingle, may be alike and aren't in one component.

    One side has only the texts outside of a shingle's largest component, so that a large group
    that is one component by now isn't paired with itself.
    """
    most = rows.groupBy("key", "c").count().groupBy("key").agg(F.max(F.struct("count", "c"))["c"].alias("most"), F.count("*").alias("k"))
    rows = rows.join(most.where("k > 1").select("key", "most"), "key")
    side = lambda x: [F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("at").alias(f"{x}at"), F.col("c").alias(f"{x}c")]
    a = rows.where("c <> most").select("key", *side("a"))
    b = rows.select("key", *side("b"), (F.col("c") == F.col("most")).alias("large"))
    apart = (F.col("ac") != F.col("bc")) & (F.col("large") | (F.col("a") < F.col("b"))) & _may_be_alike(similarity, "a", "b")
    return a.join(b, "key").where(apart).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _counted_near(similarity: float):
    share = (1 - similarity) / (1 + similarity)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, us, vs = (batch.column(c).to_pylist() for c in (2, 3, 4))
            near = [a is None or b is None or counts_apart(a, b) <= share * n + 1e-6 for n, a, b in zip(sizes, us, vs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    return one


def _near(pairs: DataFrame, firsts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose sketches differ in no more bits, and their counts by no more, than alike sets may differ in shingles.

    Each shingle that only one of two sets has changes one bit, and a count by one, so no alike pair is lost. Bits
    of long sets are as good as random, so without the counts nearly all pairs of long texts would be compared whole.
    """
    of = lambda x: firsts.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}s"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    apart = F.aggregate(F.zip_with("us", "vs", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = both.where(apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("un") + F.col("vn")) + 1e-6)
    counts = lambda x: firsts.where("counts is not null").select(F.col("node").alias(x), F.col("counts").alias(f"{x}c"))
    both = both.select("u", "v", (F.col("un") + F.col("vn")).alias("n")).join(counts("u"), "u", "left").join(counts("v"), "v", "left")
    return bounded_batches(both.select("u", "v", "n", "uc", "vc")).mapInArrow(_counted_near(similarity), "u bigint, v bigint")


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of these ids.

    A table of ``2 ** ID_BITS`` bits, whatever the number of ids, is broadcast and spares most other
    rows the shuffle; the join decides.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    table = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("mask"))
    maybe = docs.withColumn("word", word).join(F.broadcast(table), "word").where(F.col("mask").bitwiseAND(bit) != 0)
    return maybe.select(*docs.columns).join(ids, "doc_id", "left_semi")


def _alike(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose whole sets of shingles are alike enough (Jaccard).

    ``firsts`` has a doc_id of each node; the sets of paired nodes are made anew from their texts.
    """
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    ids = durable(firsts.join(nodes, "node").select("doc_id").distinct(), "ids")
    sets = shingle_sets(_of_ids(docs, ids), shingle, lambda own: own).select("node", "n", "keys")
    sets = durable(sets, "whole_sets").dropDuplicates(["node"])
    both = pairs.join(sets.toDF("u", "un", "us"), "u").join(sets.toDF("v", "vn", "vs"), "v")
    both = both.select("u", "v", (F.col("un") + F.col("vn")).alias("both"), F.size(F.array_intersect("us", "vs")).alias("common"))
    return both.where(F.col("common") >= F.lit(similarity) * (F.col("both") - F.col("common")) - 1e-9).select("u", "v")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)``: groups of texts whose sets of word shingles are alike (Jaccard).

    Texts with one set are one node, however many. First the nodes whose SimHash (of the distinct
    shingles) is within 3 bits are found by multi-index hashing. SimHash can't find every pair that
    is alike, so an exact way follows for the rest: a pair with a similarity of ``similarity`` or
    more has a common shingle in its rare prefixes, at any length. In the first round a shingle's
    texts meet one of them, in the second all that aren't in one component yet. Only comparisons of
    whole sets link. component_id is the smallest id that can be reached. Ids must be integers; rows
    with a null id are left out. Texts without words are one group, null texts among them. An
    empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    known = frequent_shingles(docs, shingle)
    sets = durable(shingle_sets(docs, shingle, rare_prefix(similarity, *known)), "sets")
    firsts = F.min(F.struct("doc_id", "n", "sketch", "counts")).alias("f")
    firsts = durable(sets.groupBy("node").agg(firsts).select("node", "f.*"), "firsts")
    sets, rows = short_lists(docs, sets, shingle, similarity, *known)
    rows = durable(rows, "rows")

    pairs = _simhash_pairs(sets).union(_star_pairs(rows, similarity)).distinct()
    pairs = durable(_near(pairs, firsts, similarity), "pairs")
    linked = durable(_alike(pairs, docs, firsts, shingle, similarity), "alike")
    labels = durable(connected_components(linked), "labels").toDF("node", "label")
    named = rows.join(labels, "node", "left").select("key", "node", "n", "at", F.coalesce("label", "node").alias("c"))
    others = _other_pairs(durable(named, "named"), similarity).join(pairs, ["u", "v"], "left_anti")
    others = durable(_near(others, firsts, similarity), "others")
    linked = linked.union(durable(_alike(others, docs, firsts, shingle, similarity), "alike"))
    labels = durable(connected_components(linked), "labels").toDF("node", "label")

    label = F.coalesce("label", "node")
    named = durable(firsts.select("node", F.col("doc_id").alias("first_id")).join(labels, "node", "left"), "nodes")
    groups = durable(named.groupBy(label.alias("label")).agg(F.min("first_id").alias("component_id")), "groups")
    named = durable(named.select("node", label.alias("label")).join(groups, "label").select("node", "component_id"), "components")
    return sets.select("doc_id", "node").join(named, "node").select("doc_id", "component_id").distinct()


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of ``similar_groups``: that of the smallest id.

    Rows with a null id stay as they are; of rows that repeat the id of a kept document, all stay.
    """
    groups = similar_groups(docs, id_col, text_col, **options)
    gone = durable(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "copies")
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
