"""N-gram Jaccard join as a T-occurrence search: short inverted lists are merged, long ones probed."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import durable
from .simhash import _near, _of_ids, _star_pairs, frequent_shingles, rare_prefix, shingle_sets, short_lists
from .textbatch import bounded_batches

#: Postings in one block of an inverted list.
BLOCK = 1024
#: Postings of a query that are in memory before they are merged to one run.
RUN = 1 << 20
#: Shingles that are probed at a time.
PROBE = 512


def _list_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and inverted lists in blocks, of ``(key, node, n, at, c)`` with c a node's component.

    Texts of a list's largest component, which the first search has linked, ask nothing of that list;
    lists with one component aren't asked at all. A list is in blocks of some ``BLOCK`` postings,
    dealt by hash, so a list that a third of all texts are on is no single row and no single task.
    """
    most = rows.groupBy("key", "c").count().groupBy("key").agg(
        F.max(F.struct("count", "c"))["c"].alias("most"), F.count("*").alias("k"), F.sum("count").alias("size"))
    most = durable(most.where("k > 1").select("key", "most", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "lists")
    rows = rows.join(most, "key")
    queries = rows.where("c <> most").select("key", "most", F.col("node").alias("u"), F.col("n").alias("un"), F.col("at").alias("ua"), F.col("c").alias("uc"))
    posting = F.struct("node", "n", "at", "c")
    lists = rows.groupBy("key", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")).agg(F.sort_array(F.collect_list(posting)).alias("postings"))
    return queries, lists


def _heap_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, sorted ids) in the order of u -> (u, v, occurrences), the lists of each u merged by a heap.

    Lists are merged to one run of (id, occurrences) as soon as ``RUN`` postings are at hand, so that
    memory follows the distinct texts that a query meets, not its postings.
    """
    query, lists, held = None, [], 0
    us, vs, ns = [], [], []

    def merged() -> list[tuple[int, int]]:
        run: list[list[int]] = []
        for node, count in heapq.merge(*lists):
            if run and run[-1][0] == node:
                run[-1][1] += count
            else:
                run.append([node, count])
        return [(a, b) for a, b in run]

    def flush() -> None:
        for node, count in merged():
            us.append(query), vs.append(node), ns.append(count)

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (us, vs, ns)], ["u", "v", "occurrences"])
        us.clear(), vs.clear(), ns.clear()
        return out

    for part in batches:
        for u, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if u != query:
                flush()
                query, lists, held = u, [], 0
            lists.append([(node, 1) for node in ids])
            held += len(ids)
            if held >= RUN:
                lists = [merged()]
                held = len(lists[0]) // 2
        if len(us) > 10_000:
            yield batch()
    flush()
    yield batch()


def _candidates(rows: DataFrame) -> DataFrame:
    """``(u, v)``: texts of different components that some short list has in common and that may be alike.

    Each query takes, block by block, those postings of its lists whose sizes and places leave
    room for the overlap (of sets of n and m at least 4/9 (n + m)); these sorted rests go to the
    query's task, which merges them.
    """
    queries, lists = _list_blocks(rows)
    room = lambda n, at, m: 180 * (n - at) >= 80 * (n + m)  # noqa: E731 - from the first common shingle on
    apart = lambda p: (
        (p["c"] != F.col("uc")) & ((p["c"] == F.col("most")) | (F.col("u") < p["node"]))
        & room(F.col("un"), F.col("ua"), p["n"]) & room(p["n"], p["at"], F.col("un"))
    )
    met = queries.join(lists, "key").select("u", F.transform(F.filter("postings", apart), lambda p: p["node"]).alias("ids")).where(F.size("ids") > 0)
    runs = bounded_batches(met.repartition("u").sortWithinPartitions("u")).mapInArrow(_heap_merged, "u bigint, v bigint, occurrences bigint")
    return runs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def overlap_reaches(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """Whether 100 |a and b| >= percent |a or b|, of sorted arrays without repeats.

    The smaller set's shingles are probed in the larger by binary search, ``PROBE`` at a time, for as
    long as the overlap can still be reached.
    """
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    needed = -(-percent * (len(a) + len(b)) // (100 + percent))
    found = 0
    for at in range(0, len(a), PROBE):
        if found + len(a) - at < needed:
            return False
        part = a[at : at + PROBE]
        place = np.minimum(np.searchsorted(b, part), len(b) - 1)
        found += int((b[place] == part).sum())
    return found >= needed


def _probed(percent: int):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[x.values.to_numpy().view(np.uint64) for x in batch.column(c)] for c in (2, 3)]
            alike = [overlap_reaches(a, b, percent) for a, b in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(alike, pa.bool_()))

    return one


def _reaching(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` whose overlap is large enough; the sets are made anew from the texts of the pairs' nodes."""
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    ids = durable(firsts.join(nodes, "node").select("doc_id").distinct(), "ids")
    sets = durable(shingle_sets(_of_ids(docs, ids), shingle, lambda own: own).select("node", "keys"), "whole_sets").dropDuplicates(["node"])
    both = pairs.join(sets.toDF("u", "us"), "u").join(sets.toDF("v", "vs"), "v").select("u", "v", "us", "vs")
    return bounded_batches(both).mapInArrow(_probed(percent), "u bigint, v bigint")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row for each row of ``docs`` with an id.

    A text's set are its distinct runs of ``shingle`` words (lower-cased A-Z, anything but ASCII white
    space); fewer words are one run. Two texts link when 100 times the size of what their sets have
    in common reaches ``percent`` times that of their union; component_id is the smallest id that
    links reach. Texts with one set are one node however many they are, so copies aren't paired.

    T-occurrence search by DivideSkip: a set of n must share T = ceil(percent n / 100) shingles with
    any it links to, so its T - 1 longest lists can be left out of the merge: whoever links is on
    one of the other, short ones. Lists count as long by what a sample of fixed size says of their
    shingles, and by their own length where that shows only later; this orders lists and decides nothing else. In a first search the texts of a
    short list meet the one with the fewest rarer shingles; then all that aren't in one
    component are searched in full: their short lists, held in blocks, are merged by a heap, and
    the candidates' whole overlap is counted by binary probes. Sketches of the sets spare most
    candidates that; they never drop one that links.

    Null, empty and blank texts have an empty set and link to nothing. Rows with a null id are left
    out; of repeated ids each row comes back, with the component of its own text. Sets or shingles
    with one 64-bit hash count as equal. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    similarity = percent / 100
    known = frequent_shingles(docs, shingle)
    sets = durable(shingle_sets(docs, shingle, rare_prefix(similarity, *known)), "sets")
    worded = sets.where("n > 0")
    firsts = F.min(F.struct("doc_id", "n", "sketch", "counts")).alias("f")
    firsts = durable(worded.groupBy("node").agg(firsts).select("node", "f.*"), "firsts")
    _, rows = short_lists(docs, worded, shingle, similarity, *known)
    rows = durable(rows, "short_lists")

    first = durable(_near(_star_pairs(rows, similarity).distinct(), firsts, similarity), "pairs")
    linked = durable(_reaching(first, docs, firsts, shingle, percent), "links")
    labels = durable(connected_components(linked), "labels").toDF("node", "label")
    named = durable(rows.join(labels, "node", "left").select("key", "node", "n", "at", F.coalesce("label", "node").alias("c")), "named")
    others = _candidates(named).join(first, ["u", "v"], "left_anti")
    others = durable(_near(others, firsts, similarity), "candidates")
    linked = linked.union(durable(_reaching(others, docs, firsts, shingle, percent), "links"))
    labels = durable(connected_components(linked), "labels").toDF("node", "label")

    label = F.coalesce("label", "node")
    nodes = durable(firsts.select("node", F.col("doc_id").alias("first_id")).join(labels, "node", "left").select("node", "first_id", label.alias("label")), "nodes")
    groups = durable(nodes.groupBy("label").agg(F.min("first_id").alias("component_id")), "groups")
    named = durable(nodes.join(groups, "label").select("node", "component_id"), "components")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return sets.select("doc_id", "node", "n").join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own)
