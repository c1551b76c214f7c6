"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import durable

TABLES = 2
#: Recall that a sample must show for the number of probes to be taken.
RECALL = 0.95
#: Rows of that sample, its bytes, and how many of its rows are searched for.
SAMPLE, SAMPLE_BYTES, SAMPLE_QUERIES = 8192, 16 << 20, 256
#: Signed axes of a table whose rows are dealt together.
GROUP = 16
SEED = 3
#: Candidates, and queries, that one task compares at a time.
BLOCK = 4096
#: Scores nearer than this are told apart by the exact sum over the original vectors.
_CLOSE = 1e-9


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(rows, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, width)
        half *= 2
    return x / np.sqrt(width)


def rotate(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-rotation of a table: three rounds of random signs and a Hadamard transform."""
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    for signs in np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, width)):
        out = _hadamard(out * signs)
    return out


def nearest_axes(rotated: np.ndarray, probes: int) -> np.ndarray:
    """The signed axes nearest to each row, best first: axis i is 2 i, its negative 2 i + 1."""
    probes = min(probes, rotated.shape[1])
    order = np.argsort(-np.abs(rotated), axis=1, kind="stable")[:, :probes]
    return order * 2 + (np.take_along_axis(rotated, order, axis=1) < 0)


def _unpacked(packed: list[bytes], dtype: str) -> np.ndarray:
    """Rows of vectors of one length as doubles, each scaled by a power of two so that its largest component is near 1."""
    x = np.frombuffer(b"".join(packed), dtype=dtype).reshape(len(packed), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _packed(rows: DataFrame, dtype: str, tables: int, probes: int, seed: int) -> DataFrame:
    """``(id, v)`` -> ``(id, v, axes)``: vectors as bytes, and for each table an array of the ``probes`` nearest axes."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                flat = np.asarray(batch.column(1).flatten(), dtype=dtype)
                ends = np.cumsum(np.asarray([len(v) for v in batch.column(1)], dtype=np.int64))
                packed = [x.tobytes() for x in np.split(flat, ends[:-1])] if len(ends) else []
                axes: list[list] = [[]] * len(packed)
                sizes = np.array([len(p) for p in packed])
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    codes = _axes(_unpacked([packed[i] for i in own], dtype), tables, probes, seed)
                    for i, code in zip(own, codes.tolist(), strict=True):
                        axes[i] = code
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(axes, pa.list_(pa.list_(pa.int32())))], ["id", "v", "axes"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(one, f"id {kind}, v binary, axes array<array<int>>")


def _axes(x: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """(row, table, probe): the signed axes nearest to each row in each table."""
    return np.stack([nearest_axes(rotate(x, table, seed), probes) for table in range(tables)], axis=1)


def measured_probes(candidates: DataFrame, dtype: str, k: int, tables: int, seed: int) -> int:
    """The least number of probes with which a sample of the rows finds ``RECALL`` of its nearest neighbours.

    The sample is of at most ``SAMPLE`` rows and ``SAMPLE_BYTES`` bytes. Rows have farther neighbours in it
    than among all rows, so it asks for too many probes rather than too few. It decides how many
    rows are compared, nothing else; where it has too few rows, every axis is asked for.
    """
    most = candidates.agg(F.max(F.octet_length("v"))).first()[0]
    if most is None:
        return 1
    rows = max(64, min(SAMPLE, SAMPLE_BYTES // most))
    order = [F.xxhash64("id"), F.xxhash64("v"), F.col("v")]
    taken = candidates.select("v", *[x.alias(f"o{i}") for i, x in enumerate(order)]).orderBy("o0", "o1", "o2").limit(rows).select("v").toArrow()
    packed = sorted(set(taken.column("v").to_pylist()))  # copies would make it look easy
    sizes, counts = np.unique([len(x) for x in packed], return_counts=True)
    x = _unpacked([p for p in packed if len(p) == sizes[counts.argmax()]], dtype)
    width = rotate(x[:1], 0, seed).shape[1]
    if len(x) <= k:
        return width
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    asked = x[:SAMPLE_QUERIES]
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    own, probed = _axes(x, tables, 1, seed)[:, :, 0], _axes(asked, tables, width, seed)
    # at which probe of a query each of its neighbours is met, in the table where that is earliest
    met = (probed[:, None] == own[best][:, :, :, None]).argmax(axis=3) + np.where((probed[:, None] == own[best][:, :, :, None]).any(axis=3), 0, width)
    return int(min(width, np.quantile(met.min(axis=2), RECALL, method="higher") + 1))


def _dealt(rows: DataFrame, own: str, other: str, sizes: DataFrame) -> DataFrame:
    """Deal rows of (bucket, table, part) to blocks; each meets every block of the other side."""
    mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
    return rows.join(sizes, ["bucket", "table", "part"]).withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))


def _compare(k: int, dtype: str):
    """Of one block of candidates and one of queries, each query's k nearest of those on the axes that it asks for."""

    def one(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", queries.schema.field("id").type), ("vec_id", candidates.schema.field("id").type), ("score", pa.float64())])
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        c, q = (_unpacked(t["v"].to_pylist(), dtype) for t in (candidates, queries))
        ids, asked, axis = np.asarray(candidates["id"]), np.asarray(queries["id"]), np.asarray(candidates["axis"])
        order = np.lexsort((ids, axis))
        ids, c, axis = ids[order], c[order], axis[order]
        cn, qn = (np.sqrt((x * x).sum(axis=1)) for x in (c, q))
        unit = c / cn[:, None]
        bounds = np.append(np.flatnonzero(np.append(True, axis[1:] != axis[:-1])), len(axis))
        wanted = np.zeros((len(q), GROUP), dtype=bool)
        for i, own in enumerate(queries["axes"].to_pylist()):
            wanted[i, np.array(own) % GROUP] = True
        found: list[tuple] = []
        for at in range(0, len(q), 256):
            block, near = q[at : at + 256], np.full((len(q[at : at + 256]), len(c)), -np.inf)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # the rows of one axis, with the queries that ask for it
                some = np.flatnonzero(wanted[at : at + 256, axis[a] % GROUP])
                near[some, a:b] = (block[some] @ unit[a:b].T) / qn[at + some, None]
            near[asked[at : at + 256, None] == ids] = -np.inf
            for i, row in enumerate(near, start=at):
                # the k best and all that come close to the last of them, in the order of ids
                edge = np.partition(row, -k)[-k] if len(row) > k else -2.0
                some = np.flatnonzero(row >= max(edge - _CLOSE, -2.0))
                some = some[np.argsort(ids[some], kind="stable")]
                exact = (c[some] * q[i]).sum(axis=1) / (cn[some] * qn[i])
                best = some[np.argsort(-exact, kind="stable")[:k]]
                found += zip([asked[i]] * k, ids[best], np.sort(exact)[::-1][:k], strict=False)
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return one


def _on_tables(rows: DataFrame, every_axis: bool = False) -> DataFrame:
    """``(id, v, bucket, table, part, axes)``: a row for each table and each group of axes in which it has some.

    With ``every_axis`` it has all axes of the first table.
    """
    width = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("length"), F.lit(2))))).cast("int")
    tables = F.array(F.sequence(F.lit(0), 2 * width - 1)) if every_axis else F.col("axes")
    out = rows.withColumn("bucket", F.octet_length("v")).select("id", "v", "bucket", F.posexplode(tables).alias("table", "own"))
    part = F.array_distinct(F.transform("own", lambda x: F.floor(x / GROUP).cast("int")))
    out = out.withColumn("part", F.explode(part))
    return out.withColumn("axes", F.filter("own", lambda x: F.floor(x / GROUP) == F.col("part"))).drop("own")


def _search(candidates: DataFrame, queries: DataFrame, k: int, dtype: str) -> DataFrame:
    """Both sides as ``_on_tables`` gives them -> each query's k nearest in every block of every group of axes."""
    key = ["bucket", "table", "part"]
    blocks = lambda df, to: df.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(to))
    sizes = durable(blocks(candidates, "c_block").join(blocks(queries, "q_block"), key), "sizes")  # a row for each length, table and group
    kind = candidates.schema["id"].dataType.simpleString()
    left = _dealt(candidates.withColumn("axis", F.get("axes", F.lit(0))).drop("axes"), "c_block", "q_block", sizes).groupBy(*key, "c_block", "q_block")
    right = _dealt(queries, "q_block", "c_block", sizes).groupBy(*key, "c_block", "q_block")
    return left.cogroup(right).applyInArrow(_compare(k, dtype), f"query_id {kind}, vec_id {kind}, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows found for each row where ``is_query``.

    Nearness is the cosine of the original vectors in doubles; ties go to the smaller id, and rows
    with the query's own id are no candidates. Every row is in each table under the nearest signed
    axis after the table's pseudo-rotation; a query asks for its ``probes`` nearest axes in each, as many
    as a bounded sample needs for a recall of 0.95 (``measured_probes``) if not given. Rows are dealt by
    (table, group of axes), large groups in blocks, and sent once for each table and block of queries;
    a query goes to the groups with axes that it asks for. There it is multiplied with the rows on
    these axes and no others. No task holds more than a block of each side, however many rows an axis has.
    A query that met fewer than k candidates is compared with all rows, in blocks too.
    Vectors null, empty, zero or with a null or non-finite component, and rows with a null id, take
    no part; vectors of different lengths are never compared. Of rows with the same id and equal
    vectors one is returned. No queries give an empty result; other columns are ignored.
    """
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & sound)
    dtype = "f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "f8"
    candidates = durable(_packed(rows.select("id", "v"), dtype, tables, 1, seed), "vectors")
    probes = probes or measured_probes(candidates, dtype, k, tables, seed)
    queries = durable(_packed(rows.where("asks").select("id", "v"), dtype, tables, probes, seed), "queries")
    ranked = durable(_ranked(_search(_on_tables(candidates), _on_tables(queries), k, dtype), k), "neighbours")
    few = queries.join(ranked.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    few = durable(few, "few")
    if few.limit(1).count():
        met = few.select(F.col("id").alias("query_id"))
        length = F.octet_length("v") / int(dtype[1])
        every = _on_tables(few.withColumn("length", length), every_axis=True)
        own = _on_tables(candidates.withColumn("axes", F.slice("axes", 1, 1)))
        ranked = ranked.join(met, "query_id", "left_anti").unionByName(_ranked(_search(own, every, k, dtype), k))
    return ranked.select("query_id", "rank", "vec_id", "score")
