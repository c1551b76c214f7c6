"""Collocations: counts of all phrases as range transducers, scored by lookups of their parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import durable
from .textbatch import ASCII_LOWER, bounded_batches, byte_table, chunks, mix, runs, span_hashes
from .transducer import PAD, CountTransducer, built, in_order, ranges, union

_BLANK = byte_table([32, 9])
_CUT = byte_table(b".,;:!?\n\v\f\r")
#: Words of more bytes are hashed one by one.
LONG_WORD = 4096
#: Word numbers in the phrases that a shard counts at a time, and phrases of a range in memory before they are united.
SHARD, RANGE = 1 << 21, 1 << 20
#: The commonest words, whose phrases are dealt to several ranges by their second word.
HOT, SLOTS = 1000, 64
#: Bits of the filter of frequent phrases, at most (8 MB).
FILTER_BITS = 26
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_TRANSDUCER = "lang string, bucket int, first array<int>, labels array<bigint>, targets array<int>, final array<boolean>, counts array<bigint>"
_NAMES = [f.split(" ")[0] for f in _TRANSDUCER.split(", ")]


def _base(seed: int) -> int:
    """The odd number that words are hashed with."""
    return xxhash.xxh64_intdigest(f"words {seed}") | 1


def _word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit number of each word, the same wherever it stands; a window of the bytes at a time."""
    out = np.zeros(len(starts), dtype=np.uint64)
    short = np.flatnonzero(ends - starts <= LONG_WORD)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    cuts = np.flatnonzero(np.diff(starts[short] >> 20)) + 1
    for part in np.split(short, cuts):
        if len(part):
            lo, hi = starts[part[0]], ends[part[-1]]
            out[part] = span_hashes(data[lo:hi], starts[part] - lo, ends[part] - lo, _base(seed))
    numbers = out.view(np.int64)
    numbers[numbers == PAD] += 1
    return numbers


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each chunk of a text column: its first row, lower-cased bytes, the words' starts, ends, rows and pieces."""
    for chunk in chunks(column):
        low = ASCII_LOWER[chunk.data]
        cut = _CUT[low]
        starts, ends, first = runs(~(cut | _BLANK[low]), chunk.offsets)
        row = np.repeat(np.arange(len(chunk)), np.diff(first))
        yield chunk.first, low, starts, ends, row, np.searchsorted(np.flatnonzero(cut), starts)


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The languages of a batch, and the place of each row's in them; null is ``und``."""
    coded = pc.fill_null(column.cast(pa.string()), "und").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def word_counts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``(lang, word, number, f)``: how often each word occurs in each language; numbers are 64-bit hashes.

    ``docs`` is (lang, text).
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes = _languages(batch.column(0))
            for first, low, starts, ends, row, _ in _words(batch.column(1)):
                lang = codes[first + row]
                for code in np.unique(lang):
                    at = np.flatnonzero(lang == code)
                    numbers = _word_numbers(low, starts[at], ends[at], seed)
                    found, where, count = np.unique(numbers, return_index=True, return_counts=True)
                    raw = low.tobytes()
                    words = [raw[a:b].decode() for a, b in zip(starts[at[where]].tolist(), ends[at[where]].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([names[code]] * len(found)), pa.array(words), pa.array(found), pa.array(count)], ["lang", "word", "number", "f"])

    rows = bounded_batches(docs).mapInArrow(one, "lang string, word string, number bigint, f bigint")
    return rows.groupBy("lang", "word", "number").agg(F.sum("f").alias("f"))


def _keys(langs: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """One 64-bit key for each phrase of a language."""
    key = langs.copy()
    for column in grams.T:
        key = mix(key * _MULTIPLIER + np.where(column == PAD, 0, column).astype(np.int64).view(np.uint64))
    return key


def _lang_key(name: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(name))


class Frequent:
    """Which phrases may be frequent: a table of bits of a fixed size, sent to all tasks.

    Two bits a phrase. It lets more through than it must, never less, so it spares counting only.
    """

    def __init__(self, grams: DataFrame, width: int):
        """grams: ``(lang, labels)``."""
        n = grams.count()
        self.bits = min(FILTER_BITS, max(16, (16 * n).bit_length()))
        self.width = width
        bits = self.bits

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, codes = _languages(batch.column(0))
                labels = np.asarray(batch.column(1).flatten()).astype(np.int64).reshape(batch.num_rows, width)
                places = np.unique(np.concatenate(_places(_keys(np.array([_lang_key(x) for x in names] or [0], dtype=np.uint64)[codes], labels), bits)))
                mask = np.left_shift(np.uint64(1), (places & 63).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array(mask)], ["slot", "mask"])

        slots = grams.select("lang", "labels").mapInArrow(one, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
        table = np.zeros(1 << (bits - 6), dtype=np.uint64)
        table[slots["slot"].to_numpy()] = slots["mask"].to_numpy().astype(np.int64).view(np.uint64)
        self.table = grams.sparkSession.sparkContext.broadcast(table)

    def has(self, langs: np.ndarray, grams: np.ndarray) -> np.ndarray:
        table = self.table.value
        inside = np.ones(len(grams), dtype=bool)
        for places in _places(_keys(langs, grams), self.bits):
            inside &= (table[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1
        return inside


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((keys >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift in (0, 64 - bits)]


def _row(lang: str, bucket: int, t: CountTransducer) -> tuple:
    return lang, bucket, t.first.astype(np.int32), t.labels, t.targets.astype(np.int32), t.final, t.counts


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def _transducer(batch: pa.RecordBatch | pa.Table, i: int) -> CountTransducer:
    own = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(2, 7)]
    return CountTransducer(own[0].astype(np.int64), own[1].astype(np.int64), own[2].astype(np.int64), own[3].astype(bool), own[4].astype(np.int64))


def hot_words(words: DataFrame) -> np.ndarray:
    """The keys of the ``HOT`` commonest words, ascending."""
    top = words.orderBy(F.desc("f"), "lang", "number").limit(HOT).select("lang", "number").collect()
    return np.sort(_keys(np.array([_lang_key(r.lang) for r in top], dtype=np.uint64), np.array([[r.number] for r in top], dtype=np.int64).reshape(-1, 1)))


def _buckets(langs: np.ndarray, grams: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    """The range that a phrase is counted in: by its first word, and by its second one too if that first word is hot."""
    keys = _keys(langs, grams[:, :1])
    if grams.shape[1] > 1 and len(hot):
        more = (hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys) & (grams[:, 1] != PAD)
        keys[more] = mix(keys[more] * _MULTIPLIER + (grams[more, 1] % SLOTS).astype(np.uint64))
    return (keys % np.uint64(buckets)).astype(np.int32)


def _shard_transducers(docs: DataFrame, orders: tuple[int, ...], frequent: Frequent, buckets: int, hot: np.ndarray, seed: int) -> DataFrame:
    """Count transducers of the phrases of ``orders`` words, one for each shard, language and prefix range.

    Of a phrase longer than those in ``frequent`` every part of their length must be in it. Occurrences are
    held as word numbers; ``SHARD`` numbers at a time are sorted and go out as transducers.
    """
    width = max(orders)

    def counted(names: list[str], held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        lang, grams = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        place = lang * np.int64(buckets)
        place += _buckets(np.array([_lang_key(x) for x in names], dtype=np.uint64)[lang], grams, buckets, hot)
        del lang
        order = in_order(grams, place)
        place, grams = place[order], grams[order]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (grams[1:] != grams[:-1]).any(axis=1)])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(place)))
        place, grams = place[at], grams[at]
        cuts = np.flatnonzero(np.diff(place)) + 1
        rows, size = [], 0
        for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
            rows.append(_row(names[place[a] // buckets], int(place[a] % buckets), built(grams[a:b], counts[a:b])))
            size += b - a
            if size > 1 << 16:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            own, codes = _languages(batch.column(0))
            names += [x for x in own if x not in names]
            codes = np.array([names.index(x) for x in own] or [0], dtype=np.int32)[codes]
            for first, low, starts, ends, row, piece in _words(batch.column(1)):
                numbers = _word_numbers(low, starts, ends, seed)
                lang = codes[first + row]
                keys = np.array([_lang_key(x) for x in names], dtype=np.uint64)[lang]
                n = len(numbers)
                # in how many of the following places a part of the filter's length begins, without a break
                m = frequent.width
                whole = np.zeros(n, dtype=bool)
                if n >= m:
                    parts = np.stack([numbers[i : n - m + 1 + i] for i in range(m)], axis=1)
                    same = (row[: n - m + 1] == row[m - 1 :]) & (piece[: n - m + 1] == piece[m - 1 :])
                    whole[: n - m + 1][same] = frequent.has(keys[: n - m + 1][same], parts[same])
                for k in orders:
                    if n < k:
                        continue
                    good = np.ones(n - k + 1, dtype=bool)
                    for i in range(k - m + 1):
                        good &= whole[i : n - k + 1 + i]
                    good &= (row[: n - k + 1] == row[k - 1 :]) & (piece[: n - k + 1] == piece[k - 1 :])
                    at = np.flatnonzero(good)
                    grams = np.full((len(at), width), PAD, dtype=np.int64)
                    for i in range(k):
                        grams[:, i] = numbers[at + i]
                    held.append((lang[at], grams))
                    size += len(at)
                if size * width >= SHARD:
                    yield from counted(names, held)
                    size = 0
        if size:
            yield from counted(names, held)

    return bounded_batches(docs).mapInArrow(one, _TRANSDUCER)


def _unite(width: int, least: int):
    """Transducers in the order of (lang, bucket) -> one for each, of the phrases whose counts add up to ``least``."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        parts: list[CountTransducer] = []
        held = 0

        def whole() -> pa.RecordBatch:
            grams, counts = union(parts, width)
            often = counts >= least
            return _batch([_row(*at, built(grams[often], counts[often]))] if often.any() else [])

        for batch in batches:
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key != at:
                    if parts:
                        yield whole()
                    at, parts, held = key, [], 0
                parts.append(_transducer(batch, i))
                held += len(parts[-1].counts)
                if held >= RANGE:
                    parts = [built(*union(parts, width))]
                    held = len(parts[0].counts) // 2
        if parts:
            yield whole()

    return one


def range_transducers(docs: DataFrame, orders: tuple[int, ...], frequent: Frequent, least: int, buckets: int, hot: np.ndarray, seed: int) -> DataFrame:
    """One count transducer for each language and prefix range: the shards' ones united, weights summed.

    A range has the phrases whose first word falls into it; those of the commonest words are dealt
    to many ranges by their second word. Occurrences of a common phrase are summed in the shards.
    """
    shards = _shard_transducers(docs, orders, frequent, buckets, hot, seed)
    dealt = shards.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return dealt.mapInArrow(_unite(max(orders), least), _TRANSDUCER)


def phrases(transducers: DataFrame) -> DataFrame:
    """``(lang, labels, f)``: the phrases of transducers and their counts."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang in enumerate(batch.column(0).to_pylist()):
                grams, counts = _transducer(batch, i).phrases()
                sizes = (grams != PAD).sum(axis=1)
                labels = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(grams[grams != PAD]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), labels, pa.array(counts)], ["lang", "labels", "f"])

    return transducers.mapInArrow(one, "lang string, labels array<bigint>, f bigint")


def _composed(width: int):
    """One range's transducers and the parts that are looked up in it -> (lang, labels, k, side, part count)."""

    def one(counts: pa.Table, asked: pa.Table) -> pa.Table:
        found = np.zeros(asked.num_rows, dtype=np.int64)
        if asked.num_rows:
            parts = asked["part"].combine_chunks()
            sizes = pc.list_value_length(parts).to_numpy()
            grams = np.full((asked.num_rows, width), PAD, dtype=np.int64)
            grams[np.repeat(np.arange(len(sizes)), sizes), ranges(np.zeros_like(sizes), sizes)] = parts.flatten().to_numpy()
            order = in_order(grams)
            for i in range(counts.num_rows):
                found[order] += _transducer(counts, i).compose(grams[order])
        return pa.table({"lang": asked["lang"], "labels": asked["labels"], "a": asked["a"], "k": asked["k"], "side": asked["side"], "f": pa.array(found)})

    return one


def _parts(buckets: int, hot: np.ndarray):
    """Phrases -> for each cut its first and second part, with the range that has it."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            parts: list[list[int]] = []
            for lang, labels, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(1, len(labels)):
                    for side, part in enumerate((labels[:k], labels[k:])):
                        rows.append((lang, labels, a, k, side))
                        parts.append(part)
            grams = np.full((len(parts), 2), PAD, dtype=np.int64)
            for i, part in enumerate(parts):
                grams[i, : len(part[:2])] = part[:2]
            keys = {x: _lang_key(x) for x in {r[0] for r in rows}}
            bucket = _buckets(np.array([keys[r[0]] for r in rows], dtype=np.uint64), grams, buckets, hot)
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = [pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array(parts, pa.list_(pa.int64())), pa.array(bucket)], ["lang", "labels", "a", "k", "side", "part", "bucket"])

    return one


def score_phrases(found: DataFrame, transducers: DataFrame, buckets: int, hot: np.ndarray, scale: int = 2_000_000) -> DataFrame:
    """``(lang, labels, a, l, r, score)`` of ``(lang, labels, f)``: the lowest-scoring cut of each phrase.

    score is the floor of ``scale`` a / (l + r); ties go to the shortest first part. Each part is looked up
    in its range by leading all parts of the range through its transducer.
    """
    kinds = "lang string, labels array<bigint>, a bigint, k int, side int"
    asked = found.select("lang", "labels", F.col("f").alias("a")).mapInArrow(_parts(buckets, hot), f"{kinds}, part array<bigint>, bucket int")
    keys = ["lang", "bucket"]
    looked = transducers.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_composed(4), f"{kinds}, f bigint")
    cuts = looked.groupBy("lang", "labels", "a", "k").agg(F.sum(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.sum(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    wide = lambda x: F.col(x).cast("decimal(25,0)")
    cuts = cuts.withColumn("up", (wide("a") * F.lit(scale).cast("decimal(10,0)")).cast("decimal(38,0)")).withColumn("down", wide("l") + wide("r"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    return cuts.groupBy("lang", "labels", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "labels", "a", "c.l", "c.r", "c.score")


def _not_inside_longer(scored: DataFrame, percent: int) -> DataFrame:
    """Phrases without those that stand in a longer one with ``percent`` of their count or more."""
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.transform(F.sequence(F.lit(2), F.size("labels")), lambda n: F.slice("labels", i, n)))),
        lambda x: (F.size(x) >= 2) & (F.size(x) < F.size("labels")),
    )
    longer = scored.where(F.size("labels") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("labels"), F.col("a").alias("longer"))
    most = longer.groupBy("lang", "labels").agg(F.max("longer").alias("longer"))
    wide = lambda x: F.col(x).cast("decimal(25,0)")
    inside = F.coalesce(wide("longer") * 100 >= wide("a") * percent, F.lit(False))
    return scored.join(most, ["lang", "labels"], "left").where(~inside).drop("longer")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, scale: int = 2_000_000, percent: int = 80, buckets: int | None = None
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of two to four words.

    Texts (null: empty) are lower-cased (A-Z), cut at ``.,;:!?`` and the controls 10 to 13, and split at
    blanks and tabs; all counts are per language (null: ``und``). a is how often a phrase occurs within pieces,
    overlaps included, at least ``least``; l and r are the counts of the two parts of the cut that
    scores lowest, n all words. Phrases inside a longer one that is ``percent`` as frequent go. Order: score, a,
    then the phrase's bytes. Rows may repeat (they count again); other columns are ignored; no texts, no rows.

    Three passes over the texts count words, pairs, then three and four words, each leaving out what holds an
    infrequent shorter part. In a pass each shard builds transducers of its sorted phrases, by prefix range;
    these are united, weights summed, and the parts of phrases are looked up by composition. Words are
    64-bit numbers in between; if two words of a language have one number, all is done anew with others.
    ``buckets`` prefix ranges (twice the session's shuffle partitions) bound what one task holds.
    """
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    buckets = buckets or 2 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for seed in range(8):
        words = durable(word_counts(docs, seed), "words")
        if words.groupBy("lang", "number").count().where("count > 1").isEmpty():
            break
    often = words.where(F.col("f") >= least)
    hot = hot_words(words)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    first = durable(range_transducers(docs, (1, 2), Frequent(often.select("lang", F.array("number").alias("labels")), 1), least, buckets, hot, seed), "ranges")
    pairs = durable(phrases(first).where(F.size("labels") == 2), "phrases")
    second = durable(range_transducers(docs, (3, 4), Frequent(pairs, 2), least, buckets, hot, seed), "ranges")
    found = pairs.unionByName(phrases(second))
    scored = durable(score_phrases(found, first.unionByName(second), buckets, hot, scale), "scored")

    kept = durable(_not_inside_longer(scored, percent), "kept")
    spelt = kept.select("lang", "labels", F.posexplode("labels").alias("i", "number")).join(often.select("lang", "number", "word"), ["lang", "number"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
    named = kept.join(spelt.groupBy("lang", "labels").agg(text.alias("phrase")), ["lang", "labels"]).join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
