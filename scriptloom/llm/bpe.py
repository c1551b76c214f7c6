"""Byte-pair encoding by speculation: greedy tokens, checked pairwise; exact merging where that fails."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import bounded_batches

#: White space as the tokenizer's normaliser sees it (Unicode White_Space).
_SPACE = regex.compile("[\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: str.split() splits at these as well.
_NOT_SPACE = regex.compile("[\\x1c-\\x1f]")
#: Distinct chunks that a worker remembers of late; up to twice as many in all.
CACHE = 120_000
#: Words of more letters are merged by a heap, and aren't remembered after their texts.
LONG = 100
_NEVER = 1 << 60


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


class Vocabulary:
    """Merges of a tokenizer file with word ends, as tables for proposing, checking and merging."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letters = dict(enumerate(_byte_letters()))
        self.base = size
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([self.ids[b] for _, b in merges], dtype=np.int64)
        made = np.array([self.ids[a + b] for a, b in merges], dtype=np.int64)
        self.made = made.tolist()
        keys = left * size + right
        self.rank = {k: i for i, k in reversed(list(enumerate(keys.tolist())))}
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int64)
        # the merge that makes each token; single letters have none and rank -1
        self.made_at = np.full(size, -1, dtype=np.int64)
        self.half = np.stack([np.arange(size), np.arange(size)])
        self.odd = np.zeros(size, dtype=bool)
        for k in range(len(merges)):
            c = made[k]
            if self.made_at[c] >= 0:
                self.odd[c] = True  # two merges make it: a pair check can't tell which did
                continue
            self.made_at[c] = k
            self.half[:, c] = left[k], right[k]
        self.size = np.zeros(size, dtype=np.int64)  # letters of a token, its word end counted as one
        self.matcher = ahocorasick.Automaton()
        for token, i in self.ids.items():
            letters = token.removesuffix(self.end)
            if self.made_at[i] < 0 and len(letters) > 1:
                self.odd[i] = True  # in the vocabulary, but no merge makes it
            marked = letters + "\n" if letters != token else token
            self.size[i] = len(marked)
            self.matcher.add_word(marked, i)
        self.matcher.make_automaton()

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of words in byte letters, all in one scan, and the word of each token."""
        text = "\n".join([*words, ""])
        found = np.array([(at, token) for at, token in self.matcher.iter_long(text)], dtype=np.int64).reshape(-1, 2)
        ends = np.cumsum(np.array([len(w) + 1 for w in words], dtype=np.int64))
        return found[:, 1], np.searchsorted(ends, found[:, 0], side="right")

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the letters of tokens a and b ends with just these two tokens.

        Walks down the two tokens' merge trees from the seam, the later merge first. At each step
        the parts at the seam must not have a merge that comes before the merges that hid them.
        """
        ok = np.ones(len(a), dtype=bool)
        ok[self.odd[a] | self.odd[b]] = False
        live = np.flatnonzero(ok)
        x, y = a[live].copy(), b[live].copy()
        limit = np.full(len(live), np.iinfo(np.int64).max)
        strict = np.zeros(len(live), dtype=bool)  # on a tie of rank the left seam merges first
        while len(live):
            key = x * self.base + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.key_rank[at], np.iinfo(np.int64).max)
            bad = (rank < limit) | ((rank == limit) & strict)
            bad &= rank < np.iinfo(np.int64).max
            ok[live[bad]] = False
            rx, ry = self.made_at[x], self.made_at[y]
            more = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            down = rx >= ry  # of two equal merges the left one comes first, so the right one is undone first
            down &= ~((rx == ry) & (rx >= 0))
            limit = np.where(down, rx, ry)
            # undoing the right token's merge: the seam merge would come first on a tie, being further left
            strict = ~down
            x = np.where(down, self.half[1][x], x)
            y = np.where(down, y, self.half[0][y])
        return ok

    def merge(self, word: str) -> list[int]:
        """Exact merging: the earliest merge, leftmost first, until none applies."""
        parts = [self.ids[u] for u in (*word[:-1], word[-1] + self.end)]
        if len(parts) > LONG:
            return self._merge_long(parts)
        rank, base = self.rank.get, self.base
        ranks = [rank(a * base + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < _NEVER:
            i = ranks.index(best)
            made = parts[i] = self.made[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] * base + made, _NEVER)
            if i < len(ranks):
                ranks[i] = rank(made * base + parts[i + 1], _NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same for long words: a heap of the merges that apply, over parts linked to their neighbours."""
        rank, base, n = self.rank.get, self.base, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a * base + b, _NEVER)) < _NEVER]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or rank(parts[i] * base + parts[j]) != best:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = self.made[best], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(parts[i] * base + parts[k], _NEVER)) < _NEVER:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank(parts[h] * base + parts[i], _NEVER)) < _NEVER:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of words in byte letters.

        A proposal holds if its tokens tile the word and every adjacent pair is compatible.
        """
        flat, owner = self.propose(words)
        tiled = np.bincount(owner, self.size[flat], minlength=len(words))
        failed = tiled != np.array([len(w) + 1 for w in words])
        failed[owner[self.odd[flat]]] = True
        seam = np.flatnonzero(owner[1:] == owner[:-1])
        pair, back = np.unique(flat[seam] * self.base + flat[seam + 1], return_inverse=True)
        fits = self.compatible(pair // self.base, pair % self.base)[back]
        failed[owner[seam[~fits]]] = True
        ends = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        tokens = flat.tolist()
        return [
            self.merge(w) if bad else tokens[a:b]
            for w, bad, a, b in zip(words, failed.tolist(), ends, ends[1:])
        ]


class Encoder:
    """Encodes texts chunk by chunk; a chunk is a run without white space.

    What is learnt about chunks and words is kept in two generations: when the newer one is full
    it becomes the older, which is let go, but for what is asked for again.
    """

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.vocabulary, self.limit = vocabulary, cache
        #: chunk -> (its ids as text, its tokens as text, how many), both led by a blank
        self.known: dict[str, tuple[str, str, int]] = {}
        self.before: dict[str, tuple[str, str, int]] = {}
        #: chunks and words of more than LONG letters, met since the last texts
        self.long: list[str] = []
        #: word -> the same
        self.words: dict[str, tuple[str, str, int]] = {}
        self.words_before: dict[str, tuple[str, str, int]] = {}

    def _learn(self, chunks: list[str]) -> None:
        if len(self.words) > self.limit:
            self.words, self.words_before = {}, self.words
        v, words, before = self.vocabulary, self.words, self.words_before
        split = []
        for chunk in chunks:
            if chunk.isalpha() and chunk.isascii():
                split.append([chunk.lower()])
            elif chunk[:-1].isalpha() and chunk.isascii():  # a word and one sign: a digit or a mark
                split.append([chunk[:-1].lower(), chunk[-1]])
            else:
                split.append(v.words.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()))
        new = []
        for word in dict.fromkeys(w for own in split for w in own if w not in words):
            if word in before:
                words[word] = before[word]
            else:
                new.append(word)
        self.long += [w for w in new if len(w) > LONG]
        if new:
            plain = [w if w.isascii() and w.isprintable() else "".join(map(v.letters.__getitem__, w.encode())) for w in new]
            for word, found in zip(new, v.encode_words(plain), strict=True):
                words[word] = ("".join([f" {t}" for t in found]), "".join([f" {v.tokens[t]}" for t in found]), len(found))
        for chunk, own in zip(chunks, split, strict=True):
            if len(own) == 1:
                self.known[chunk] = words[own[0]]
            else:
                found = [words[w] for w in own]
                self.known[chunk] = ("".join([x[0] for x in found]), "".join([x[1] for x in found]), sum([x[2] for x in found]))

    def _meet(self, chunks: set[str]) -> None:
        """Make sure that all these chunks are known."""
        if len(self.known) > self.limit:
            self.known, self.before = {}, self.known
        new = []
        for chunk in chunks:
            if chunk in self.known:
                continue
            if chunk in self.before:
                self.known[chunk] = self.before[chunk]
            elif chunk in self.vocabulary.special:
                self.known[chunk] = (f" {self.vocabulary.special[chunk]}", f" {chunk}", 1)
            else:
                new.append(chunk)
        self.long += [c for c in new if len(c) > LONG]
        if new:
            self._learn(new)

    def split(self, text: str) -> list[str]:
        """Chunks of a text, special tokens apart."""
        if "<|" in text:
            out = []
            for part in self.vocabulary.marks.split(text):
                out += [part] if part in self.vocabulary.special else self._split(part)
            return out
        return self._split(text)

    @staticmethod
    def _split(text: str) -> list[str]:
        if _NOT_SPACE.search(text):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str, int]]:
        """(ids joined by blanks, tokens joined by blanks, number of tokens) of each text."""
        parts = [self.split(t) for t in texts]
        self._meet({c for p in parts for c in p})
        known = self.known
        for own in parts:
            found = [known[c] for c in own]
            yield (
                "".join([x[0] for x in found])[1:],
                "".join([x[1] for x in found])[1:],
                sum([x[2] for x in found]),
            )
        for c in self.long:
            known.pop(c, None)
            self.words.pop(c, None)
        self.long.clear()


@functools.lru_cache(maxsize=1)
def _encoder(content: str) -> Encoder:
    """A worker process keeps its encoder, and so the chunks that it knows, from task to task."""
    return Encoder(Vocabulary(content))


#: Bytes of text that are encoded together.
_GROUP = 2 << 20


def _groups(column: pa.Array) -> Iterator[list[str]]:
    out, size = [], 0
    for value in column:
        text = value.as_py() or ""
        out.append(text)
        size += len(text)
        if size >= _GROUP:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode_texts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, [token_ids,] ids_sha256, decoded_sha256``.

    Encodes whole texts as the tokenizer file says (NFC, white space collapsed, lower case, words
    by its pattern, bytes as letters, merges with word ends; no special tokens added, those in a
    text are kept) and decodes them by joining the tokens with blanks. ids_sha256 is of the ids
    joined by blanks, decoded_sha256 of the decoded text. A null text is an empty one. Ids may be
    null or repeated; other columns are ignored; an empty table gives an empty result. A word of any
    length takes time in proportion, but for a logarithm. The file is read once by the driver and sent to
    the tasks as a broadcast (a vocabulary, so its size doesn't follow the data).
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        for batch in batches:
            n, ids, ids_sha, decoded_sha = [], [], [], []
            for texts in _groups(batch.column(1)):
                for own, tokens, count in encoder.encode(texts):
                    n.append(count)
                    if keep_ids:
                        ids.append([int(x) for x in own.split()])
                    ids_sha.append(hashlib.sha256(own.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(tokens.encode()).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64())]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
            columns += [pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    fields = [f"doc_id {kind}", "n_tokens bigint", *["token_ids array<int>"] * keep_ids, "ids_sha256 string", "decoded_sha256 string"]
    names = [f.split()[0] for f in fields]
    return bounded_batches(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(one, ", ".join(fields))


def decode_ids(rows: DataFrame, tokenizer_path: str, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text of an id array: its tokens joined by blanks; null stays null."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokens = F.array(*[F.lit(t) for t in Vocabulary(file.read()).tokens])
    return rows.withColumn(to, F.array_join(F.transform(ids_col, lambda i: F.get(tokens, i)), " "))
