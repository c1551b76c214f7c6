"""Weighted acyclic automata over word numbers: the counts of a sorted set of phrases."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textbatch import mix

#: Stands where a phrase has ended; no word has this number.
PAD = np.iinfo(np.int64).min
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of several ranges, one after the other."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def in_order(grams: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """The order of phrases by their words, after the keys in ``before``."""
    return np.lexsort((*grams.T[::-1], *before[::-1]))


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases in order without repeats, and the sums of their counts."""
    if not len(grams):
        return grams, counts
    order = in_order(grams)
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)]))
    return grams[first], np.add.reduceat(counts, first)


@dataclass
class CountTransducer:
    """A minimal acyclic automaton that maps each phrase to its count.

    State s has the arcs first[s] to first[s + 1], in the order of their labels; the last state is the
    root. The weights on a path, derived from how many phrases each state accepts, add up to the phrase's place
    in sorted order, and ``counts`` has the count at that place. Equal subtrees are one state.
    """

    first: np.ndarray
    labels: np.ndarray
    targets: np.ndarray
    final: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        accepted = self.final.astype(np.int64)
        source = np.repeat(np.arange(len(self.final)), np.diff(self.first))
        for _ in range(64):  # once for each word of the longest phrase
            below = np.concatenate([[0], np.cumsum(accepted[self.targets])])
            now = self.final + below[self.first[1:]] - below[self.first[:-1]]
            if np.array_equal(now, accepted):
                break
            accepted = now
        below = np.concatenate([[0], np.cumsum(accepted[self.targets])])
        self.weights = self.final[source] + below[:-1] - below[self.first[source]]

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases, padded to one width, and their counts."""
        state, place = np.array([len(self.final) - 1]), np.zeros(1, dtype=np.int64)
        words = np.zeros((1, 0), dtype=np.int64)
        found = []
        while len(state):
            ends = self.final[state]
            found.append((words[ends], place[ends]))
            size = self.first[state + 1] - self.first[state]
            arcs, up = ranges(self.first[state], size), np.repeat(np.arange(len(state)), size)
            words = np.concatenate([words[up], self.labels[arcs, None]], axis=1)
            place = place[up] + self.weights[arcs]
            state = self.targets[arcs]
        width = found[-1][0].shape[1]
        grams = np.concatenate([np.pad(w, ((0, 0), (0, width - w.shape[1])), constant_values=PAD) for w, _ in found])
        return grams, self.counts[np.concatenate([p for _, p in found])]

    def compose(self, grams: np.ndarray) -> np.ndarray:
        """The counts of other phrases, all led through the automaton together; 0 for those it doesn't accept."""
        state, place = np.full(len(grams), len(self.final) - 1), np.zeros(len(grams), dtype=np.int64)
        alive = np.ones(len(grams), dtype=bool)
        for column in grams.T:
            going = np.flatnonzero(alive & (column != PAD))
            lo, hi = self.first[state[going]], self.first[state[going] + 1]
            end, wanted = hi, column[going]
            while (lo < hi).any():
                middle = (lo + hi) >> 1
                less = (lo < hi) & (self.labels[np.minimum(middle, len(self.labels) - 1)] < wanted)
                lo, hi = np.where(less, middle + 1, lo), np.where((lo < hi) & ~less, middle, hi)
            found = lo < end
            found[found] = self.labels[lo[found]] == wanted[found]
            alive[going[~found]] = False
            arcs, going = lo[found], going[found]
            place[going] += self.weights[arcs]
            state[going] = self.targets[arcs]
        alive &= self.final[state]
        out = np.zeros(len(grams), dtype=np.int64)
        out[alive] = self.counts[place[alive]]
        return out


class Builder:
    """Builds a transducer from slices of sorted phrases.

    A slice has whole first words: when it has been added, everything below its first words is
    finished, and its states are looked up among those registered so far, deepest first.
    """

    def __init__(self) -> None:
        self.register: dict[tuple[int, int], int] = {}
        self.sizes: list[np.ndarray] = []
        self.labels: list[np.ndarray] = []
        self.targets: list[np.ndarray] = []
        self.final: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.root: list[tuple[np.ndarray, np.ndarray]] = []

    def _states(self, final: np.ndarray, sizes: np.ndarray, labels: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """State numbers of nodes with these arcs (those of one node stand together); new ones are registered."""
        arcs = labels.view(np.uint64) * _ONE + targets.astype(np.uint64) * _TWO
        marks = []
        for k in (1, 2):  # 128 bits in all
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(mix(arcs + np.uint64(k)) * _TWO))])
            ends = np.cumsum(sizes)
            marks.append(total[ends] - total[ends - sizes] + final.astype(np.uint64) * np.uint64(k))
        order = np.lexsort(marks)
        own = [m[order] for m in marks]
        new = np.concatenate([[True], (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])])
        some = order[new]  # a node of each kind
        known = np.fromiter((self.register.setdefault(key, len(self.register)) for key in zip(*(m[some].tolist() for m in marks), strict=True)), np.int64, len(some))
        fresh = np.flatnonzero(known >= sum(map(len, self.final)))
        fresh = fresh[np.argsort(known[fresh], kind="stable")]
        nodes = some[fresh]
        at = ranges((np.cumsum(sizes) - sizes)[nodes], sizes[nodes])
        self.sizes.append(sizes[nodes])
        self.final.append(final[nodes])
        self.labels.append(labels[at])
        self.targets.append(targets[at])
        out = np.empty(len(final), dtype=np.int64)
        out[order] = known[np.cumsum(new) - 1]
        return out

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Add sorted phrases, none of which starts with an earlier slice's word."""
        if not len(grams):
            return
        lengths = (grams != PAD).sum(axis=1)
        changes = grams[1:] != grams[:-1]
        starts, numbers, new = [], [], np.zeros(len(grams), dtype=bool)
        new[0] = True
        for depth in range(grams.shape[1]):
            new[1:] |= changes[:, depth]
            has = new & (lengths > depth)
            starts.append(np.flatnonzero(has))
            numbers.append(np.cumsum(has) - 1)
        labels = targets = np.zeros(0, dtype=np.int64)
        parents = np.zeros(0, dtype=np.int64)
        for depth in reversed(range(grams.shape[1])):
            n = len(starts[depth])
            if not n:
                continue
            final = np.zeros(n, dtype=bool)
            final[numbers[depth][lengths == depth + 1]] = True
            states = self._states(final, np.bincount(parents, minlength=n), labels, targets)
            labels, targets = grams[starts[depth], depth], states
            parents = numbers[depth - 1][starts[depth]] if depth else parents
        self.root.append((labels, targets))
        self.counts.append(counts)

    def finish(self) -> CountTransducer:
        labels, targets = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*self.root, strict=True)) if self.root else (np.zeros(0, dtype=np.int64),) * 2
        sizes = np.concatenate([*self.sizes, [len(labels)]]).astype(np.int64)
        return CountTransducer(
            np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
            np.concatenate([*self.labels, labels]),
            np.concatenate([*self.targets, targets]).astype(np.int64),
            np.concatenate([*self.final, [False]]).astype(bool),
            np.concatenate([np.zeros(0, dtype=np.int64), *self.counts]),
        )


def built(grams: np.ndarray, counts: np.ndarray, slice_size: int = 1 << 18) -> CountTransducer:
    """The transducer of sorted phrases without repeats, added slice by slice."""
    builder = Builder()
    heads = np.flatnonzero(np.concatenate([[True], grams[1:, 0] != grams[:-1, 0]])) if len(grams) else np.zeros(0, dtype=np.int64)
    cuts = np.unique(heads[np.searchsorted(heads, np.arange(slice_size, len(grams), slice_size), side="right") - 1]) if len(grams) > slice_size else []
    for a, b in zip([0, *cuts], [*cuts, len(grams)], strict=True):
        builder.add(grams[a:b], counts[a:b])
    return builder.finish()


def union(parts: list[CountTransducer], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of several transducers in order, with the sums of their counts."""
    found = [part.phrases() for part in parts]
    grams = np.concatenate([np.zeros((0, width), dtype=np.int64), *(np.pad(g, ((0, 0), (0, width - g.shape[1])), constant_values=PAD) for g, _ in found)])
    return summed(grams, np.concatenate([np.zeros(0, dtype=np.int64), *(c for _, c in found)]))
