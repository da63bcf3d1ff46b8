"""Periodic runs of words: stretches that repeat themselves, found by Kruskal over descending LCPs.

Suffixes are sorted by prefix doubling, which also gives the LCP of neighbours. The suffix classes are then united by
decreasing LCP, with union-find over ordered sets of positions, the smaller set going into the larger. Two positions that
become neighbours in a set at LCP ``l`` and lie ``d <= l`` apart seed a run of period ``d``: no position between them has
the same ``l`` words, so ``d`` is the smallest period, and ``l`` says exactly how far the run reaches. A seed counts once,
at its first word. Positions whose first words occur once in their text cannot seed a run that is long enough and are left
out, so text without repetition costs one pass of hashing.

Words are what lies between space, tab, line feed, vertical tab, form feed and carriage return. Null and empty texts have
no words and no runs and collapse to the empty text. Every text is taken whole; one of n words takes about
``100 + 4 * log2(n)`` bytes a word and ``n * log(n)`` steps at worst, also if it is one word throughout. Equal texts get
equal runs.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from callgauge.llm.shared import pieces

#: Fewest words of a run, and how many periods it must hold.
SHORTEST, PERIODS = 6, 4
#: Words that are sorted together; a longer text is sorted by itself.
TOGETHER = 1 << 18
#: Most positions in one list of an ordered set.
BLOCK = 512

Run = tuple[int, int, int]  # start, length, period


class Positions:
    """An ordered set of positions, kept in blocks so that adding one to a large set moves few."""

    def __init__(self, first: int):
        self.blocks, self.firsts, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Adds a position; the ones before and after it."""
        at = max(bisect_right(self.firsts, x) - 1, 0)
        block = self.blocks[at]
        k = bisect_right(block, x)
        before = block[k - 1] if k else None
        after = block[k] if k < len(block) else self.firsts[at + 1] if at + 1 < len(self.firsts) else None
        block.insert(k, x)
        self.firsts[at] = block[0]
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks.insert(at + 1, block[half:])
            self.firsts.insert(at + 1, block[half])
            del block[half:]
        self.size += 1
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def least_lcp(shortest: int, periods: int) -> int:
    """The least LCP at which a run that is long enough can be seeded."""
    return min(max(shortest, periods * d) - d for d in range(1, shortest + 1))


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the rank of the first 1, 2, 4, ... words at each position."""
    n = len(words)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
    width = 1
    while ranks[-1].max(initial=0) + 1 < n:
        pair = ranks[-1].astype(np.int64) * (n + 1)
        pair[: max(n - width, 0)] += ranks[-1][width:] + 1
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
        width *= 2
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    return order, ranks


def lcps(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Words that the suffixes at ``a`` and at ``b`` (other positions) have in common."""
    n, a, b = len(ranks[0]), a.copy(), b.copy()
    start = a.copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = np.zeros(len(a), bool)
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        a[same] += 1 << level
        b[same] += 1 << level
    return a - start


def runs_of(words: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> list[Run]:
    """Runs of a sequence of numbers, in no order. Texts with no number in common may stand behind each other."""
    if len(words) < 2:
        return []
    order, ranks = suffix_order(words)
    common = lcps(order[:-1], order[1:], ranks)
    del ranks
    worth = np.flatnonzero(common >= least_lcp(shortest, periods))
    worth = worth[np.argsort(-common[worth], kind="stable")]
    said = words.tolist()
    root: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    found: list[Run] = []

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def seed(i: int, j: int, lcp: int) -> None:
        d = j - i
        if d <= lcp and (i == 0 or said[i - 1] != said[j - 1]) and lcp + d >= max(shortest, periods * d):
            found.append((i, lcp + d, d))

    for a, b, lcp in zip(order[worth].tolist(), order[worth + 1].tolist(), common[worth].tolist()):
        a, b = find(a), find(b)
        large, small = (sets.get(x) or Positions(x) for x in (a, b))
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        root[b] = a
        sets.pop(b, None)
        sets[a] = large
        moved = list(small)
        last = None
        for k, x in enumerate(moved):
            before, after = large.add(x)
            if before is not None and before != last:
                seed(before, x, lcp)
            if after is not None and (k + 1 == len(moved) or after < moved[k + 1]):
                seed(x, after, lcp)
            last = x
    return found


def _repeats(words: np.ndarray, width: int) -> np.ndarray:
    """Positions whose ``width`` words may occur elsewhere too (by a hash, so none that do are missing)."""
    n = len(words) - width + 1
    if n < 2:
        return np.empty(0, np.int64)
    hashed = np.zeros(n, np.uint64)
    for k in range(width):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n].astype(np.uint64)
    return np.flatnonzero(pd.Series(hashed).duplicated(keep=False).to_numpy())


def runs_of_all(texts: list[list[bytes]], shortest: int = SHORTEST, periods: int = PERIODS) -> list[list[Run]]:
    """Runs of each text (a list of words), by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    some, size = [], 0
    for number, text in enumerate(texts):
        if len(text) >= shortest:
            if some and size + len(text) > TOGETHER:
                _runs_together(texts, some, out, shortest, periods)
                some, size = [], 0
            some.append(number)
            size += len(text)
    if some:
        _runs_together(texts, some, out, shortest, periods)
    return out


def _runs_together(texts: list[list[bytes]], numbers: list[int], out: list[list[Run]], shortest: int, periods: int) -> None:
    each, base = [], 0
    for number in numbers:
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        each.append(np.fromiter(map(known.__getitem__, texts[number]), np.int64, len(texts[number])) + base)
        base += len(known)
    ends = np.cumsum([len(e) for e in each])
    hit = np.unique(np.searchsorted(ends, _repeats(np.concatenate(each), least_lcp(shortest, periods)), "right"))
    if not len(hit):
        return
    starts = np.concatenate([[0], np.cumsum([len(each[h]) for h in hit])])
    for start, length, period in runs_of(np.concatenate([each[h] for h in hit]), shortest, periods):
        at = int(np.searchsorted(starts, start, "right")) - 1
        out[numbers[hit[at]]].append((start - int(starts[at]), length, period))
    for h in hit:
        out[numbers[h]].sort(key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without what follows the first period of a run."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    return [words[k] for k in kept.tolist()]


def found(text: Column, shortest: int = SHORTEST, periods: int = PERIODS) -> Column:
    """struct(n_words, runs, collapsed) of a text: its runs of at least ``shortest`` words and ``periods`` periods, by
    start, then period, and its words, joined by one space, without those a run repeats."""

    @F.pandas_udf("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for piece in pieces(texts):
                # only white space of ASCII parts bytes
                split = [t.encode().split() for t in piece]
                runs = runs_of_all(split, shortest, periods)
                short = [b" ".join(collapse(w, r)).decode() for w, r in zip(split, runs)]
                yield pd.DataFrame({"n_words": [len(w) for w in split], "runs": runs, "collapsed": short})

    return run(text)
