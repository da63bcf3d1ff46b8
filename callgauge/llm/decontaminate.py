"""Benchmark decontamination with a positional inverted index of the documents.

1. ``index``: one pass over whole texts stores, per document, the posting lists (positions by term) of every term that a
   benchmark item has. The index is sharded by document, as search engines shard theirs, so it is built and read without
   a shuffle.
2. Corpus frequencies of the terms are summed over the index. Each window (``WINDOW`` consecutive words of an item, or all
   words of a shorter one) is anchored at its two cheapest terms, by frequency times the items that have the term. Windows
   are told apart by their words: one that many items share, as those of a common template, is searched once.
3. ``search``: the posting lists of a window's anchors, each shifted by its offset, are intersected; where they meet, the
   words there are compared, all places at once in numpy, which gives the exact phrase matches. Anchors whose shifted
   positions differ by at most ``slop`` are proximity matches.

The benchmark is read on the driver and sent to every task. Its size is checked: items go in slices of at most
``max_words`` words, one index and search per slice, and the results are united, so a benchmark of any size is matched in
full while what is sent stays bounded.

Null and empty texts have no words: they match nothing. Items without words, or with a null id, are never found. Equal
items count each by its id; an id that occurs twice counts once. Equal documents get equal results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from callgauge.llm.shared import keep

WINDOW = 10
#: A second anchor that costs so many times the first is left out.
SINGLE = 64
#: Places of anchors, and stretches, that are looked at together.
FAN, COMPARED = 2_000_000, 50_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
HITS = "id long, text_hash long, n_words long, items array<string>, hit binary, near array<string>"


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of ASCII letters and digits and of anything beyond ASCII."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Items:
    """Words of benchmark items as term numbers, and the stretches of windows that are searched for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.names = np.array([name for name, _ in items], object)
        vocabulary = sorted({w for _, words in items for w in words})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.words = [np.array([self.ids[w] for w in words], np.int32) for _, words in items]

    def _windows(self) -> Iterator[tuple[int, int, bytes]]:
        for item, words in enumerate(self.words):
            for start in range(max(1, len(words) - self.window + 1)):
                yield item, start, words[start : start + self.window].tobytes()

    def anchor(self, frequency: np.ndarray) -> None:
        """Cuts items into stretches and lists, by term, the (stretch, place, side) it anchors.

        A window that is there several times is a stretch of its own, once for all items that have it. Other windows of an
        item that follow each other and have the same anchors are one stretch.
        """
        in_items = np.bincount(np.concatenate([np.unique(w) for w in self.words] or [[]]).astype(np.int64), minlength=len(self.ids))
        # what a term costs if all items that have it are anchored there
        cost = frequency * in_items
        times = Counter(content for _, _, content in self._windows())
        shared: dict[bytes, int] = {}
        #: of each stretch: item, start, words, words of a window, place of either anchor
        stretches: list[list[int]] = []
        owners: list[set[int]] = []
        before = None
        for item, start, content in self._windows():
            part = cost[self.words[item][start : start + self.window]]
            first, *second = np.argsort(part, kind="stable")[:2].tolist()
            # a window of one word is anchored twice at the same place, and so is one whose second word is far too frequent
            other = second[0] if second and part[second[0]] <= SINGLE * part[first] else first
            a, b = start + min(first, other), start + max(first, other)
            if times[content] > 1:
                before = None
                if content in shared:
                    owners[shared[content]].add(item)
                    continue
                shared[content] = len(stretches)
            elif before == (item, a, b):
                stretches[-1][2] += 1
                continue
            else:
                before = (item, a, b)
            stretches.append([item, start, len(part), len(part), a - start, b - start])
            owners.append({item})
        offset = np.concatenate(([0], np.cumsum([len(w) for w in self.words])))
        table = np.array(stretches, np.int64).reshape(-1, 6)
        self.flat = np.concatenate([*self.words, np.zeros(0, np.int32)])
        self.offset, self.length, self.least = offset[table[:, 0]] + table[:, 1], table[:, 2], table[:, 3]
        # of a stretch with one anchor, proximity says nothing unless the word is all there is
        self.paired = (table[:, 4] < table[:, 5]) | (self.least == 1)
        self.owner_first = np.concatenate(([0], np.cumsum([len(o) for o in owners]))).astype(np.int64)
        self.owners = np.array([i for o in owners for i in sorted(o)], np.int64)
        sides = [np.stack((self.flat[self.offset + table[:, 4 + s]], np.arange(len(table)), table[:, 4 + s], np.full(len(table), s)), axis=1) for s in (0, 1)]
        entries = np.concatenate(sides).astype(np.int32)
        self.entries = entries[np.argsort(entries[:, 0], kind="stable")]
        self.first = np.searchsorted(self.entries[:, 0], np.arange(len(self.ids) + 1))

    def of(self, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of stretches: (which of the stretches, item)."""
        which, at = _spread(self.owner_first[stretches], self.owner_first[stretches + 1])
        return which, self.owners[at]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, with the range each is from."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return which, np.arange(size.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size)


def slices(benchmark: DataFrame, row_id: str, text: str, max_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, in slices of at most ``max_words`` words (or one item)."""
    part: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("string"), F.col(text))
    for name, content in rows.distinct().toLocalIterator():
        words = words_of(content)
        if words:
            if part and size + len(words) > max_words:
                yield part
                part, size = [], 0
            part.append((name, words))
            size += len(words)
    if part:
        yield part


def index(documents: DataFrame, items: Items, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n_words, terms, counts, positions): the postings of the items' terms, a row per document."""
    ids = items.ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for content in rows["text"]:
                words = words_of(content)
                terms = np.fromiter((ids.get(w, -1) for w in words), np.int32, len(words))
                places = np.nonzero(terms >= 0)[0].astype(np.int32)
                order = np.argsort(terms[places], kind="stable")
                distinct, counts = np.unique(terms[places], return_counts=True)
                out.append((len(words), distinct.tobytes(), counts.astype(np.int32).tobytes(), places[order].tobytes()))
            yield pd.concat(
                [
                    rows[["id", "text_hash"]].reset_index(drop=True),
                    pd.DataFrame(out, columns=["n_words", "terms", "counts", "positions"]),
                ],
                axis=1,
            )

    # ids pass through pandas as text: next to a null, large numbers would lose digits
    rows = documents.select(
        F.col(row_id).cast("long").cast("string").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")
    )
    posted = rows.mapInPandas(run, "id string, text_hash long, n_words long, terms binary, counts binary, positions binary")
    return posted.withColumn("id", F.col("id").cast("long"))


def frequencies(indexed: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each term in all documents; a row for each task and term reaches the sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for rows in batches:
            for terms, counts in zip(rows["terms"], rows["counts"]):
                total[np.frombuffer(terms, np.int32)] += np.frombuffer(counts, np.int32)
        some = np.nonzero(total)[0]
        yield pd.DataFrame({"term": some, "n": total[some]})

    out = np.zeros(size, np.int64)
    summed = indexed.select("terms", "counts").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n"))
    for term, n in summed.collect():
        out[term] = n
    return out


def search(indexed: DataFrame, items: Items, slop: int = 2) -> DataFrame:
    """Rows with matches only: items found as exact phrase windows, hit positions, items found in proximity only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 1000):
                found = _search(rows.iloc[at : at + 1000].reset_index(drop=True), items, slop)
                if found is not None:
                    yield found

    named = indexed.withColumn("id", F.col("id").cast("string"))
    return named.mapInPandas(run, HITS.replace("id long", "id string", 1)).withColumn("id", F.col("id").cast("long"))


def _search(rows: pd.DataFrame, items: Items, slop: int) -> pd.DataFrame | None:
    terms = [np.frombuffer(b, np.int32) for b in rows["terms"]]
    counts = [np.frombuffer(b, np.int32) for b in rows["counts"]]
    lists = [np.frombuffer(b, np.int32) for b in rows["positions"]]
    term = np.repeat(np.concatenate(terms), np.concatenate(counts))
    position = np.concatenate(lists).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(p) for p in lists])
    n_words = rows["n_words"].to_numpy(np.int64)
    base = np.concatenate(([0], np.cumsum(n_words)))
    # the documents as far as their postings tell, one after the other; -1 elsewhere
    seq = np.full(base[-1] + 1, -1, np.int32)
    seq[base[doc] + position] = term
    cover = np.zeros(base[-1] + 1, np.int32)
    anchoring = np.nonzero(items.first[term + 1] > items.first[term])[0]
    found, near = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for some in _pieces(anchoring, doc, (items.first[term + 1] - items.first[term])):
        owner, stretch, start, close = _meetings(items, term[some], doc[some], position[some], slop)
        near.append(close)
        for at in range(0, len(owner), COMPARED):
            part = slice(at, at + COMPARED)
            found.append(_compare(items, seq, cover, base, n_words, owner[part], stretch[part], start[part]))
    names = [_by_document(items, np.unique(np.concatenate(pairs), axis=0)) for pairs in (found, near)]
    which = sorted(names[0].keys() | names[1].keys())
    if not which:
        return None
    hit = np.cumsum(cover[:-1]) > 0
    exact = [names[0].get(d, set()) for d in which]
    return pd.DataFrame(
        {
            "id": rows["id"][which].to_numpy(),
            "text_hash": rows["text_hash"][which].to_numpy(),
            "n_words": rows["n_words"][which].to_numpy(),
            "items": [sorted(e) for e in exact],
            "hit": [np.nonzero(hit[base[d] : base[d + 1]])[0].astype(np.int32).tobytes() for d in which],
            "near": [sorted(names[1].get(d, set()) - e) for d, e in zip(which, exact)],
        }
    )


def _pieces(places: np.ndarray, doc: np.ndarray, fan: np.ndarray) -> Iterator[np.ndarray]:
    """Postings in pieces of about ``FAN`` anchored places, documents kept whole."""
    upto = np.cumsum(fan[places])
    at = 0
    while at < len(places):
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + FAN, "right"))
        end = int(np.searchsorted(doc[places], doc[places[min(max(end, at), len(places) - 1)]], "left"))
        if end <= at:
            end = int(np.searchsorted(doc[places], doc[places[at]], "right"))
        yield places[at:end]
        at = end


def _meetings(items: Items, term: np.ndarray, doc: np.ndarray, position: np.ndarray, slop: int) -> tuple[np.ndarray, ...]:
    """Where the anchors of a stretch meet: (document, stretch, where the stretch would start), and (document, stretch) pairs
    whose anchors are within ``slop`` of it."""
    which, entry = _spread(items.first[term], items.first[term + 1])
    _, stretch, place, side = items.entries[entry].T
    owner, start = doc[which], position[which] - place
    order = np.lexsort((side, start, stretch, owner))
    owner, stretch, start, side = (x[order] for x in (owner, stretch, start, side))
    meets = (owner[1:] == owner[:-1]) & (stretch[1:] == stretch[:-1]) & (side[1:] != side[:-1])
    gap = start[1:] - start[:-1]
    exact = np.nonzero(meets & (gap == 0))[0]
    near = np.nonzero(meets & (gap <= slop) & items.paired[stretch[1:]])[0]
    return owner[exact], stretch[exact].astype(np.int64), start[exact], np.unique(np.stack((owner[near], stretch[near]), axis=1), axis=0)


def _compare(items: Items, seq, cover, base, n_words, owner, stretch, start) -> np.ndarray:
    """Compares stretches with documents word by word; (document, stretch) of those with a whole window, whose words it marks
    by the steps of ``cover``."""
    width = np.arange(2 * items.window)
    place = start[:, None] + width
    inside = (width < items.length[stretch][:, None]) & (place >= 0) & (place < n_words[owner][:, None])
    own = items.flat[np.where(inside, items.offset[stretch][:, None] + width, 0)]
    same = inside & (seq[np.where(inside, base[owner][:, None] + place, 0)] == own)
    upto = np.concatenate((np.zeros((len(owner), 1), np.int64), np.cumsum(same, axis=1)), axis=1)
    hits = [np.zeros((0, 2), np.int64)]
    for least in np.unique(items.least[stretch]):
        rows = np.nonzero(items.least[stretch] == least)[0]
        row, at = np.nonzero(upto[rows, least:] - upto[rows, :-least] == least)
        begin = base[owner[rows[row]]] + start[rows[row]] + at
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + least, -1)
        hits.append(np.stack((owner[rows[row]], stretch[rows[row]]), axis=1))
    return np.unique(np.concatenate(hits), axis=0)


def _by_document(items: Items, pairs: np.ndarray) -> dict[int, set[str]]:
    which, item = items.of(pairs[:, 1])
    out: dict[int, set[str]] = {}
    for d, names in pd.Series(items.names[item]).groupby(pairs[which, 0]):
        out[int(d)] = set(names)
    return out


def matches(
    documents: DataFrame,
    benchmark: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    slop: int = 2,
    max_words: int = 2_000_000,
) -> tuple[DataFrame, DataFrame]:
    """(lengths, hits): id, text_hash and n_words of every document; hits of those that have any (see ``HITS``).

    With several slices a document has a row of hits for each slice that it matches.
    """
    lengths, hits = None, None
    for part in slices(benchmark, item_id, "text", max_words):
        items = Items(part)
        indexed = keep(index(documents, items, row_id, text), "postings")
        items.anchor(frequencies(indexed, len(items.ids)))
        found = keep(search(indexed, items, slop), "phrases")
        hits = found if hits is None else hits.unionByName(found)
        lengths = indexed.select("id", "text_hash", "n_words") if lengths is None else lengths
    if hits is None:
        indexed = keep(index(documents, Items([]), row_id, text), "postings")
        lengths, hits = indexed.select("id", "text_hash", "n_words"), documents.sparkSession.createDataFrame([], HITS)
    return lengths, hits


def report(lengths: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, n_words, n_hit, items, near) of every document; hits of several slices are united."""

    @F.pandas_udf("long")
    def union_size(hit: pd.Series) -> pd.Series:
        return hit.map(lambda parts: len(np.unique(np.concatenate([np.frombuffer(b, np.int32) for b in parts]))))

    # rows that agree in id and text have equal hits, so one of them stands for all
    each = hits.groupBy("id", "text_hash").agg(
        F.collect_set("hit").alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("near")))).alias("near"),
    )
    each = each.select(F.col("id").alias("i"), F.col("text_hash").alias("h"), union_size("hit").alias("n_hit"), "items", "near")
    none = F.array().cast("array<string>")
    return lengths.join(each, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left").select(
        "id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.array_except(F.coalesce("near", none), F.coalesce("items", none)).alias("near"),
    )
