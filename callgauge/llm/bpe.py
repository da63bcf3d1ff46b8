"""Byte-pair encoding and decoding with a given byte-level vocabulary.

Text is split at added tokens and then by the vocabulary's pattern. A short word is held as a contiguous array of its parts,
with the ranks of adjacent ones beside it; the least rank is looked for again and again, the boundary inside that pair is
deleted and the ranks next to it are refreshed. Words of one length that are new to a task do so together, as rows of one
array. A long word, where scanning would take quadratic time, keeps its pairs in a heap and merges in the same order. Words
that occurred before in a task are looked up, up to ``CACHED`` of them.

A vocabulary is a JSON file of the ``tokenizers`` library; what this module does not do (normalizers, dropout, unknown
tokens, added tokens that take white space along) is refused. The results are the library's: of ``encode`` without special
tokens added, and of ``decode`` that keeps them. Truncation and padding are not applied.

Null and empty texts have no tokens; null ids decode to null, ids the vocabulary does not have to nothing, and bytes that
are no UTF-8 to replacement characters. Every text is taken whole, in memory that grows with it (about 40 bytes a token);
a word of n bytes takes ``n * log(n)`` steps. Equal texts get equal ids.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F

from callgauge.llm.shared import pieces

#: How words are told apart, for byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that came after Unicode 16, whose classes the pattern means.
NEWER = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Most bytes of a word whose ranks are scanned, and most words a task remembers (up to CACHED_LENGTH characters each).
SHORT, CACHED, CACHED_LENGTH = 128, 200_000, 64
NEVER = 1 << 62
#: A sign with a letter after it is never one word.
ADDED = "\x00a"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary: itself if it can be seen, else the next free one."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges, ranks and bytes of the tokens of one file's text."""

    def __init__(self, source: str):
        told = json.loads(source)
        _refuse(told)
        model, ids = told["model"], told["model"]["vocab"]
        self.of_byte = [ids.get(c) for c in byte_characters()]
        if None in self.of_byte:
            raise ValueError("the vocabulary lacks single bytes")
        self.width = width = max(ids.values()) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        #: pair of ids -> rank, and the id a rank makes
        self.ranks = {ids[a] * width + ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.makes = [ids[a + b] for a, b in pairs]
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.rank_of_pair = np.array([self.ranks[p] for p in self.pairs.tolist()], np.int64)
        self.made_by = np.array(self.makes, np.int64)
        self.ids_of_bytes = np.array(self.of_byte, np.int64)
        #: by first byte, then second
        self.ranks_of_bytes = self._rank(*(x.ravel() for x in np.meshgrid(self.ids_of_bytes, self.ids_of_bytes, indexing="ij")))
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        in_order = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, in_order))) if in_order else None
        self.names = {**{i: t for t, i in ids.items()}, **{i: t for t, i in self.added.items()}}
        self.plain = regex.compile(WORDS)
        self.newer = re.compile(f"[{NEWER}]")
        letters, numbers = rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]"
        others = rf"[^\s{letters}{numbers}]"
        self.exact = regex.compile(
            WORDS.replace(r"[^\s\p{L}\p{N}]", others).replace(r" ?\p{L}+", f" ?{letters}+").replace(r" ?\p{N}+", f" ?{numbers}+"),
            regex.V1,
        )

    @cached_property
    def bytes_of(self) -> dict[int, bytes]:
        """Bytes of each token. One with a character that stands for no byte is taken as it is written."""
        characters = byte_characters()
        known, table = set(characters), {ord(c): b for b, c in enumerate(characters)}
        return {i: t.translate(table).encode("latin-1") if known.issuperset(t) else t.encode() for i, t in self.names.items()}

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. Short words of one length are merged side by side, one merge each a step."""
        out: list[list[int]] = [[]] * len(words)
        by_length: defaultdict[int, list[int]] = defaultdict(list)
        for number, word in enumerate(words):
            if len(word) <= SHORT:
                by_length[len(word)].append(number)
            else:
                out[number] = self._merge_long([self.of_byte[b] for b in word])
        for numbers in by_length.values():
            self._merge_short(words, np.array(numbers), out)
        return out

    def _merge_short(self, words: list[bytes], numbers: np.ndarray, out: list[list[int]]) -> None:
        """Words of one length, a row each: the ids of their parts and the ranks of adjacent ones. Rows that still have
        a pair to merge have equally many parts, so deleting a boundary leaves the arrays contiguous."""
        said = np.frombuffer(b"".join(words[n] for n in numbers), np.uint8).reshape(len(numbers), -1).astype(np.int64)
        ids, ranks = self.ids_of_bytes[said], self.ranks_of_bytes[said[:, :-1] << 8 | said[:, 1:]]
        while len(numbers):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(numbers), np.int64)
            row = np.arange(len(numbers))
            least = ranks[row, at] if ranks.shape[1] else np.full(len(numbers), NEVER)
            if (done := least == NEVER).any():
                for number, found in zip(numbers[done].tolist(), ids[done].tolist()):
                    out[number] = found
                numbers, ids, ranks, at, least = (x[~done] for x in (numbers, ids, ranks, at, least))
                row = row[: len(numbers)]
                if not len(numbers):
                    return
            ids[row, at] = self.made_by[least]
            ids, ranks = _without(ids, at + 1), _without(ranks, at)
            for place, there in ((at - 1, at > 0), (at, at < ranks.shape[1])):
                r, k = row[there], place[there]
                ranks[r, k] = self._rank(ids[r, k], ids[r, k + 1])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a * self.width + b
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == pair, self.rank_of_pair[at], NEVER)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges, least rank and then leftmost first, with the pairs in a heap."""
        pair, width, n = self.ranks.get, self.width, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pair(ids[i] * width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or pair(ids[i] * width + ids[j]) != rank:
                continue
            ids[i], ids[j] = self.makes[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pair(ids[i] * width + ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := pair(ids[h] * width + ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def split(self, text: str) -> list[str]:
        """The words of a text. An added token becomes its id behind ADDED, which no word starts with."""
        pattern = self.plain if text.isascii() or not self.newer.search(text) else self.exact
        if not self.cut or not self.cut.search(text):
            return pattern.findall(text)
        out: list[str] = []
        at = 0
        for m in self.cut.finditer(text):
            out += [*pattern.findall(text[at : m.start()]), f"{ADDED}{self.added[m[0]]}"]
            at = m.end()
        return out + pattern.findall(text[at:])

    def encoder(self) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
        """Encodes texts: their ids behind each other, and where each text's begin and the last one's end."""
        added = {f"{ADDED}{i}": [i] for i in self.added.values()}
        known = dict(added)

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            words = [self.split(t) for t in texts]
            bounds = np.cumsum([0, *map(len, words)])
            if not bounds[-1]:
                return np.empty(0, np.int32), bounds
            # every different word is looked up once
            coded = pa.array(chain.from_iterable(words), pa.large_string()).dictionary_encode()
            said, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            new = [w for w in said if w not in known]
            if len(known) + len(new) > CACHED:
                known.clear()
                known.update(added)
                new = [w for w in said if w not in known]
            known.update(zip(new, self.merge([w.encode() for w in new])))
            found = [known[w] for w in said]
            for w in new:
                if len(w) > CACHED_LENGTH:
                    del known[w]
            # the ids of each occurrence, taken out of those of the different words
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            starts = np.cumsum(sizes) - sizes
            size = sizes[number]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(starts[number] - (ends - size), size)
            flat = np.fromiter(chain.from_iterable(found), np.int32, sizes.sum())
            return flat[at], np.concatenate([[0], ends])[bounds]

        return encode

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")


def _without(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each row without one of its entries."""
    kept = np.ones(rows.shape, bool)
    kept[np.arange(len(rows)), at] = False
    return rows[kept].reshape(len(rows), -1)


def _refuse(told: dict) -> None:
    model, split, decoder = told["model"], told.get("pre_tokenizer") or {}, told.get("decoder") or {}
    asked = {
        "a normalizer": told.get("normalizer"),
        "a pre-tokenizer that is not byte-level": split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True),
        "a decoder that is not byte-level": decoder.get("type") != "ByteLevel",
        "a model that is not BPE": model.get("type") != "BPE",
        **{name: model.get(name) for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")},
        "added tokens with conditions": any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if named := [name for name, has in asked.items() if has]:
        raise ValueError(f"not supported: {', '.join(named)}")


def read_vocabulary(path: str) -> str:
    """The text of a vocabulary file, which goes to every task (a few MB). It is read by the driver."""
    with open(path, encoding="utf-8") as file:
        source = file.read()
    Vocabulary(source)
    return source


def encoded(text: Column, vocabulary: str) -> Column:
    """Ids of each text's tokens; ``vocabulary`` is the text of the file."""
    return _encoded(text, vocabulary, "array<int>", lambda known, ids, bounds: _lists(ids, bounds))


def round_trip(text: Column, vocabulary: str) -> Column:
    """struct(ids, decoded): the ids of each text's tokens, and the text they decode to."""

    def both(known: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        back = [known.decode(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
        return pa.StructArray.from_arrays([_lists(ids, bounds), pa.array(back, pa.string())], ["ids", "decoded"])

    return _encoded(text, vocabulary, "ids array<int>, decoded string", both)


def _encoded(text: Column, vocabulary: str, kind: str, told: Callable[[Vocabulary, np.ndarray, np.ndarray], pa.Array]) -> Column:
    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Vocabulary(vocabulary)
        encode = known.encoder()
        for texts in batches:
            for piece in pieces(texts.to_pylist()):
                yield told(known, *encode(piece))

    return run(text)


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def decoded(ids: Column, vocabulary: str) -> Column:
    """The text of each list of ids."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Vocabulary(vocabulary)
        for lists in batches:
            yield pa.array([None if i is None else known.decode(i) for i in lists.to_pylist()], pa.string())

    return run(ids)
