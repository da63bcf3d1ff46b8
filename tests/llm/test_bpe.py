import hashlib
import json
import random

import public_tokenizers
import pytest
from helpers import docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callgauge.llm import bpe, queries
from callgauge.sources.tables import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "1", "²", "é", "日本", "\U0001d7d9", "՘", "\U00012550", "\U0003d000",
    "'s", "'LL", "'ll", "<|endoftext|>", "<|endoftext", "|>", "!", "\U0001f600", "​", "\x00", "http", "abc", "é", "﻿", " ", "The", " quick",
]


def encoder(vocabulary):
    encode = vocabulary.encoder()
    return lambda text: encode([text])[0].tolist()


@pytest.fixture(scope="module")
def source():
    return bpe.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_against_the_library(source, library):
    vocabulary, rng = bpe.Vocabulary(source), random.Random(1)
    encode = encoder(vocabulary)
    for _ in range(5_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encode(text) == ids and vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_any_ids_decode_as_in_the_library(source, library):
    vocabulary, rng = bpe.Vocabulary(source), random.Random(2)
    for _ in range(3_000):
        ids = [rng.randrange(50_300) for _ in range(rng.randrange(9))]
        assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character_has_the_class_of_the_library(source, library):
    vocabulary = bpe.Vocabulary(source)
    for c in (*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x20000), *range(0x2A000, 0x34000, 3), *range(0x3C000, 0x40000, 5)):
        text = "a{0}a 1{0}1 !{0}! {0}  {0}".format(chr(c))
        pattern = vocabulary.exact if vocabulary.newer.search(text) else vocabulary.plain
        assert [m.span() for m in pattern.finditer(text)] == [s for _, s in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + "é" * 400, " " * 3000, "=" * 999, "abcdefgh" * 2000, "一龠漢" * 900])
def test_long_words(source, library, text):
    assert encoder(bpe.Vocabulary(source))(text) == library.encode(text, add_special_tokens=False).ids


def one_by_one(vocabulary, word):
    """The merges of one word, by the letter."""
    ids = [vocabulary.of_byte[b] for b in word]
    while True:
        ranks = [vocabulary.ranks.get(a * vocabulary.width + b, bpe.NEVER) for a, b in zip(ids, ids[1:])]
        if not ranks or min(ranks) == bpe.NEVER:
            return ids
        at = ranks.index(min(ranks))
        ids[at : at + 2] = [vocabulary.makes[ranks[at]]]


def test_all_ways_to_merge_agree(source):
    vocabulary, rng = bpe.Vocabulary(source), random.Random(3)
    words = ["".join(rng.choice("abcdeinorsté") for _ in range(rng.randrange(40))).encode() for _ in range(2_000)] + [b"x" * 300, b"\xff\x00"]
    assert vocabulary.merge(words) == [one_by_one(vocabulary, w) for w in words]
    assert [vocabulary._merge_long([vocabulary.of_byte[b] for b in w]) for w in words] == vocabulary.merge(words)


def test_texts_of_a_piece_keep_apart(source, library):
    texts = ["", "one two", "<|endoftext|>", "one", "", "two <|endoftext|>one", "q" * 200, "\x00a50256"]
    ids, bounds = bpe.Vocabulary(source).encoder()(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_of_a_million_letters_ends(source):
    vocabulary = bpe.Vocabulary(source)
    assert vocabulary.decode(encoder(vocabulary)("xy" * 500_000)) == "xy" * 500_000


def test_the_words_a_task_remembers_are_bounded(source, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    encode = encoder(bpe.Vocabulary(source))
    text = "one two three four five one two three four five"
    assert encode(text) == encode(text) and bpe.Vocabulary(source).decode(encode(text)) == text


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"decoder": None}, {"model": {"dropout": 0.1}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_what_is_not_supported_is_refused(source, change):
    told = json.loads(source)
    told = told | {k: told[k] | v if k == "model" else v for k, v in change.items()}
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps(told))


def test_defined_cases(spark, source):
    df = docs(spark, [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "<|endoftext|>x")], extra=("ids", "n_tokens"))
    got = df.select("doc_id", bpe.encoded(F.col("text"), source).alias("f")).withColumn("back", bpe.decoded(F.col("f"), source)).collect()
    assert [(r.doc_id, r.f, r.back) for r in got] == [(1, [], ""), (2, [], ""), (3, [64], "a"), (3, [64], "a"), (None, [50256, 87], "<|endoftext|>x")]
    both = df.select(bpe.round_trip(F.col("text"), source).alias("both")).select("both.ids", "both.decoded").collect()
    assert [tuple(r) for r in both] == [(r.f, r.back) for r in got]
    odd = spark.createDataFrame([(None,), ([64, 99_999_999, 64],), ([],)], "f array<int>")
    assert [r[0] for r in odd.select(bpe.decoded(F.col("f"), source)).collect()] == [None, "aa", ""]
    assert df.limit(0).select(bpe.encoded(F.col("text"), source)).collect() == []


def test_query_against_the_library(spark, folder, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in table(spark, folder, "documents").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in queries.op13_bpe(spark, folder).collect()} == want
