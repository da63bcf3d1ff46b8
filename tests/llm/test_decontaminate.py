import random

import numpy as np
import pytest
from helpers import docs
from pyspark.sql import functions as F

from callgauge.llm import decontaminate
from callgauge.llm.decontaminate import WINDOW, words_of
from callgauge.llm.shared import keep

BENCH = "item_id long, text string"


def plain(documents, items):
    """(words, hit, items) per document, straight from the contract."""
    out = []
    for row, text in documents:
        words, hit, found = words_of(text), set(), set()
        for name, content in items:
            own = words_of(content)
            if name is None or not own:
                continue
            size = min(WINDOW, len(own))
            grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    found.add(str(name))
        out.append((row, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


def check(spark, documents, items, **how):
    bench = spark.createDataFrame(items, BENCH).selectExpr("*", "'x' as n_words")
    got = decontaminate.report(*decontaminate.matches(docs(spark, documents, ["id", "items", "hit"]), bench, **how))
    assert sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=repr) == plain(documents, items)


@pytest.fixture(scope="module")
def case():
    draw = random.Random(3)
    say = lambda n: " ".join(draw.choice("the of and a to in é x1 Y2 z3 q r s t".split()) for _ in range(n))
    items = [(i, say(draw.choice([1, 3, 9, 10, 11, 25, 40]))) for i in range(25)]
    items += [(30, ""), (31, None), (None, "the of"), (32, items[0][1]), (33, items[1][1].upper()), (33, items[1][1])]
    rows = []
    for i in range(60):
        part = words_of(items[i % 25][1])
        at = draw.randrange(len(part))
        rows.append((i, f"{say(30)} {b' '.join(part[at : at + 15]).decode()}, {say(20)}"))
    rows += [(70, None), (71, ""), (None, items[5][1]), (2**63 - 1, items[6][1]), (7, rows[7][1]), (7, "another " + items[9][1]), (72, "the " * 20_000 + items[4][1])]
    return rows, items


def test_against_brute_force(spark, case):
    check(spark, *case)


def test_slices_of_the_benchmark(spark, case):
    check(spark, *case, max_words=60)


def test_documents(spark, folder):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect()]
    check(spark, read("documents", "doc_id"), read("benchmark", "item_id"))


def test_proximity(spark):
    item = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    texts = ["alpha beta gamma delta epsilon zeta eta theta iota kappa", "alpha so beta gamma delta epsilon zeta eta theta iota kappa", "alpha beta", "gamma delta epsilon zeta eta theta iota kappa " * 9, "beta x x x x x alpha"]
    found = decontaminate.report(*decontaminate.matches(docs(spark, list(enumerate(texts))), spark.createDataFrame(item, BENCH)))
    got = {r.id: (r["items"], r.near) for r in found.collect()}
    assert got == {0: (["1"], []), 1: ([], ["1"]), 2: ([], ["1"]), 3: ([], []), 4: ([], [])}


def test_empty(spark):
    none = spark.createDataFrame([], BENCH)
    some = spark.createDataFrame([(1, "a b")], BENCH)
    report = lambda d, b: [tuple(r)[:3] for r in decontaminate.report(*decontaminate.matches(d, b)).collect()]
    assert report(docs(spark, [(1, "a b")]), none) == [(1, 2, 0)]
    assert report(docs(spark, []), some) == []


def test_a_hit_covers_the_words_of_its_windows_only(spark):
    words = [f"w{i}" for i in range(14)]
    rows = [(1, "x " + " ".join(words[2:13]) + " w13x"), (2, " ".join(words[:9])), (3, " ".join(words[:10] + ["no"] + words[4:14]))]
    check(spark, rows, [(1, " ".join(words))])
    hits = decontaminate.matches(docs(spark, rows), spark.createDataFrame([(1, " ".join(words))], BENCH))[1]
    assert {r.id for r in hits.where(F.size("items") > 0).collect()} == {1, 3}


def test_items_that_share_a_template(spark):
    """Work does not multiply by the items: a template is searched once, and its borders by the words that differ."""
    draw = random.Random(8)
    template = [f"t{i}" for i in range(20)]
    own = [[f"own{i}x{j}" for j in range(6)] for i in range(1000)]
    items = [(i, " ".join([*words[:3], *template, *words[3:]])) for i, words in enumerate(own)]
    rows = [(0, " ".join(template * 300)), (1, " ".join(items[5][1] for _ in range(30))), (2, " ".join(draw.choice(template) for _ in range(3000)))]
    rows += [(3, " ".join(template[:9])), (4, items[7][1] + " " + items[8][1])]
    few = [items[i] for i in (5, 7, 8, 9)]
    check(spark, rows, few)
    held = decontaminate.Items([(str(i), words_of(t)) for i, t in items])
    held.anchor(frequencies_of(held, [t for _, t in rows]))
    # eleven windows of the template once; six to either side of it in each item, in a few stretches
    assert (held.least == 10).all() and len(held.length) <= 11 + 1000 * 12
    fan = held.first[1:] - held.first[:-1]
    assert max(fan[held.ids[w.encode()]] for w in template) <= 22
    got = decontaminate.report(*decontaminate.matches(docs(spark, rows, ["id"]), spark.createDataFrame(items, BENCH)))
    found = {r.id: (r.n_hit, r["items"]) for r in got.collect()}
    everyone = sorted(str(i) for i in range(1000))
    assert found[0] == (6000, everyone) and found[1] == (30 * 26, everyone) and found[4] == (52, everyone)
    assert found[2][0] == 0 and found[3] == (0, [])


def frequencies_of(items, texts):
    out = [0] * len(items.ids)
    for text in texts:
        for word in words_of(text):
            if word in items.ids:
                out[items.ids[word]] += 1
    return np.array(out)


def test_pieces_of_the_search(spark, case, monkeypatch):
    documents, items = case
    held = decontaminate.Items([(str(n), words_of(t)) for n, t in items if n is not None and words_of(t)])
    rows = keep(decontaminate.index(docs(spark, documents), held), "pieces").toPandas()
    held.anchor(frequencies_of(held, [t for _, t in documents]))
    whole = decontaminate._search(rows, held, 2)
    for fan, compared in ((1, 1), (50, 7), (5_000, 10**6)):
        monkeypatch.setattr(decontaminate, "FAN", fan)
        monkeypatch.setattr(decontaminate, "COMPARED", compared)
        assert decontaminate._search(rows, held, 2).equals(whole)
