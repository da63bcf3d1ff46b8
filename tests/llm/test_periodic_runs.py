import hashlib
import random
import re
import zlib

import pytest
from helpers import docs

from callgauge.llm import periodic_runs, queries
from callgauge.sources.tables import table


def plain(words, shortest=6, periods=4):
    """Every period tried on every word."""
    out, n = set(), len(words)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            run = words[start : i + q]
            smaller = any(run[p:] == run[:-p] for p in range(1, q))
            if len(run) >= max(shortest, periods * q) and not smaller:
                out.add((start, len(run), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n = rng.randint(0, 60)
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
    if n > 3 and rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randint(1, n // 3)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("shortest, periods", [(6, 4), (2, 2), (4, 2), (9, 3)])
def test_against_brute_force(shortest, periods):
    rng = random.Random(shortest)
    texts = [some_words(rng) for _ in range(600)]
    assert periodic_runs.runs_of_all(texts, shortest, periods) == [plain(t, shortest, periods) for t in texts]


def test_texts_do_not_run_into_each_other():
    assert periodic_runs.runs_of_all([[b"a"] * 5, [b"a"] * 5, [], [b"a"] * 7]) == [[], [], [], [(0, 7, 1)]]


def test_a_set_of_many_blocks():
    rng, known = random.Random(5), []
    order = rng.sample(range(10_000), 5_000)
    found = periodic_runs.Positions(order[0])
    known = [order[0]]
    for x in order[1:]:
        before, after = found.add(x)
        if rng.random() < 0.02:
            assert before == max((k for k in known if k < x), default=None)
            assert after == min((k for k in known if k > x), default=None)
        known.append(x)
    assert list(found) == sorted(order) and len(found.blocks) > 5


def test_long_text_of_one_word():
    assert periodic_runs.runs_of_all([[b"x"] * 200_000, [b"x", b"y"] * 100_000]) == [[(0, 200_000, 1)], [(0, 200_000, 2)]]


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (5, "a " * 5), (6, "x y " * 9 + "z"), (6, "x y " * 9 + "z"), (None, "b b b b b b c")]
    df = docs(spark, rows, extra=("words", "runs", "found", "n_words"))
    got = df.select("doc_id", "runs", periodic_runs.found(df["text"]).alias("f")).collect()
    read = [(r.doc_id, r.runs, r.f.n_words, [tuple(x) for x in r.f.runs], r.f.collapsed) for r in got]
    assert read == [
        (1, "kept", 0, [], ""), (2, "kept", 0, [], ""), (3, "kept", 0, [], ""),
        (4, "kept", 6, [(0, 6, 1)], "a"), (5, "kept", 5, [], "a a a a a"),
        (6, "kept", 10, [(0, 9, 1)], "x y z"), (6, "kept", 10, [(0, 9, 1)], "x y z"),
        (None, "kept", 7, [(0, 6, 1)], "b c"),
    ]
    assert df.limit(0).select(periodic_runs.found(df["text"])).collect() == []


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_against_brute_force(spark, folder):
    got = {tuple(r) for r in queries.op11_periodic_runs(spark, folder).collect()}
    documents = table(spark, folder, "documents").select("doc_id", "text").collect()
    want = {expected(r.doc_id, r.text) for r in documents}
    assert got == want and sum(r[1] for r in got) > 10


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(None, "a b " * 20), (10, None), (10, ""), (0, "w " * 3), (43, "one"), (43, "one")]
    rows += [(i, " ".join(f"w{k % (i + 2)}" for k in range(i))) for i in range(80)]
    docs(spark, rows, extra=("longest", "N_RUNS")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, (tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect())))
    assert got == sorted(repr(expected(i, t)) for i, t in rows)
