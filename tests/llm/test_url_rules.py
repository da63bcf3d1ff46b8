import random
from collections import Counter
from itertools import combinations
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from callgauge.llm import url_rules

PAGES = "page_id long, url string, html string"


def judge(spark, rows):
    got = url_rules.judged(spark.createDataFrame([(i, u, "") for i, u in rows], PAGES).selectExpr("*", "'x' as host", "'y' as verdict"))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}


def test_listed_rules(spark):
    rows = {
        1: ("https://M.Example.com/en/1?q#f", ("m.example.com", "/en/1", "example.com/en/", "block")),
        2: ("http://www.example.com/en/", ("www.example.com", "/en/", "www.example.com/en/", "allow")),
        3: ("http://a.www.example.com/en/x", ("a.www.example.com", "/en/x", "www.example.com/en/", "allow")),
        4: ("http://example.com/en", ("example.com", "/en", "com/", "allow")),
        5: ("http://example.com", ("example.com", "", None, "allow")),
        6: ("http://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")),
        7: ("ftp://x.net/es/", ("x.net", "/es/", "net/es/", "block")),
        8: ("http://x.net?/es/", ("x.net", "", None, "allow")),
        9: (None, ("", "", None, "allow")),
        10: ("x.net/es/", ("", "", None, "allow")),
        11: ("http://x.net#://y.com/", ("x.net", "", None, "allow")),
        12: ("", ("", "", None, "allow")),
        13: ("a?b://net/fr/\n", ("net", "/fr/\n", "net/fr/", "block")),
        14: ("http://ÀB.net:80/fr/", ("Àb.net:80", "/fr/", None, "allow")),
    }
    got = judge(spark, [(i, u) for i, (u, _) in rows.items()])
    assert {i: v[:3] for i, v in got.items()} == {i: v[:3] for i, (_, v) in rows.items()}
    assert all(got[i][3] == v[3] for i, (_, v) in rows.items() if v[2])


def tokens(url):
    parts = urlsplit(url)
    path = ["".join("#" if c.isdigit() and (not k or not s[k - 1].isdigit()) else "" if c.isdigit() else c for k, c in enumerate(s)) for s in parts.path.lower().split("/") if s]
    query = [q.split("=")[0] for q in parts.query.split("&") if q]
    return sorted({f"scheme={parts.scheme}", *(f"host={h}" for h in parts.netloc.split(".")), *(f"path={p}" for p in path), *(f"query={q}" for q in query)})


def test_mined_verdicts_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()]
    rows += [(10_000 + i, f"http://s{i % 5}.example.{'net' if i % 2 else 'org'}/{('es', 'en', 'fr')[i % 3]}/{i}") for i in range(40)]
    against_brute_force(spark, rows)


def test_items_of_several_tokens_against_brute_force(spark):
    """Tokens that always come together, of which other URLs have some, none or all, beside ones that come apart."""
    draw = random.Random(5)
    groups = [["a", "b", "c"], ["d", "e"], ["f"], ["g", "h", "i"]]
    rows = []
    for i in range(60):
        path = [x for group in draw.sample(groups, draw.choice([1, 2, 3])) for x in group]
        rows.append((i, f"http://w{i % 3}.{draw.choice(['com/en', 'net/es', 'net/fr'])}/{'/'.join(path)}/"))
    for i in range(60, 110):
        rows.append((i, f"http://w{i % 4}.org/{'/'.join(draw.sample('abcdefghi', draw.randrange(1, 7)))}"))
    verdicts = against_brute_force(spark, rows)
    assert {"allow", "block"} == verdicts


def test_long_urls_in_bounded_work(spark):
    """A URL of 40 segments that reaches the support is one item, not 2^40 sets."""
    long = "http://deep.net/es/" + "/".join(f"seg{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    rows = [(1, long), (2, long)] + [(i, f"http://a{i % 7}.com/en/") for i in range(3, 103)]
    rows += [(200, long.replace("deep.net", "else.org")), (201, "http://else.org/" + "x" * 1_000_000), (202, "http://q.org/segba/segca/")]
    got = judge(spark, rows)
    assert [got[i][3] for i in (1, 200, 201, 202)] == ["block", "block", "allow", "block"]


def against_brute_force(spark, rows):
    got = judge(spark, rows)
    urls = dict(rows)
    known = [(tokens(urls[i]), v[3]) for i, v in got.items() if v[2]]
    count, with_verdict = Counter(), Counter()
    for items, verdict in known:
        for n in range(1, len(items) + 1):
            for some in combinations(items, n):
                count[some] += 1
                with_verdict[some, verdict] += 1
    least = url_rules.MIN_SUPPORT * len(known)
    rules = [(c / count[s], len(s), c / len(known), v, set(s)) for (s, v), c in with_verdict.items() if c >= least and c / count[s] >= url_rules.MIN_CONFIDENCE]
    for i, (_, _, rule, verdict) in got.items():
        if not rule:
            fit = [r[:4] for r in rules if r[4] <= set(tokens(urls[i]))]
            assert verdict == (max(fit)[3] if fit else "allow"), urls[i]
    return {verdict for _, _, rule, verdict in got.values() if not rule}


def test_tokens(spark):
    urls = ["http://a.b.c/x/12ab/?p=1&q=2&p=3#z", "https://a.a/", "http://h"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    url = F.col("url")
    got = df.select("url", url_rules.tokens(url, url_rules.host_of(url), url_rules.path_of(url)).alias("t")).collect()
    assert [r.t for r in got] == [tokens(r.url) for r in got]


def test_empty_and_repeated(spark):
    assert judge(spark, []) == {}
    assert url_rules.judged(spark.createDataFrame([(1, "http://x.org/", "")] * 3, PAGES).unionAll(spark.createDataFrame([(2, "http://x.net/es/", "")] * 2, PAGES))).count() == 5
