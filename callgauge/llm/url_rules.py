"""URL filters: listed rules, and for URLs without one, association rules mined with FP-growth.

A listed rule ``host/path`` fits its host and all subdomains where the URL's path starts with the rule's; the longest wins.
URLs that have a listed rule are the labelled ones: their tokens (scheme, host labels, path segments with numbers masked,
query keys) and their verdict make a transaction. FP-growth mines which token combinations go with a verdict; rules below
``min_support`` or ``min_confidence`` are dropped. The rest are indexed by their rarest token. A URL without a listed rule
looks up its tokens, the rules found are checked in full, and the surest decides (confidence, then number of tokens, then
support, then block). Without a mined rule the verdict is ``allow``.

Tokens that occur in the same labelled URLs only (as the segments of one long URL that is often repeated) would make
exponentially many combinations that all say the same. They are one item to FP-growth: a rule over items stands for all
its rules with one or more tokens of each item, which have the same support and confidence, and a URL that has some of the
tokens of each item is judged by the one with most of them. So no rule is lost. Items of tokens below the support are left
out beforehand, as no rule can have them; at most (tokens of a URL on average) / ``min_support`` tokens remain, and these
few are read on the driver.

URLs are reduced to distinct token sets before the lookup, so a host with any share of the URLs is one set for each kind of
path, and verdicts are joined back by token set. What is mined counts all labelled URLs.

Very long URLs are taken whole. Work still grows with the number of item combinations that reach the support: a URL that
reaches it and has many tokens, each of which other URLs have too, has exponentially many.

A null URL or one without ``://`` has no host, path, tokens or listed rule and is allowed. Repeated rows are judged alike.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from callgauge.llm.shared import keep, lower_ascii

#: (verdict, rule), as contracted.
LISTED = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
MARK = "verdict="


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=LISTED) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        fits.append(F.when(fit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, in order."""
    masked = F.regexp_replace(F.lower(path), "[0-9]+", "#")
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    parts = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host="), x)),
        F.transform(F.filter(F.split(masked, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x)),
        F.transform(
            F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1))
        ),
    )
    return F.when(host != "", F.array_sort(F.array_distinct(parts))).otherwise(F.array().cast("array<string>"))


def alike(labelled: DataFrame, least: int) -> dict[str, str]:
    """Tokens of at least ``least`` rows, each with the item it belongs to: the first of the tokens of just the same rows.

    Rows are told apart by 128 bits of hashes of their tokens, which are summed up for each token.
    """
    marks = [F.xxhash64(F.lit(seed), "tokens").cast("decimal(20,0)").alias(f"h{seed}") for seed in (1, 2)]
    each = labelled.select(*marks, F.explode("tokens").alias("token")).groupBy("token")
    rows = each.agg(F.count("*").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).where(F.col("n") >= least)
    grouped = rows.groupBy("n", "h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return {token: r.tokens[0] for r in grouped.select("tokens").toLocalIterator() for token in r.tokens}


def items_of(names: dict[str, str]) -> Column:
    """The item of each token that has one; an item comes as often as it has tokens."""
    known = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    return F.filter(F.transform("tokens", lambda t: F.try_element_at(known, t)), lambda x: x.isNotNull())


def mine(
    labelled: DataFrame, names: dict[str, str], min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(antecedent, verdict, confidence, support, item) from (tokens, verdict); ``item`` is the rarest of the antecedent."""
    mark = F.array(F.concat(F.lit(MARK), F.col("verdict")))
    items = keep(labelled.select(F.concat(F.array_distinct(items_of(names)), mark).alias("items")), "transactions")
    none = "antecedent array<string>, verdict string, confidence double, support double, item string"
    if items.isEmpty():
        return labelled.sparkSession.createDataFrame([], none)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(
        F.element_at("consequent", 1).startswith(MARK) & ~F.exists("antecedent", lambda x: x.startswith(MARK))
    ).select(
        F.monotonically_increasing_id().alias("rule"),
        "antecedent",
        F.substring(F.element_at("consequent", 1), len(MARK) + 1, 99).alias("verdict"),
        "confidence",
        "support",
    )
    rules = keep(rules, "url-rules")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    rarest = (
        rules.select("rule", F.explode("antecedent").alias("item"))
        .join(single, "item")
        .groupBy("rule")
        .agg(F.min(F.struct("freq", "item")).alias("least"))
    )
    return rules.join(rarest, "rule").select("antecedent", "verdict", "confidence", "support", F.col("least.item").alias("item"))


def by_rules(sets: DataFrame, rules: DataFrame, names: dict[str, str]) -> DataFrame:
    """(tokens, verdict) for those of the distinct token sets that a mined rule fits."""
    n = F.size(F.filter("items", lambda x: F.array_contains("antecedent", x)))
    best = F.struct("confidence", n.alias("n"), "support", "verdict")
    return (
        sets.select("tokens", items_of(names).alias("items"))
        .select("*", F.explode(F.array_distinct("items")).alias("item"))
        .join(rules, "item")
        .where(F.size(F.array_except("antecedent", "items")) == 0)
        .groupBy("tokens")
        .agg(F.max(best).alias("best"))
        .select("tokens", F.col("best.verdict").alias("verdict"))
    )


def judged(
    pages: DataFrame, rules=LISTED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    rows = pages.select("page_id", "url").select("*", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("page_id", "host", "path", listed(host, path, rules).alias("hit"), tokens(url, host, path).alias("tokens"))
    known = rows.where("hit is not null").select("page_id", "host", "path", F.col("hit.rule"), F.col("hit.verdict"), "tokens")
    other = rows.where("hit is null").drop("hit")
    labelled = keep(known.select("tokens", "verdict"), "labelled")
    names = alike(labelled, max(1, math.ceil(min_support * labelled.count())))
    mined = mine(labelled, names, min_support, min_confidence)
    found = keep(by_rules(other.select("tokens").distinct(), mined, names), "url-verdicts")
    rest = other.join(found, "tokens", "left").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )
    return known.drop("tokens").unionByName(rest)
