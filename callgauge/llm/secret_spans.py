"""Secrets in texts, found with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (Russ Cox, Regular Expression Matching with
a Trigram Index): a text that matches must satisfy it. Each Arrow batch of texts is a segment of the index: posting lists
of the trigrams the queries name, over lower-cased text. The queries intersect and unite the lists, and only the
candidates are searched with the expression itself. A rule without mandatory trigrams has the query "all" and scans every
text. Texts are searched whole, and one row never meets another, so there is no shuffle.

Every rule takes time in proportion to the text, whatever it holds; no run of characters is read again from each of its
places. A private key counts as one span from its BEGIN line to its END line, or to the end of its base64 lines.

Null and empty texts have no spans. Very long texts are searched whole, one at a time. Spans count code points, end exclusive; matches of one kind do not overlap, those of
different kinds may. Equal rows give equal spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column, functions as F

try:
    from re import _constants as sre, _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count as ``kind`` when ``group`` has ``least`` characters or more; ``span`` is what counts."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    span: int | str = 0


#: The base kinds as contracted, then widely published token formats.
BASE = (
    Rule(
        "assign",
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: A key block: white space (or its escapes in JSON), header lines, lines of base64 and a shorter last one.
GAP = r"(?:\s|\\[nrt])"
BLOCK = (
    rf"(?:{GAP}*+[A-Z][A-Za-z-]*+:(?:[^\n\\-]|-(?!-))*+)*+(?:{GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++"
    rf"(?:{GAP}*+[A-Za-z0-9+/]++={{0,2}}+(?={GAP}|\Z|-))?+"
)
EXTRA = (
    Rule(
        "pem",  # up to the END line if nothing else is fenced before it, else as far as the block goes
        r"-----BEGIN (?P<label>(?:[A-Z]+ )*)PRIVATE KEY-----"
        rf"(?:(?:[^-]|-{{1,4}}+(?!-))*+-----END (?P=label)PRIVATE KEY-----|{BLOCK})?+",
    ),
    Rule(
        "jwt",  # from the first eyJ of a run on; what fails there fails at every later one of the run
        r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))"
        r"(?P<span>eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
        span="span",
    ),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + EXTRA

#: A query is "all", a trigram, or ("and" | "or", queries).
ALL = "all"
#: Most alternatives that are kept apart as exact strings.
ALTERNATIVES = 16


def trigram_query(pattern: str):
    """What trigrams a lower-cased text must have for the pattern to match anywhere in it."""
    exact, query = _analyse(sre_parser.parse(pattern))
    return _both(query, _of_strings(exact)) if exact else query


def _of_strings(strings: set[str] | None):
    """All trigrams of one of the strings."""
    if not strings or any(len(s) < 3 for s in strings):
        return ALL
    each = [_join("and", {s[i : i + 3] for i in range(len(s) - 2)}) for s in sorted(strings)]
    return _join("or", each)


def _join(kind: str, queries):
    queries = list(dict.fromkeys(sorted(queries, key=str)))
    return queries[0] if len(queries) == 1 else (kind, tuple(queries))


def _both(a, b):
    if ALL in (a, b):
        return b if a == ALL else a
    return _join("and", [a, b])


def _analyse(items) -> tuple[set[str] | None, object]:
    """Of a sequence: the exact strings it matches, if few, and a query that holds besides."""
    runs: set[str] | None = {""}  # strings that end where we are, since the last gap
    query, gap = ALL, False
    for op, arg in items:
        exact, inner = _of_item(op, arg)
        query = _both(query, inner)
        joined = {a + b for a, b in product(runs, exact)} if exact is not None else set()
        if exact is None or len(joined) > ALTERNATIVES:
            query = _both(query, _of_strings(runs))
            gap, joined = True, set(exact or {""})
        runs = joined
    if gap:
        return None, _both(query, _of_strings(runs))
    return runs, query


def _of_item(op, arg) -> tuple[set[str] | None, object]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ALL
    if op is sre.SUBPATTERN:
        return _analyse(arg[-1])
    if op is sre.BRANCH:
        parts = [_analyse(branch) for branch in arg[1]]
        if all(exact is not None for exact, _ in parts):
            together = set().union(*(exact for exact, _ in parts))
            if len(together) <= ALTERNATIVES:
                return together, ALL
        each = [_both(query, _of_strings(exact)) for exact, query in parts]
        return None, ALL if ALL in each else _join("or", each)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        exact, query = _analyse(body)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, ALL
        return (exact, query) if (low, high) == (1, 1) else (None, _both(query, _of_strings(exact)) if low else ALL)
    if op is sre.AT:
        return {""}, ALL
    if op is sre.IN and all(kind in (sre.LITERAL, sre.RANGE) for kind, _ in arg):
        chars = {chr(c).lower() for kind, x in arg for c in ([x] if kind is sre.LITERAL else range(x[0], min(x[1], x[0] + 64) + 1))}
        return (chars, ALL) if len(chars) <= 4 else (None, ALL)
    return None, ALL


def needed(query) -> set[str]:
    if query == ALL:
        return set()
    return {query} if isinstance(query, str) else set().union(*(needed(q) for q in query[1]))


def candidates(query, postings: dict[str, set[int]], rows: int) -> set[int]:
    """Rows of a segment that satisfy a query."""
    if query == ALL:
        return set(range(rows))
    if isinstance(query, str):
        return postings[query]
    lists = [candidates(q, postings, rows) for q in query[1]]
    return set.intersection(*sorted(lists, key=len)) if query[0] == "and" else set.union(*lists)


def finder(rules: tuple[Rule, ...]) -> Callable[[list[str | None]], list[list[tuple[int, int, str]]]]:
    """Searches a segment of texts: spans (start, end, kind) of each, by start, then in the order of the rules."""
    plans = [(i, rule, _searcher(rule), trigram_query(rule.pattern)) for i, rule in enumerate(rules)]
    grams = sorted(set().union(*(needed(query) for *_, query in plans)))

    def search(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        lowered = [(t or "").lower() for t in texts]
        postings = {g: {row for row, text in enumerate(lowered) if g in text} for g in grams}
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i, rule, spans, query in plans:
            for row in candidates(query, postings, len(texts)):
                if texts[row]:
                    found[row].extend((start, i, end) for start, end in spans(texts[row]))
        return [[(start, end, rules[i].kind) for start, i, end in sorted(spans)] for spans in found]

    return search


def _searcher(rule: Rule) -> Callable[[str], Iterator[tuple[int, int]]]:
    pattern = rule.pattern
    if re.fullmatch(r"\[[^\]]+\]\+", pattern) and rule.least > 1:
        # runs of one class: the longest run is the match, so short ones need not be found first
        pattern = f"{pattern[:-1]}{{{rule.least},}}"
    compiled = re.compile(pattern)

    def spans(text: str) -> Iterator[tuple[int, int]]:
        for m in compiled.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                yield m.span(rule.span)

    return spans


def spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<start,end,kind>> of the secrets in a text column."""

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = finder(rules)
        for texts in batches:
            yield pd.Series(search(texts.tolist()))

    return run(text)


def masked(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with each secret (overlapping spans united) replaced by its first kind in brackets."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = finder(rules)
        for texts in batches:
            yield pd.Series([_mask(t, s) for t, s in zip(texts, search(texts.tolist()))], dtype=object)

    return run(text)


def _mask(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    if not found:
        return text
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(found: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    each = F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")
