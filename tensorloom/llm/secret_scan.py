"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is compiled to a Boolean query over the trigrams that any
match must hold: an OR of ANDs. The index lists, for each trigram of the rule set, the
documents that have it, by a hash of their id and text. Lists of one AND are intersected by
counting its trigrams in each document; documents that fill one of the ANDs are candidates
and are verified by the expression. A rule without a mandatory trigram scans every document.

Postings are shuffled, texts hardly are: of each AND the shortest list is looked up in the
index, and only texts that hold one of those trigrams meet the candidates. All others are
scanned where they are read, for the rules without a mandatory trigram.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import let
from .storage import materialize

#: An OR of ANDs; an empty AND holds for every text.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
MOST_STRINGS, MOST_ANDS = 64, 64
SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group whose length counts (0: the match) and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("hub", "gh[opsu]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED


def _reduced(ands: set[frozenset[str]]) -> Query:
    """Without ANDs that hold a smaller one; too many ANDs ask for nothing."""
    least = frozenset(a for a in ands if not any(b < a for b in ands))
    return least if len(least) <= MOST_ANDS else ANY


def _of_strings(strings: set[str]) -> Query:
    return _reduced({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _both(a: Query, b: Query) -> Query:
    return _reduced({x | y for x, y in product(a, b)})


def _node(op: object, arg: object) -> tuple[set[str] | None, Query]:
    """(all strings a node matches, lower-cased, if few; what must be there otherwise)."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.IN:
        if all(kind is sre.LITERAL for kind, _ in arg):
            chars = {chr(c).lower() for _, c in arg}
            return (chars, ANY) if len(chars) <= 4 else (None, ANY)
        return None, ANY
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*[s for s, _ in parts]), ANY
        return None, _reduced(set().union(*[_of_strings(s) if s is not None else q for s, q in parts]))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if high == 1 and strings is not None:
            return (strings | {""} if not low else strings), ANY
        if not low:
            return None, ANY
        return None, _of_strings(strings) if strings is not None else query
    return None, ANY


def _sequence(nodes: object) -> tuple[set[str] | None, Query]:
    strings, query, whole = {""}, ANY, True
    for op, arg in nodes:
        own, needed = _node(op, arg)
        if own is not None and len(strings) * len(own) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, own)}
            continue
        whole, query = False, _both(query, _of_strings(strings))
        strings = own if own is not None and len(own) <= MOST_STRINGS else {""}
        query = _both(query, needed)
    return (strings, ANY) if whole else (None, _both(query, _of_strings(strings)))


def trigram_query(pattern: str) -> Query:
    """The query that every text with a match fulfils, over its lower-cased trigrams."""
    strings, query = _sequence(parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def _held(low: Column, trigrams: list[str]) -> Column:
    """Numbers of the trigrams in a lower-cased text."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(trigrams)]))


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(key, trigram number): the inverted index of the given trigrams over rows of key and t."""
    held = let(F.lower("t"), lambda low: _held(low, trigrams))
    # explode() would have the optimizer evaluate the array in a filter as well
    return rows.select("key", F.explode_outer(held).alias("trigram")).filter("trigram is not null")


def indexed(rules: tuple[Rule, ...]) -> dict[int, Query]:
    """Queries of the rules that have mandatory trigrams, by the number of the rule."""
    return {i: q for i, r in enumerate(rules) if frozenset() not in (q := trigram_query(r.pattern))}


def candidates(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, list[str]]:
    """(key, rules): the rules whose trigram query a document fulfils, by number; and trigrams that they hold one of.

    The trigrams are those with the shortest list of each AND.
    """
    queries = indexed(rules)
    trigrams = sorted({g for q in queries.values() for a in q for g in a})
    wanted = [(trigrams.index(g), i, k, len(a)) for i, q in queries.items() for k, a in enumerate(sorted(q, key=sorted)) for g in a]
    if not wanted:
        return rows.select("key", F.array().cast("array<int>").alias("rules")).limit(0), []
    index = materialize(postings(rows, trigrams), "postings")
    lengths = {r.trigram: r["count"] for r in index.groupBy("trigram").count().collect()}
    short = sorted({min(a, key=lambda g: (lengths.get(trigrams.index(g), 0), g)) for q in queries.values() for a in q})
    # the rule set's own table: its size depends on the rules alone
    table = rows.sparkSession.createDataFrame(wanted, "trigram int, rule int, part int, needed int")
    lists = index.join(F.broadcast(table), "trigram")
    full = lists.groupBy("key", "rule", "part", "needed").agg(F.count_distinct("trigram").alias("n")).filter("n = needed")
    return full.groupBy("key").agg(F.collect_set("rule").alias("rules")), short


def _spans(t: Column, number: int, rule: Rule) -> Column:
    """Spans of a rule in code points: between its matches lie the pieces that split() returns."""
    expression = F.lit(rule.pattern)
    def placed(found: Column) -> Column:
        lengths = F.regexp_extract_all(t, expression, F.lit(rule.group)) if rule.group else found
        steps = F.arrays_zip(F.transform(F.split(t, rule.pattern), F.length).alias("gap"), F.transform(found, F.length).alias("own"), F.transform(lengths, F.length).alias("counted"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + x["gap"]
            end = begin + F.coalesce(x["own"], F.lit(0))
            span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(x["counted"] >= rule.least, F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

        return F.when(F.size(found) > 0, F.aggregate(steps, start, step, lambda a: a["out"])).otherwise(F.array().cast(SPANS))

    return let(F.regexp_extract_all(t, expression, F.lit(0)), placed)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id and spans, array<struct<start, kind, end>> by start and kind number, of every row.

    Positions count code points, the end is exclusive; kind is the rule's place in rules.
    Matches of a rule are leftmost and do not overlap; those whose counted group is too
    short are dropped. Null texts count as empty. Rows with one id are scanned each by
    itself; an empty table gives an empty result. keep_text adds the text as t. Columns named
    in carry come back in a struct, row; others are left out.
    """
    row_of = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *row_of)
    rows = rows.withColumn("key", F.xxhash64("doc_id", "t"))
    found, short = candidates(rows.select("key", "t"), rules)
    scanned = [i for i in range(len(rules)) if i not in indexed(rules)]
    rest = ["doc_id", *(["t"] if keep_text else []), *(["row"] if carry else [])]

    def spans(of: list[int], needed: bool) -> Column:
        parts = []
        for i in of:
            own = _spans(F.col("t"), i, rules[i])
            parts.append(own if i in scanned or not needed else F.when(F.array_contains("rules", F.lit(i)), own).otherwise(F.array().cast(SPANS)))
        return F.array_sort(F.concat(F.array().cast(SPANS), *parts)).alias("spans")

    names = ["doc_id", "spans", *rest[1:]]
    if not short:
        return rows.select(*rest, spans(scanned, False)).select(names)
    marked = rows.withColumn("holds", let(F.lower("t"), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(g)) for g in short])))
    far = marked.filter("not holds").select(*rest, spans(scanned, False))
    near = marked.filter("holds").join(found, "key", "left").select(*rest, spans(list(range(len(rules))), True))
    return far.unionByName(near).select(names)


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row; cases as in find_secrets()."""
    found = find_secrets(docs, RULES, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)], F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def masked(t: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by a mark."""

    def step(a: Column, s: Column) -> Column:
        joined = s["start"] < a["end"]
        gap = F.substr(t, a["end"] + 1, F.greatest(s["start"] - a["end"], F.lit(0)))
        out = F.when(joined, a["out"]).otherwise(F.array_append(a["out"], F.concat(gap, F.lit(mark))))
        return F.struct(F.greatest(a["end"], s["end"]).alias("end"), out.alias("out"))

    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))
    return F.when(F.size(spans) == 0, t).otherwise(F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(t, a["end"] + 1, F.length(t)))))
