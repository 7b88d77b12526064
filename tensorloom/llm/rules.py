"""Quality rules as a learned decision list, in DataFrame operations only.

Statistics of each text are counted by built-in functions. Labelled statistics are coded by
a fixed number of thresholds and summed into cells. Sequential covering then learns rules
for bad documents: a conjunction of threshold conditions grows by the best information gain
on the growing part, is pruned from its end on the pruning part, is kept if it is precise
enough there, and what it covers leaves both parts. Each step is one aggregation over the
cells whose result has a bounded number of rows. The list is emitted as one ordered
conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

SPACE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words in a window whose repeats count.
REPEAT = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = ("words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "shout_share")


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once: a lambda variable, not a repeated expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column) -> Column:
    """Words in REPEAT-word windows found twice or more in the text."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - REPEAT), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(REPEAT)]))

    def positions(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(placed, lambda s: F.array_sort(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: ((k > 0) & (F.get(s, k - 1)["x"] == F.get(s, k)["x"])) | F.coalesce(F.get(s, k + 1)["x"] == F.get(s, k)["x"], F.lit(False))),
            lambda k: F.get(s, k)["i"],
        )))

    def union(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-REPEAT).alias("last"))
        return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(REPEAT), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    several = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), union(positions(h))).otherwise(F.lit(0).cast("long")))
    return F.when(n > REPEAT, several).otherwise(F.lit(0).cast("long"))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, COUNTS and the counts that STATS need besides, of every row; null texts have none.

    Columns named in carry come back in a struct, row.
    """
    row_of = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), *row_of)
    t = F.col("t")
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _covered(w).alias("n_repeat_words"))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    counted = rows.select(
        "doc_id",
        let(F.filter(F.split(t, SPACE), lambda w: w != ""), of_words).alias("w"),
        let(F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]")), of_lines).alias("l"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        without(CAPITALS).alias("n_capitals"),
        without("!").alias("n_shouts"),
        *(["row"] if carry else []),
    )
    return counted.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_capitals", "n_shouts", *(["row"] if carry else []))


def statistics() -> dict[str, Column]:
    """STATS as columns over document_counts()."""
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
        "shout_share": share("n_shouts", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


@dataclass(frozen=True)
class Condition:
    stat: str
    over: bool  # else: at most
    threshold: float

    def column(self, stats: dict[str, Column]) -> Column:
        x = stats[self.stat]
        return x > self.threshold if self.over else x <= self.threshold


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """Information gained on the covered bad documents by a further condition."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p > 0 else 0.0


def learn(train: DataFrame, thresholds: int = 12, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.97, least: int = 3) -> list[list[Condition]]:
    """Ordered rules for bad documents (label 0) from rows of STATS and label.

    thresholds quantiles of the good and of the bad rows are the candidates of each
    statistic. A rule must cover least bad rows of the pruning part with at least the given
    precision there: rows it grew on never vouch for it.
    """
    grades = [(k + 0.5) / thresholds for k in range(thresholds)]
    marks = train.groupBy("label").agg(F.count("*").alias("n"), *[F.percentile_approx(s, grades, 10000).alias(s) for s in STATS]).collect()
    if not any(r.label == 0 for r in marks):
        return []
    cuts = {s: sorted({float(x) for r in marks for x in r[s]}) for s in STATS}
    code = lambda s: sum((F.col(s) > c).cast("int") for c in cuts[s])
    bad = (F.col("label") == 0).cast("long")
    part = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")
    cells = materialize(train.select(part, *[code(s).alias(s) for s in STATS], bad.alias("p"), (1 - bad).alias("n")).groupBy("prune", *STATS).agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "cells")
    place = {s: {c: i for i, c in enumerate(cuts[s])} for s in STATS}
    holds = lambda c: (F.col(c.stat) > place[c.stat][c.threshold]) if c.over else (F.col(c.stat) <= place[c.stat][c.threshold])
    done, rules = F.lit(False), []

    def grown(rule: list[Condition]) -> tuple[Condition | None, float]:
        rows = cells.filter(~F.col("prune") & ~done & _all([holds(c) for c in rule]))
        rows = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(s).alias("k")) for i, s in enumerate(STATS)])).alias("x"), "p", "n")
        sums = rows.groupBy("x.s", "x.k").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
        p0, n0 = sum(r.p for r in sums if r.s == 0), sum(r.n for r in sums if r.s == 0)
        best, most = None, 0.0
        if not p0 or not n0:
            return None, p0
        for i, s in enumerate(STATS):
            own = [r for r in sums if r.s == i]
            for k, cut in enumerate(cuts[s]):
                p, n = sum(r.p for r in own if r.k > k), sum(r.n for r in own if r.k > k)
                for over, a, b in ((True, p, n), (False, p0 - p, n0 - n)):
                    if (g := _gain(p0, n0, a, b)) > most + 1e-9:
                        best, most = Condition(s, over, cut), g
        return best, p0

    for _ in range(max_rules):
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            c, p0 = grown(rule)
            if c is None:
                break
            rule.append(c)
        if not rule:
            break
        tried = [_all([holds(c) for c in rule[:k]]) for k in range(1, len(rule) + 1)]
        got = cells.filter(~done & F.col("prune")).agg(*[F.coalesce(F.sum(F.when(t, F.col(x))), F.lit(0)) for t in tried for x in ("p", "n")]).first()
        worth = [((p - n) / (p + n) if p + n else -1.0, p, n, k) for k in range(len(rule)) for p, n in [got[2 * k : 2 * k + 2]]]
        _, p, n, k = max(worth, key=lambda x: (x[0], -x[3]))
        if p < least or p < precision * (p + n):
            break
        rules.append(rule[: k + 1])
        done = done | tried[k]
    return rules


def verdict(rules: list[list[Condition]], stats: dict[str, Column]) -> tuple[Column, Column]:
    """(kept, number of the rule that fired or null) as ordered conditional expressions."""
    kept, fired = F.when(base_failed(), False), F.when(base_failed(), F.lit(0))
    for i, rule in enumerate(rules, 1):
        hit = _all([c.column(stats) for c in rule])
        kept, fired = kept.when(hit, False), fired.when(hit, F.lit(i))
    return kept.otherwise(True), fired


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: list[str] | None = None, **options: float) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and rule of every row.

    rule: 0 where the base failed, the number of the learned rule that rejects, null if
    kept. Null and empty texts have no words and fail the base. Null labels and labels
    without a document teach nothing; without bad labels the list is empty. Rows with one
    id are judged each by itself; an empty table gives an empty result. Columns named in
    carry come back in a struct, row; others are left out.
    """
    counts = materialize(document_counts(docs, id_col, text_col, carry), "counts")
    stats = statistics()
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label is not null")
    train = materialize(counts.filter(~base_failed()).select("doc_id", *[c.alias(s) for s, c in stats.items()]).join(marked, "doc_id"), "rule_train")
    kept, fired = verdict(learn(train, **options), stats)
    return counts.select("doc_id", *COUNTS, base_failed().alias("base_failed"), kept.alias("kept"), fired.alias("rule"), *(["row"] if carry else []))
