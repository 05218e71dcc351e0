"""Quality rules: text statistics and a learned decision list, all in built-in functions.

The statistics of a text are computed inside its row.  The list is learned by sequential covering:
a rule is a conjunction of thresholds, grown literal by literal on two thirds of the labelled rows
and pruned on the rest, then the rows it covers are set aside and the next rule is grown.  Only counts
of bad and good rows by (statistic, bin) reach the driver; they are as many for any number of rows.
The result is an ordered conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import let, words_of
from almanac.session import materialise

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper")
#: Statistics that rules may test, from the counts.
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "mark_share", "upper_share", "line_words")
#: Shares of the labelled rows at which a statistic may be cut.
CUTS = (0.0, 0.01, 0.03, 0.05, *(i / 16 for i in range(1, 16)), 0.95, 0.97, 0.99, 1.0)


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words occurring twice or more, the first occurrence included.

    A window is known by a 64-bit hash of its words.  Texts without an equal pair, nearly all, end
    after a distinct count; in the others windows are sorted with their places, equal neighbours are
    the repeated ones, and the covered words are the gaps between their places, at most five each.
    """

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            near = lambda x, j: x["h"] == F.get(p, j)["h"]
            both = F.filter(p, lambda x, j: F.coalesce(near(x, j - 1), F.lit(False)) | F.coalesce(near(x, j + 1), F.lit(False)))
            return F.sort_array(F.transform(both, lambda x: x["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - i, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

        return let(let(placed, repeated), total)

    def windows(h: Column) -> Column:
        last = F.size(h) - WINDOW + 1
        return F.transform(
            F.slice(h, F.lit(1), F.greatest(last, F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]),
        )

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    zero = F.lit(0).cast("bigint")
    return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(h)))


def count_columns(text: Column) -> dict[str, Column]:
    """The counts of a text by name; a null text is an empty one."""
    t = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("bigint")
    left = lambda pattern: long(F.length(F.regexp_replace(t, pattern, "")))

    def of(words: Column) -> Column:
        joined = F.array_join(words, "")
        return F.struct(
            long(F.size(words)).alias("n_words"), long(F.length(joined)).alias("word_chars"), _repeated_words(words).alias("n_repeat_words")
        )

    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    pair = let(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return {
        "_words": let(words_of(text), of),
        "_lines": pair,
        "n_symbols": left(r"[^#*$%&|<>]+"),
        "n_marks": left(r"[^!?]+"),
        "n_upper": left(r"[^\p{Lu}]+"),
    }


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (a frame without columns named like the statistics) with the counts of each text."""
    wide = docs.select("*", *[c.alias(n) for n, c in count_columns(F.col(text)).items()])
    return wide.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        *[F.col(f"_words.{c}").alias(c) for c in ("n_words", "word_chars", "n_repeat_words")],
        F.col("_lines.n").alias("n_lines"),
        F.col("_lines.dup").alias("n_dup_lines"),
        "n_symbols",
        "n_marks",
        "n_upper",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Statistics as ratios; 0 for a text without words."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return {
        "mean_word": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "mark_share": per("n_marks", "word_chars"),
        "upper_share": per("n_upper", "word_chars"),
        "line_words": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Literal:
    """``statistic > cut`` or, if not ``above``, ``statistic <= cut``."""

    feature: str
    cut: float
    above: bool

    def column(self) -> Column:
        x = features()[self.feature]
        return x > self.cut if self.above else x <= self.cut


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = F.lit(True)
        for literal in self.literals:
            out = out & literal.column()
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def number(self) -> Column:
        """Number from 1 of the first rule that holds, 0 if none does."""
        out = F.lit(0)
        for i in reversed(range(len(self.rules))):
            out = F.when(self.rules[i].column(), i + 1).otherwise(out)
        return out


def learn(
    labelled: DataFrame,
    key: str,
    bad: Column,
    max_rules: int = 8,
    max_literals: int = 3,
    min_precision: float = 0.9,
    min_bad: int = 3,
) -> DecisionList:
    """Rules for the bad rows of ``labelled`` (counts of ``with_statistics``, a key, a condition).

    All labelled rows are counted.  A rule must hold ``min_precision`` of bad rows on the rows it was
    grown on and on those it was pruned on.  Rows with a null condition are left out; without bad or
    good rows the list is empty.  The growing part is drawn by a hash of the key, so reruns agree.
    """
    known = labelled.where(bad.isNotNull())
    cuts = _cuts(known, bad)
    x = features()
    bins = {f: _bin(x[f], cuts[f]) for f in cuts}
    grow = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(3)) < 2
    if not bins:
        return DecisionList()
    flat = known.select(*[b.alias(f) for f, b in bins.items()], grow.alias("_grow"), bad.alias("_bad"))
    count = lambda c: F.sum(c.cast("bigint"))
    cells = materialise(
        flat.groupBy(*bins).agg(
            count(F.col("_grow") & F.col("_bad")).alias("gb"),
            count(F.col("_grow") & ~F.col("_bad")).alias("gg"),
            count(~F.col("_grow") & F.col("_bad")).alias("pb"),
            count(~F.col("_grow") & ~F.col("_bad")).alias("pg"),
        ),
        "cells",
    )
    rules, left = [], cells
    while len(rules) < max_rules:
        found = _prune(left, cuts, _grow(left, cuts, max_literals))
        if not found or found[1] < min_bad or found[1] < min_precision * (found[1] + found[2]):
            break
        literals, b, g = found
        if literals in [r.literals for r in rules]:
            break
        rules.append(Rule(literals, b, g))
        left = left.where(~_on_bins(literals, cuts))
    return DecisionList(tuple(rules))


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    """How many cut points lie under the value."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value))


def _cuts(known: DataFrame, bad: Column) -> dict[str, list[float]]:
    """Cut points of each statistic: midway between neighbouring quantiles of the bad and of the good rows."""
    x, classes = features(), {"b": bad, "g": ~bad}
    asked = [F.percentile_approx(F.when(c, x[f]), list(CUTS), 10_000).alias(f"{k}_{f}") for f in FEATURES for k, c in classes.items()]
    row = known.agg(*asked).first()
    values = {f: sorted({v for k in classes for v in row[f"{k}_{f}"] or []}) for f in FEATURES}
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in values.items() if len(v) > 1}


def _on_bins(literals: Sequence[Literal], cuts: dict[str, list[float]]) -> Column:
    out = F.lit(True)
    for x in literals:
        place = cuts[x.feature].index(x.cut)
        out = out & ((F.col(x.feature) > place) if x.above else (F.col(x.feature) <= place))
    return out


def _grow(left: DataFrame, cuts: dict[str, list[float]], most: int) -> tuple[Literal, ...]:
    """Adds the literal of highest information gain until no good row is covered or nothing is gained."""
    names, rule = list(cuts), ()
    for _ in range(most):
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("b")) for i, n in enumerate(names)]))
        sums = left.where(_on_bins(rule, cuts)).select(pairs.alias("x"), "gb", "gg").groupBy("x.f", "x.b")
        counts = {(r["f"], r["b"]): (r["bad"], r["good"]) for r in sums.agg(F.sum("gb").alias("bad"), F.sum("gg").alias("good")).collect()}
        best, gain = None, 1e-9
        for i, name in enumerate(names):
            own = [counts.get((i, b), (0, 0)) for b in range(len(cuts[name]) + 1)]
            bad, good = sum(c[0] for c in own), sum(c[1] for c in own)
            if not bad or not good:
                return rule
            low_bad = low_good = 0
            for place, cut in enumerate(cuts[name]):
                low_bad, low_good = low_bad + own[place][0], low_good + own[place][1]
                for above, b, g in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                    value = b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good))) if b else 0.0
                    if value > gain:
                        best, gain = Literal(name, cut, above), value
        if best is None:
            break
        rule += (best,)
    return rule


def _prune(left: DataFrame, cuts: dict[str, list[float]], rule: tuple[Literal, ...]):
    """The beginning of the rule with the best share of bad over good rows on the pruning part: (literals, bad, good).

    The counts are of both parts, as the rule must hold on all labelled rows that are left.
    """
    if not rule:
        return None
    starts = [rule[: k + 1] for k in range(len(rule))]
    when = lambda s, c: F.coalesce(F.sum(F.when(_on_bins(s, cuts), F.col(c))), F.lit(0))
    row = left.agg(*[when(s, c).alias(f"{c}{k}") for k, s in enumerate(starts) for c in ("gb", "gg", "pb", "pg")]).first()

    def worth(k: int) -> float:
        b, g = row[f"pb{k}"], row[f"pg{k}"]
        return (b - g) / (b + g) if b + g else -1.0

    best = max(range(len(starts)), key=lambda k: (worth(k), -k))
    if worth(best) <= 0:
        return None
    return starts[best], row[f"gb{best}"] + row[f"pb{best}"], row[f"gg{best}"] + row[f"pg{best}"]


def learn_from_labels(statistics: DataFrame, labels: DataFrame) -> DecisionList:
    """Learned on the documents that ``labels`` (doc_id, quality) covers and the base passes, as only those are left to it."""
    passed = statistics.where(~base_failed()).select("doc_id", *COUNTS)
    narrow = passed.join(labels.select("doc_id", "quality"), "doc_id")
    return learn(narrow, "doc_id", F.col("quality") == 0)


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document: base_failed, rule (0: none holds) and kept.

    The text is read once: the counts are written and the list is learned and applied on them.  Rows are
    judged one by one, so repeated rows and null ids keep their own verdicts; unlabelled tables keep all
    that passes the base.
    """
    counted = materialise(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    rules = learn_from_labels(counted, labels)
    return counted.withColumn("base_failed", base_failed()).withColumn("rule", rules.number()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are.

    The documents are written once with their counts, which the list is learned on and applied to.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", F.col("text").alias("body"))
    counted = materialise(with_statistics(packed, "body").drop("body"), "counted")
    rules = learn_from_labels(counted.drop("doc"), labels)
    return counted.where(~base_failed() & (rules.number() == 0)).select("doc.*")
