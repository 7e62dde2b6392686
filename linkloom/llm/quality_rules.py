"""Quality rules: fixed base rules, then a learned decision list, all as Spark expressions.

``statistics`` adds the counts of a text (see the fields below).  ``learn`` grows
an ordered list of rejection rules by sequential covering: each rule is a short
conjunction of thresholds on ratios of those counts, grown by information gain
on two thirds of a bounded labelled sample and pruned on the other third; what a
rule covers is taken out before the next one is grown.  ``apply_rules`` emits
the list as one ordered conditional expression.

Defined results: a null text has no words; it and every text of fewer than
``MIN_WORDS`` words fail the base rules.  Without labels, or with labels of one
class, the list is empty and the base rules alone decide.  Windows are compared
by 64-bit hashes of their words' hashes.  Repeated rows get equal verdicts, and a
repeated id is learned from each of its texts.  Very long texts count whole, in
arrays of one word's size each.  Columns of the same names as the counts are
replaced.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from linkloom.llm.common import bounded_sample
from linkloom.llm.native import WORD, let, removed

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Labelled documents of each class that learning may use, those of the smallest id hashes.
LABELLED_PER_CLASS = 2000
MAX_RULES, MAX_CONDITIONS, QUANTILES, LEAST_COVERED, LEAST_PRECISION = 12, 4, 24, 5, 0.95

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct", "n_digits", "n_lines", "n_distinct"]
#: Ratios that rules may test, as (numerator, denominator).
RATIOS = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "punctuation_share": ("n_punct", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


def _repeated(h: Column) -> Column:
    """Words inside windows that occur twice or more, from the words' hashes."""

    def covered(sorted_: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(sorted_, i - 1)["h"]) | (x["h"] == F.get(sorted_, i + 1)["h"])
        at = F.array_sort(F.transform(F.filter(sorted_, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
        spans = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("long"))
        return let(at, lambda p: F.aggregate(spans(p), F.lit(0).cast("long"), lambda a, x: a + x))

    def windows(w: Column) -> Column:
        tagged = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(tagged, covered))

    made = F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    return F.when(F.size(h) < WINDOW, F.lit(0).cast("long")).otherwise(let(made, windows))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of COUNTS."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    hashes = F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    of_words = let(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _repeated(h).alias("n_repeat_words"), F.size(F.array_distinct(h)).cast("long").alias("n_distinct")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.drop(*COUNTS).withColumns({"__w": of_words, "__l": of_lines})
    return out.withColumns(
        {
            "n_words": F.col("__w.n_words"),
            "word_chars": removed(t, WORD),
            "n_symbols": removed(t, r"[#*$%&|<>]+"),
            "n_dup_lines": F.col("__l.n_dup_lines"),
            "n_repeat_words": F.col("__w.n_repeat_words"),
            "n_upper": removed(t, r"[A-Z]+"),
            "n_punct": removed(t, r"[!-/:-@\[-`{-~]+"),
            "n_digits": removed(t, r"[0-9]+"),
            "n_lines": F.col("__l.n_lines"),
            "n_distinct": F.col("__w.n_distinct"),
        }
    ).drop("__w", "__l")


class Condition(NamedTuple):
    ratio: str
    above: bool  #: true: over the threshold, false: at or under it
    threshold: float

    def column(self) -> Column:
        a, b = RATIOS[self.ratio]
        value = F.col(a) / F.greatest(F.col(b), F.lit(1))
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, x: dict[str, float]) -> bool:
        return x[self.ratio] > self.threshold if self.above else x[self.ratio] <= self.threshold


Rule = list[Condition]


def _matches(rule: Rule, rows: list[dict]) -> tuple[int, int]:
    p = n = 0
    for x in rows:
        if all(c.holds(x) for c in rule):
            p, n = p + x["bad"], n + 1 - x["bad"]
    return p, n


def _grow(rows: list[dict], candidates: list[Condition]) -> Rule:
    """Adds the condition of the highest FOIL gain until no negative is covered or none gains."""
    rule: Rule = []
    inside = rows
    while len(rule) < MAX_CONDITIONS:
        p0 = sum(x["bad"] for x in inside)
        n0 = len(inside) - p0
        if not p0 or not n0:
            break
        best, chosen = 0.0, None
        for c in candidates:
            p = n = 0
            for x in inside:
                if c.holds(x):
                    p, n = p + x["bad"], n + 1 - x["bad"]
            if p >= LEAST_COVERED and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > best + 1e-9:
                best, chosen = gain, c
        if chosen is None:
            break
        rule.append(chosen)
        inside = [x for x in inside if chosen.holds(x)]
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """Drops final conditions as long as (p - n) / (p + n) on the pruning rows doesn't fall."""
    worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_matches(r, rows))
    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn_from(rows: list[dict]) -> list[Rule]:
    """Rules for rows with their ratios and bad (1: to be rejected), in the order given."""
    grow, prune = [x for i, x in enumerate(rows) if i % 3 != 2], [x for i, x in enumerate(rows) if i % 3 == 2]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and any(x["bad"] for x in grow):
        candidates = []
        for name in RATIOS:
            values = sorted(x[name] for x in grow)
            cuts = sorted({values[int(q * (len(values) - 1) / QUANTILES)] for q in range(1, QUANTILES)} | {v for x in grow if x["bad"] and hash_free(x) for v in (x[name],)})
            candidates += [Condition(name, above, t) for t in cuts for above in (True, False)]
        rule = _prune(_grow(grow, candidates), prune)
        if not rule:
            break
        p, n = (sum(x) for x in zip(_matches(rule, grow), _matches(rule, prune), strict=True))
        if p < LEAST_COVERED or p / (p + n) < LEAST_PRECISION:
            break
        rules.append(rule)
        grow = [x for x in grow if not all(c.holds(x) for c in rule)]
        prune = [x for x in prune if not all(c.holds(x) for c in rule)]
    return rules


def hash_free(x: dict) -> bool:
    """Every 20th rejected row lends its own values as thresholds, so that small classes get cuts of their own."""
    return x["at"] % 20 == 0


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _fails(r: Row) -> bool:
    return r["n_words"] < MIN_WORDS or 100 * r["n_repeat_words"] > MAX_REPEAT_PERCENT * r["n_words"]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_class: int = LABELLED_PER_CLASS) -> list[Rule]:
    """Rules from the statistics of a bounded labelled sample that passes the base rules; the sample is bounded by its limits, so it is broadcast."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__k"), F.col(label).cast("int").alias("__y"))
    few = bounded_sample(known.where("__y = 0"), "__k", per_class).unionAll(bounded_sample(known.where("__y = 1"), "__k", per_class))
    joined = docs.select(F.col(doc_id).alias("__d"), F.col(text).alias("__t")).join(F.broadcast(few), F.col("__d") == F.col("__k"))
    # the base rules are applied to what is collected: as a filter they would move below the join, onto all documents
    got = [r for r in statistics(joined, "__t").select("__d", "__y", *COUNTS).collect() if not _fails(r)]
    rows = []
    for i, r in enumerate(sorted(got, key=lambda r: (str(r["__d"]), r["__y"], [r[c] for c in COUNTS]))):
        rows.append({name: r[a] / max(r[b], 1) for name, (a, b) in RATIOS.items()} | {"bad": int(r["__y"] == 0), "at": i})
    return learn_from(rows)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(i)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs with the counts, base_failed, the number of the learned rule that rejects it, and kept."""
    out = statistics(docs.drop("base_failed", "rule", "kept"), text).withColumn("base_failed", base_failed())
    return out.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules))).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
