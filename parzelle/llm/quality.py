"""Quality rules: statistics of whole texts and a learned decision list.

The list is learned from labelled documents by sequential covering: a rule is a
conjunction of thresholds that is grown on one part of the examples, one condition at
a time by information gain, and pruned from its end on the other part; the examples it
covers are set aside and the next rule is grown from the rest. The ordered rules become
one conditional expression over the statistics, so judging a corpus is a single pass
of built-in functions over the texts.

Defined cases: null is the empty text; texts without words have all statistics 0 and
fail the base rules; documents without a label or with a null one teach nothing; with
no labelled document (or none of one class) the list is empty and keeps all that pass
the base rules. Texts of any length are read whole; repeated rows are judged each on its
own; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parzelle.llm.common import WORD, held_out, let

#: Most labelled documents the rules are learned from; chosen by a hash of the id.
EXAMPLES = 6_000
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\f\r"
MARKS = "!?"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share",
            "mark_share", "capital_share", "line_words")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, n: int = 3) -> Column:
    """How many words lie in an n-word window that occurs twice or more.

    Windows are sorted by a 64-bit hash of their words together with their places;
    those with an equal neighbour are repeated. n log n for any text.
    """
    def windows(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(
            F.xxhash64(*(F.get(w, i + j) for j in range(n))).alias("h"), i.alias("i")))
        return let(F.array_sort(hashed), places)

    def places(s: Column) -> Column:
        marked = F.transform(s, lambda x, k: F.when(
            (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
        return let(F.array_compact(marked), covered)

    def moved(p: Column, by: int) -> Column:
        return F.transform(p, lambda i: i + by)

    def covered(p: Column) -> Column:
        return F.size(F.array_distinct(F.concat(*(moved(p, by) for by in range(n)))))

    return F.when(F.size(words) < n, 0).otherwise(let(words, windows)).cast("long")


def statistics(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The base statistics (whole numbers) and a few more of every text."""
    text = F.coalesce("text", F.lit(""))
    out = (docs.select(*keep, text.alias("_text"))
           .select(*keep, "_text", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
                   let(F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(
                       F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds"))).alias("_lines")))
    t, whole = F.col("_text"), F.length("_text")
    return out.select(
        *keep, F.size("_words").cast("long").alias("n_words"),
        _without(t, SPACE).cast("long").alias("word_chars"),
        (whole - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.col("_lines.n") - F.col("_lines.kinds")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.col("_lines.n").cast("long").alias("n_lines"),
        (whole - _without(t, MARKS)).cast("long").alias("n_marks"),
        (whole - _without(t, CAPITALS)).cast("long").alias("n_capitals"))


def features(stats: DataFrame) -> DataFrame:
    """Add the shares that the rules look at."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return stats.withColumns({
        "word_length": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "mark_share": F.col("n_marks") / chars, "capital_share": F.col("n_capitals") / chars,
        "line_words": F.col("n_words") / lines})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def _counts(rows, rule: Rule) -> tuple[int, int]:
    """Bad and good examples that a rule covers."""
    covered = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return sum(covered), len(covered) - sum(covered)


def _grow(rows, thresholds) -> Rule:
    """Add the condition with the highest gain until no good example is covered."""
    rule: Rule = ()
    left = rows
    while True:
        bad = sum(r["bad"] for r in left)
        if bad in (0, len(left)) or len(rule) == 6:
            return rule
        base = math.log2(bad / len(left))
        best, most = None, 1e-9
        for feature, cuts in thresholds.items():
            for cut in cuts:
                above = [r["bad"] for r in left if r[feature] > cut]
                for side, p, n in ((True, sum(above), len(above)),
                                   (False, bad - sum(above), len(left) - len(above))):
                    if p and (gain := p * (math.log2(p / n) - base)) > most:
                        best, most = Condition(feature, side, cut), gain
        if best is None:
            return rule
        rule += (best,)
        left = [r for r in left if best.holds(r)]


def _prune(rule: Rule, rows) -> Rule:
    """The beginning of the rule that is worth most on examples it was not grown on."""
    def worth(k: int) -> float:
        bad, good = _counts(rows, rule[:k])
        return (bad - good) / max(bad + good, 1)
    return rule[:max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def _settle(rule: Rule, rows) -> Rule:
    """The rule with one condition a feature and side, each threshold half way to the
    next value that occurs, so that it doesn't hug the examples."""
    tightest: dict[tuple[str, bool], float] = {}
    for c in rule:
        known = tightest.get((c.feature, c.above), c.threshold)
        tightest[c.feature, c.above] = max(known, c.threshold) if c.above else min(known, c.threshold)
    out = []
    for (feature, above), cut in tightest.items():
        beyond = min((r[feature] for r in rows if r[feature] > cut), default=cut)
        out.append(Condition(feature, above, (cut + beyond) / 2))
    return tuple(out)


def learn(rows: Sequence, names: Sequence[str] = FEATURES, max_rules: int = 12,
          cuts: int = 24, precision: float = 0.8) -> list[Rule]:
    """Ordered rules for bad documents from rows with the features and ``bad`` (0 or 1)."""
    grow = [r for i, r in enumerate(rows) if i % 3 < 2]
    check = [r for i, r in enumerate(rows) if i % 3 == 2]
    rules: list[Rule] = []
    while len(rules) < max_rules and any(r["bad"] for r in grow):
        thresholds = {}
        for f in names:
            # half of the cuts where the bad examples lie, half where all do
            places = set()
            for part in (grow, [r for r in grow if r["bad"]]):
                v = sorted(r[f] for r in part)
                places |= {v[len(v) * k // (cuts // 2)] for k in range(cuts // 2)}
            thresholds[f] = sorted(places)
        rule = _settle(_prune(_grow(grow, thresholds), check), grow + check)
        bad, good = _counts(grow + check, rule) if rule else (0, 1)
        if not bad or bad < precision * (bad + good):
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        check = [r for r in check if not all(c.holds(r) for c in rule)]
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The decision list as one expression: true keeps a document."""
    out = F.lit(True)
    for rule in reversed(rules):
        covered = F.lit(True)
        for condition in rule:
            covered = covered & condition.column()
        out = F.when(covered, F.lit(False)).otherwise(out)
    return out


def examples(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES):
    """At most ``most`` labelled documents with their features and ``bad``.

    The fold kept for tests is left out. Only the sampled documents' texts are looked
    at; the ids that select them are at most ``most``, hence the broadcast.
    """
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()
                           & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    stats = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"),
                       ("doc_id", "quality"))
    rows = (features(stats).withColumn("bad", 1 - F.col("quality"))
            .select("doc_id", "bad", *FEATURES)
            .orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(most).collect())
    return [r.asDict() for r in rows]


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def judge(docs: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every document."""
    failed = base_failed()
    return (features(statistics(docs, keep)).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & verdict(rules))
            .select(*keep, *BASE, "base_failed", "kept"))
