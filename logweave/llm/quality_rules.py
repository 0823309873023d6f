"""Quality rules: statistics of a text as Spark columns, and a learned decision list over them.

Rules are conjunctions of thresholds that say 'reject'. Sequential covering learns them: a rule grows by the
condition that gains most on one part of the labelled texts, is pruned on the other part, and its texts leave the
table before the next one grows. The result is an ordered chain of ``CASE WHEN`` conditions. Statistics, learning and verdicts
are DataFrame operations throughout; the driver sees counts per feature and bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import discard, store

# Bound of the learning step: labelled texts; a larger table is sampled by a hash down to about so many.
LABELLED_ROWS = 100_000
MAX_RULES, MAX_CONDITIONS, BINS = 8, 3, 24
# A rule has to be right this often on the texts it was not grown on, and by Laplace's estimate still almost as often.
LEAST_PRECISION, LEAST_SURE = 0.9, 0.75

SYMBOLS = "#*$%&|<>"
WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "words", "word_length", "symbols_per_word", "repeat_share", "dup_line_share", "upper_share", "bangs_per_word",
    "distinct_share", "short_share", "words_per_line", "digits_per_word",
]


def _replaced(text: Column, chars: str, by: str) -> Column:
    """Each of a few characters replaced; a search for one character is much cheaper than a translation table."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _count(text: Column, pattern: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``COUNTS`` (long) and ``FEATURES`` (double, columns named ``f_...``).

    Words are runs without blanks (``[\\x20\\x09-\\x0D]``). ``n_repeat_words`` counts the words that lie in an 8-word window
    whose words occur as a window again in the same text. Windows are compared by a 64-bit hash of their words' hashes.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    blanks = "\t\n\x0b\x0c\r"
    # Each step's arrays are columns that the next step reads, so nothing is worked out twice.
    a = docs.withColumn("_spaced", _replaced(t, blanks, " "))
    a = a.withColumn("_words", F.filter(F.split("_spaced", " "), lambda w: w != ""))
    a = a.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    a = a.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    # Hashes of runs of 2, 4 and 8 words, each from two of the half length.
    pair = lambda x, y: F.xxhash64(x, y)
    a = a.withColumn("_windows", F.when(n >= WINDOW, F.col("_hashes")))
    for half in (1, 2, 4):
        left = F.size("_windows") - half
        a = a.withColumn("_windows", F.zip_with(F.slice("_windows", F.lit(1), left), F.slice("_windows", F.lit(half + 1), left), pair))
    a = a.withColumn("_again", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    # Only texts with a window that returns sort theirs.
    pairs = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    a = a.withColumn("_sorted", F.when(F.col("_again"), F.array_sort(pairs)))
    at = lambda j: F.get(F.col("_sorted"), j)
    same = lambda j: (at(j)["h"] == at(j - 1)["h"]) | F.coalesce(at(j)["h"] == at(j + 1)["h"], F.lit(False))
    found = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda j: F.when(
            F.when(j == 0, at(j)["h"] == at(j + 1)["h"]).otherwise(same(j)), at(j)["i"])),
        lambda i: i.isNotNull(),
    )
    a = a.withColumn("_found", F.when(F.col("_again"), F.sort_array(found)))
    gaps = F.transform(
        F.sequence(F.lit(1), F.size("_found") - 1),
        lambda k: F.least(F.lit(WINDOW), F.get(F.col("_found"), k) - F.get(F.col("_found"), k - 1)),
    )
    repeat = F.when(F.col("_again"), WINDOW + F.aggregate(gaps, F.lit(0), lambda s, x: s + x)).otherwise(0)
    a = a.withColumns({
        "n_words": n.cast("long"), "word_chars": F.length(F.replace("_spaced", F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": (F.length(t) - F.length(_replaced(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeat.cast("long"),
    })
    words = F.greatest(F.col("n_words"), F.lit(1))
    shares = {
        "f_words": F.col("n_words").cast("double"),
        "f_word_length": F.col("word_chars") / words,
        "f_symbols_per_word": F.col("n_symbols") / words,
        "f_repeat_share": F.col("n_repeat_words") / words,
        "f_dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)),
        "f_upper_share": _count(t, "[A-Z]+") / F.greatest(F.col("word_chars"), F.lit(1)),
        "f_bangs_per_word": (F.length(t) - F.length(_replaced(t, "!", ""))) / words,
        "f_distinct_share": F.size(F.array_distinct("_hashes")) / words,
        "f_short_share": F.size(F.filter("_words", lambda w: F.length(w) <= 3)) / words,
        "f_words_per_line": F.col("n_words") / F.greatest(F.size("_lines"), F.lit(1)),
        "f_digits_per_word": _count(t, "[0-9]+") / words,
    }
    # A generator, so that a later filter on a statistic is not rewritten into one on these nested expressions.
    found = F.struct(*COUNTS, *[value.alias(name) for name, value in shares.items()])
    return a.select(*docs.columns, F.inline(F.array(found)))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"f_{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def _bin(value: Column, cut: list[float]) -> Column:
    """How many edges lie below a value."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in cut]), lambda e: e < value))


def _bins(edges: dict[str, list[float]]) -> Column:
    """``(feature, bin)`` of a row for every feature."""
    return F.explode(F.array(*[
        F.struct(F.lit(name).alias("feature"), _bin(F.col(f"f_{name}"), cut).alias("bin")) for name, cut in edges.items()
    ])).alias("at")


def _best(rows: DataFrame, edges: dict[str, list[float]]) -> tuple[Condition | None, int, int]:
    """The condition with the largest gain on ``rows``, and how many bad and good rows it leaves."""
    table: dict[tuple[str, int], tuple[int, int]] = {}
    counted = rows.select(_bins(edges), "bad").groupBy("at.feature", "at.bin").agg(
        F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    for r in counted.collect():
        table[r["feature"], r["bin"]] = (r["bad"], r["n"] - r["bad"])
    name = next(iter(edges))
    bad = sum(v[0] for (f, _), v in table.items() if f == name)
    good = sum(v[1] for (f, _), v in table.items() if f == name)
    if not bad:
        return None, 0, good
    before = math.log2(bad / (bad + good))
    best: tuple = (1e-9, None, bad, good)
    for name, cut in edges.items():
        below_bad = below_good = 0
        for k, edge in enumerate(cut):
            x, y = table.get((name, k), (0, 0))
            below_bad, below_good = below_bad + x, below_good + y
            for above, p, n in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                if p:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > best[0]:
                        best = (gain, Condition(name, above, edge), p, n)
    return best[1], best[2], best[3]


def learn(labelled: DataFrame, rows: int = LABELLED_ROWS) -> list[Rule]:
    """An ordered list of rules that reject, from ``f_...`` features and ``label`` (1 good, 0 bad).

    Two thirds of the rows, by a hash of their features, grow the rules, the others prune them. Without bad or
    without good rows the list is empty.
    """
    names = [f"f_{f}" for f in FEATURES]
    where = F.xxhash64(*names)
    found = store(labelled.where("label in (0, 1)").select(*names, (F.col("label") == 0).cast("int").alias("bad")))
    total, table = found.count(), found
    if total > rows:
        table = table.where(F.pmod(F.xxhash64(where), F.lit(1_000_000)) < int(1_000_000 * rows / total))
    table = table.withColumn("prune", F.pmod(where, F.lit(3)) == 0)
    # Thresholds between the values at even shares of all rows and of the bad rows.
    shares = [k / BINS for k in range(1, BINS)]
    both = [*table.approxQuantile(names, shares, 1e-3), *table.where("bad = 1").approxQuantile(names, shares, 1e-3)]
    edges = {f: sorted({float(v) for v in [*both[k], *both[k + len(names)]]}) for k, f in enumerate(FEATURES)} if all(both) else {}
    edges = {f: cut for f, cut in edges.items() if len(cut) > 1}
    rules: list[Rule] = []
    rest = table
    while edges and len(rules) < MAX_RULES:
        rule: Rule = ()
        covered = rest.where("not prune")
        while len(rule) < MAX_CONDITIONS:
            condition, bad, good = _best(covered, edges)
            if condition is None:
                break
            rule, covered = (*rule, condition), covered.where(condition.column())
            if not good:
                break
        rule = _pruned(rest.where("prune"), rule)
        if not rule:
            break
        rule = _centred(rest, rule)
        rules.append(rule)
        rest = rest.where(~_holds(rule))
    discard(found)
    return rules


def _pruned(rows: DataFrame, rule: Rule) -> Rule:
    """The beginning of a rule that does best on other rows; empty where none is right often enough."""
    if not rule:
        return ()
    counted = rows.agg(*[
        F.sum(F.when(_holds(rule[: k + 1]), c)).alias(f"{name}{k}")
        for k in range(len(rule)) for name, c in (("bad", F.col("bad")), ("all", F.lit(1)))
    ]).first()
    best: tuple = (0.0, ())
    for k in range(len(rule)):
        bad, found = counted[f"bad{k}"] or 0, counted[f"all{k}"] or 0
        if found and bad / found >= LEAST_PRECISION and (bad + 1) / (found + 2) >= LEAST_SURE:
            best = max(best, ((2 * bad - found) / found * math.log1p(found), rule[: k + 1]), key=lambda x: x[0])
    return best[1]


def _centred(rows: DataFrame, rule: Rule) -> Rule:
    """The rule with every threshold moved half the way to the bad rows it covers, all of which it keeps."""
    near = rows.where(_holds(rule) & (F.col("bad") == 1)).agg(*[
        (F.min if c.above else F.max)(f"f_{c.feature}").alias(f"c{k}") for k, c in enumerate(rule)
    ]).first()
    return tuple(Condition(c.feature, c.above, (c.threshold + near[f"c{k}"]) / 2) for k, c in enumerate(rule))


def rejected_by(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that holds; null where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(_holds(rule), k) if out is None else out.when(_holds(rule), k)
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, rules: list[Rule], base: Column | None = None) -> DataFrame:
    """``docs`` with statistics, ``base_failed``, ``rule`` (int, null: none) and ``kept``.

    ``base`` (default: under 20 words, or more than 30 % of them in repeated windows) rejects before the rules do.

    A null or empty text has no words and fails the base rule. Repeated rows are judged each; an empty table stays empty.
    Further columns are passed on; columns named like the added ones are replaced.
    """
    added = {*COUNTS, *[f"f_{f}" for f in FEATURES], "base_failed", "rule", "kept"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")) if base is None else base
    found = with_statistics(docs).withColumns({"base_failed": failed, "rule": rejected_by(rules)})
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
