"""Judging page addresses: host and path rules, else a weighted vocabulary matched by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import Batches, map_batches

# Strict terms reject by themselves, soft ones together with others.
STRICT_TERMS = ("adult", "casino", "spam", "porn", "xxx", "viagra", "escort", "malware", "phishing", "warez", "hentai", "torrent")
SOFT_TERMS = (
    "ads", "track", "tracker", "win", "farm", "pills", "bets", "bet", "cheap", "free", "bonus", "poker", "slots",
    "lottery", "dating", "sex", "nude", "hot", "loan", "loans", "payday", "crack", "keygen", "promo", "click", "hack",
)
# Weights: a strict term reaches the limit alone, soft terms when two different ones occur.
STRICT_WEIGHT, SOFT_WEIGHT, REJECT_AT = 2, 1, 2

# Fixed values: (host, path, verdict); a host stands for its subdomains too.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # From the shortest to the longest; the last that fits wins. Among equals the first of the list wins.
    for rule_host, rule_path, says in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for terms, weight in ((soft, SOFT_WEIGHT), (strict, STRICT_WEIGHT)):
        for term in terms:
            automaton.add_word(term, (term, weight))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def _score(automaton, url: str | None) -> int:
    """Sum of the weights of the distinct terms that stand in the address between characters that are no ASCII letters or digits."""
    if not url or not len(automaton):
        return 0
    text = url.encode().lower().decode()  # A-Z only
    word = "0123456789" + LOWER
    hits = {}
    for end, (term, weight) in automaton.iter(text):
        start = end - len(term)
        if (start < 0 or text[start] not in word) and (end + 1 == len(text) or text[end + 1] not in word):
            hits[term] = weight
    return sum(hits.values())


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``term_score`` (int) and ``verdict`` ('allow' or 'block').

    The longest of ``rules`` that fits host and path decides. Where none fits, the vocabulary does: an address is
    blocked when the weights of its distinct terms reach ``REJECT_AT``: one strict term, or two different soft ones. A
    term counts only between characters that are no ASCII letters or digits.

    Nulls and odd rows: a null url, or one without ``://``, has empty host and path; a null or empty url is allowed. Repeated rows
    are judged each. An empty table gives an empty result. Further columns are passed on; columns named like the added
    ones are replaced.
    """
    added = {"host", "path", "rule", "term_score", "verdict"} - {url.lower()}
    base = pages.drop(*[c for c in pages.columns if c.lower() in added])
    schema = T.StructType([*base.schema.fields, T.StructField("term_score", T.IntegerType())])
    place = base.columns.index(url)

    def run(batches: Batches) -> Batches:
        automaton = _automaton(strict, soft)
        for batch in batches:
            scores = pa.array([_score(automaton, u) for u in batch.column(place).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "term_score"])

    scored = map_batches(base, run, schema)
    located = scored.withColumn("host", F.coalesce(host_of(url), F.lit(""))).withColumn("path", F.coalesce(path_of(url), F.lit("")))
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("term_score") >= REJECT_AT, "block").otherwise("allow")
    return located.withColumn("rule", rule).withColumn("verdict", F.coalesce(says, method)).select(
        *[c for c in base.columns], "host", "path", "rule", "term_score", "verdict"
    )
