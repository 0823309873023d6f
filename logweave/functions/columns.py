"""Column expressions used by the normalisers. All of them run inside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity pattern, label words, and timestamp layouts of the supported log families.
ENTITY_PATTERN = r"(blk_-?\d+)"
ANOMALY_WORD = "Anomaly"
NORMAL_ALERT = "-"
COMPACT_FORMAT = "ddMMyyHHmmss"
MICROSECOND_FORMAT = "yyyy-MM-dd-HH.mm.ss.SSSSSS"
DOTTED_FORMAT = "yyyy.MM.dd-HH:mm:ss"
TOKEN_PATTERN = "[A-Z][a-z]+|[a-z]+(?:[A-Z]+(?![a-z]))?|[A-Z]+(?![a-z])"


def compact_timestamp(date: Column, time: Column, pattern: str = COMPACT_FORMAT) -> Column:
    """Six-digit date and time, zero-padded on the left (numbers lose leading zeros)."""
    digits = F.concat(
        F.lpad(date.cast("string"), 6, "0"), F.lpad(time.cast("string"), 6, "0")
    )
    return F.to_timestamp(digits, pattern)


def microsecond_timestamp(time: Column) -> Column:
    return F.to_timestamp(time, MICROSECOND_FORMAT)


def dotted_timestamp(date: Column, time: Column) -> Column:
    return F.to_timestamp(F.concat_ws("-", date, time), DOTTED_FORMAT)


def alert_label(label: Column) -> Column:
    return (label != NORMAL_ALERT).cast("int")


def anomaly_label(label: Column) -> Column:
    return (label == ANOMALY_WORD).cast("int")


def entity_ids(content: Column, pattern: str = ENTITY_PATTERN) -> Column:
    """Distinct entity ids named in a line."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)))


def tokens(text: Column, lower_first: bool = False) -> Column:
    """Letter runs, split at CamelCase words, lower-cased.

    ``lower_first`` lower-cases the text before splitting, so that no CamelCase
    word is left to split; see ``tfidf`` for why that form exists.
    """
    source = F.lower(text) if lower_first else text
    # One pass: a capital with the small letters after it, or letters up to the next such capital.
    return F.transform(F.regexp_extract_all(source, F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)


def hash_unit(seed: int, key: Column) -> Column:
    """Repeatable pseudo-random number in [0, 1) for a key."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(2**32))


def hash_order(seed: int, key: Column) -> Column:
    """Repeatable shuffle order: sort by this text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_prefix(digest: Column) -> Column:
    """Leading 60 bits of a hex digest: an integer that follows the digest's order."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
