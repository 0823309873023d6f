"""Template and token vocabularies, and lookups against them.

A vocabulary is a table ``template, template_id`` or ``token, token_id, n``. Ids 0 and 1
are reserved for padding and unknown entries; real ids start at 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.columns import tokens
from logweave.operators.ordering import PART_ROWS, running
from logweave.runtime import broadcast_if_small, discard, looked_up, materialize

# Reserved vocabulary entries and the window filler.
TEMPLATE_PAD, TEMPLATE_OOV = "<pad>", "<oov>"
TOKEN_PAD, TOKEN_OOV = "PADDING", "OOV"
WINDOW_PADDING = "PADDING"
PAD_ID, OOV_ID, FIRST_ID = 0, 1, 2


def first_seen_ids(
    lines: DataFrame, input_col: str, output_col: str = "ID", order: str = "line_id",
    mapping: DataFrame | None = None, part_rows: int = PART_ROWS, start_id: int = 1,
) -> DataFrame:
    """Map each value to an id by the first line it appears on, counting from ``start_id``; stored.

    With a prior ``mapping`` (``input_col, output_col``) known values keep their id
    and new ones continue after its largest id.
    """
    firsts = lines.groupBy(input_col).agg(F.min(F.col(order).cast("long")).alias("_first"))
    start = F.lit(start_id - 1)
    if mapping is not None:
        firsts = firsts.join(mapping, input_col, "left_anti")
        start = F.coalesce(mapping.agg(F.max(output_col)).scalar(), start)
    # As long as the dictionary, not the log; stored, because ranking reads it more than once.
    firsts = materialize(firsts, "zstd")
    new = running(firsts, [], ["_first", input_col], {"_rn": ("row_number", None)}, part_rows=part_rows)
    ids = materialize(new.select(input_col, (F.col("_rn") + start).cast("int").alias(output_col)), "zstd")
    discard(firsts)
    return ids if mapping is None else mapping.select(input_col, output_col).unionByName(ids)


def template_vocabulary(lines: DataFrame, order: str = "line_id", part_rows: int = PART_ROWS) -> DataFrame:
    """Distinct templates in first-seen order with ids from 2."""
    return first_seen_ids(lines, "template", "template_id", order, part_rows=part_rows, start_id=FIRST_ID)


def encode_templates(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add ``template_id``; templates outside the vocabulary get 1."""
    joined = lines.join(broadcast_if_small(vocabulary), "template", "left")
    return joined.withColumn("template_id", F.coalesce("template_id", F.lit(OOV_ID)))


def new_templates(test: DataFrame, train: DataFrame) -> DataFrame:
    """Templates of the test lines that the training lines do not have."""
    return test.select("template").distinct().join(train.select("template").distinct(), "template", "left_anti")


def token_vocabulary(
    templates: DataFrame, min_token_count: int = 1, part_rows: int = PART_ROWS
) -> DataFrame:
    """Token counts over the *distinct* templates; kept tokens in alphabetical order, ids from 2.

    A table made by ``numbered_templates`` is read as it is: each template is there once.
    """
    once = templates if NUMBER in templates.columns else templates.select("template").distinct()
    # Outer: for a plain explode Spark would cut every line into tokens a second time, to drop lines without any before the distinct.
    words = once.select(F.explode_outer(tokens(F.col("template"))).alias("token"))
    counts = words.where("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_token_count)
    # Tokens are ASCII letters: their leading bytes, read as a number, follow the alphabet.
    leading = F.conv(F.rpad(F.hex(F.substring("token", 1, 7)), 14, "0"), 16, 10).cast("long")
    ranked = running(materialize(counts), [], ["token"], {"_rn": ("row_number", None)}, split_on=leading, part_rows=part_rows)
    return ranked.select("token", (F.col("_rn") + (FIRST_ID - 1)).cast("int").alias("token_id"), "n")


def with_reserved_tokens(vocabulary: DataFrame) -> DataFrame:
    """The token vocabulary including its two reserved entries."""
    reserved = vocabulary.sparkSession.createDataFrame(
        [(TOKEN_PAD, PAD_ID, 0), (TOKEN_OOV, OOV_ID, 0)], "token string, token_id int, n long"
    )
    return reserved.unionByName(vocabulary.select("token", "token_id", "n"))


def distinct_templates(lines: DataFrame) -> DataFrame:
    """The templates of the lines, stored: token work starts from this short table."""
    return materialize(lines.select("template").distinct())


# A short number in place of a template: rows per token never carry the line they come from.
NUMBER = "_t"


def numbered_templates(lines: DataFrame) -> DataFrame:
    """``template, _t``: the templates of the lines with a number each; stored, so that the numbers stay. A table made by this
    function is used as it is."""
    if NUMBER in lines.columns:
        return lines
    return materialize(lines.select("template").distinct().withColumn(NUMBER, F.monotonically_increasing_id()), "zstd")


def dealt_tokens(numbered: DataFrame, lower_first: bool = False) -> DataFrame:
    """``_t, tokens`` of templates with a number, dealt by it: what is grouped by template afterwards stays in its task."""
    return numbered.repartition(NUMBER).select(NUMBER, tokens(F.col("template"), lower_first).alias("tokens"))


def template_tokens(templates: DataFrame, lower_first: bool = False, name: str | Column = "template") -> DataFrame:
    """One row per template and token position (from 1). ``name`` is what stands for the template in the rows, such as its digest: it
    is worked out once per template."""
    named = F.col(name) if isinstance(name, str) else name
    lists = templates.select("template").distinct().select(named.alias("template"), tokens(F.col("template"), lower_first).alias("_w"))
    return lists.select("template", F.posexplode("_w").alias("_p", "token")).select("template", (F.col("_p") + 1).alias("token_pos"), "token")


def encode_tokens(words: DataFrame, vocabulary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add ``token_id``; tokens outside the vocabulary get 1.

    Of a vocabulary too long to be broadcast (stored, with ``n``) only the rarer tokens move the words they occur in. ``by`` are
    columns that the words are dealt by and stay dealt by.
    """
    if "n" in vocabulary.columns:
        found = looked_up(words, vocabulary.select("token", "token_id", "n"), "token", by)
    else:
        found = words.join(broadcast_if_small(vocabulary.select("token", "token_id")), "token", "left")
    return found.withColumn("token_id", F.coalesce("token_id", F.lit(OOV_ID)))


def vocabulary_vectors(vocabulary: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """A vector for every vocabulary entry (reserved ones included), zeros where none is given."""
    entries = with_reserved_tokens(vocabulary).select("token", "token_id")
    # The vectors are few next to the entries: stored, they can be measured, and the entries stay where they are.
    given = broadcast_if_small(materialize(vectors.select("token", "vec")))
    joined = entries.join(given, "token", "left")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return joined.select(
        "token", "token_id", F.coalesce("vec", zeros).alias("vec"), F.col("vec").isNotNull().cast("int").alias("has_vec")
    )


def vector_coverage(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count(F.lit(1)).alias("entries"), F.sum("has_vec").alias("with_vector"),
        F.avg(F.col("has_vec").cast("double")).alias("coverage"),
    )


def metadata(
    label_type: str, feature_type: str, template_vocab: DataFrame, token_vocab: DataFrame | None = None
) -> DataFrame:
    """One row: number of classes to predict, and size of the input vocabulary (both with reserved ids)."""
    if label_type not in ("next_log", "anomaly", "none"):
        raise ValueError(f"unknown label type {label_type!r}")
    if feature_type not in ("sequentials", "semantics", "quantitatives"):
        raise ValueError(f"unknown feature type {feature_type!r}")
    size = template_vocab.agg((F.count(F.lit(1)) + FIRST_ID).alias("templates"))
    tokens_size = F.col("templates")
    if feature_type == "semantics":
        tokens_size = token_vocab.agg(F.count(F.lit(1)) + FIRST_ID).scalar()
    labels = {"next_log": F.col("templates"), "anomaly": F.lit(2), "none": F.lit(None)}[label_type]
    return size.select(labels.cast("long").alias("num_labels"), tokens_size.cast("long").alias("vocab_size"))


def stored(vocabulary: DataFrame) -> DataFrame:
    """Keep a fitted vocabulary as a stored table, so that later lookups do not refit it."""
    return vocabulary if getattr(vocabulary, "stored_path", None) else materialize(vocabulary)
