"""Window and template features.

Token work is done once per distinct template; windows receive it by lookup.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.columns import tokens
from logweave.operators.vocab import NUMBER, OOV_ID, PAD_ID, dealt_tokens, encode_tokens, numbered_templates, stored
from logweave.runtime import BROADCAST_BYTES, broadcast_if_small, discard, looked_up, materialize


def sequential(windows: DataFrame) -> DataFrame:
    """Template ids of each window, as the feature column."""
    return windows.withColumn("features", F.col("ids"))


def id_counts(ids: Column) -> Column:
    """``map(id, occurrences)`` of a window's ids: as long as the window, whatever the vocabulary."""
    return F.map_from_entries(F.transform(
        F.array_distinct(ids), lambda k: F.struct(k.alias("id"), F.size(F.filter(ids, lambda x: x == k)).alias("n"))
    ))


def quantitative(windows: DataFrame, vocab_size: int, dense: bool = True) -> DataFrame:
    """Template counts per window: places 1 .. vocab_size-1 (the padding id 0 has none), or a map with ``dense=False``.

    The counts are made from the few ids of the window; only the dense form is as long as the vocabulary.
    """
    counted = windows.withColumn("features", id_counts(F.col("ids")))
    if not dense:
        return counted
    places = F.sequence(F.lit(1), F.lit(vocab_size - 1))
    return counted.withColumn("features", F.transform(places, lambda k: F.coalesce(F.try_element_at("features", k), F.lit(0))))


_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


def sparse_vector(indices: Column, values: Column, size: int) -> Column:
    """A sparse ml vector from ascending ``indices`` (array of int) and ``values``, made inside the JVM."""
    parts = F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.cast("array<double>").alias("values")
    )
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), _VECTOR)["v"]


def count_features(windows: DataFrame, vocab_size: int, output: str = "features") -> DataFrame:
    """The same counts as a sparse ml vector: its size in a row is that of the window, and no task or driver holds
    the vocabulary."""
    found = F.filter(F.sort_array(F.array_distinct("ids")), lambda k: (k > 0) & (k < vocab_size))
    ids = F.col("ids")
    values = F.transform(found, lambda k: F.size(F.filter(ids, lambda x: x == k)))
    return windows.withColumn(output, sparse_vector(F.transform(found, lambda k: k - 1), values, vocab_size - 1))


def template_token_ids(
    templates: DataFrame, vocabulary: DataFrame, max_token_len: int | None = None, key: str | None = None
) -> DataFrame:
    """``template, token_ids``: all token ids; cut or filled with 0 to ``max_token_len`` when that is given.

    ``key`` names a number that ``templates``, each there once, already have; it then stands for the template in the result.
    A table made by ``numbered_templates`` is used as it is.
    """
    distinct = numbered_templates(templates) if key is None else templates.select(F.col(key).alias(NUMBER))
    numbered = distinct if key is None else templates.select("template", F.col(key).alias(NUMBER))
    words = dealt_tokens(numbered).select(NUMBER, F.posexplode_outer("tokens").alias("token_pos", "token")).where("token is not null")
    if max_token_len is not None:
        words = words.where(F.col("token_pos") < max_token_len)
    # Place and id in one number: a template's list holds no objects per token, and is sorted as numbers.
    placed = F.shiftleft(F.col("token_pos").cast("long"), 32).bitwiseOR(F.col("token_id").cast("long"))
    ids = (
        encode_tokens(words, vocabulary, [NUMBER]).groupBy(NUMBER)
        .agg(F.transform(F.sort_array(F.collect_list(placed)), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("_ids"))
    )
    # Templates without a single token are in no row of the token table.
    known = F.coalesce("_ids", F.array().cast("array<int>"))
    if max_token_len is not None:
        known = F.slice(F.concat(known, F.array_repeat(F.lit(PAD_ID), max_token_len)), 1, max_token_len)
    name = F.col("template") if key is None else F.col(NUMBER).alias(key)
    return distinct.join(ids, NUMBER, "left").select(name, known.alias("token_ids"))


def attach_template_features(lines: DataFrame, features: DataFrame, key: str = "template") -> DataFrame:
    """Look the template features up on the lines, before windows repeat each line."""
    return lines.join(broadcast_if_small(features), key, "left")


def idf(train_lines: DataFrame, lower_first: bool = False) -> DataFrame:
    """``token, df, idf, total`` over all training lines, repetitions included: ln((1+N)/(1+df)) + 1; stored.

    The lines are read once, to count them per template.
    """
    per_template = materialize(train_lines.groupBy("template").agg(F.count(F.lit(1)).alias("_lines")), "zstd")
    total = F.coalesce(per_template.agg(F.sum("_lines")).scalar(), F.lit(0))
    words = F.array_distinct(tokens(F.col("template"), lower_first))
    df = per_template.select("_lines", F.explode(words).alias("token")).groupBy("token").agg(F.sum("_lines").alias("df"))
    made = materialize(df.withColumn("idf", F.log((1 + total) / (1 + F.col("df"))) + 1).withColumn("total", total))
    discard(per_template)
    return made


def tfidf(
    templates: DataFrame, train_lines: DataFrame, vocabulary: DataFrame, lower_first: bool = False, name: str | Column = "template"
) -> DataFrame:
    """``template, token_id, weight`` with weights that sum to 1 per template (sparse rows).

    Tokens outside the vocabulary are left out. ``lower_first`` tokenizes the
    lower-cased text, as a lower-casing vectorizer does before calling its
    tokenizer: CamelCase words then stay whole and miss the vocabulary. ``name`` is what stands for the
    template in the rows, such as its digest: it is worked out once per template.
    """
    return tfidf_from_idf(templates, stored(idf(train_lines, lower_first)), vocabulary, lower_first, name)


def tfidf_from_idf(
    templates: DataFrame, fitted: DataFrame, vocabulary: DataFrame, lower_first: bool = False, name: str | Column = "template"
) -> DataFrame:
    """The same from a stored table made by ``idf``."""
    numbered = numbered_templates(templates)
    weights = numbered_tfidf(numbered, fitted, vocabulary, lower_first)
    named = numbered.select(NUMBER, (F.col(name) if isinstance(name, str) else name).alias("template"))
    return named.join(weights, NUMBER).select("template", "token_id", "weight")


def _term_rows(numbered: DataFrame, fitted: DataFrame, vocabulary: DataFrame, lower_first: bool) -> DataFrame:
    """``_t, token_id, tf, df, idf``, dealt by ``_t``: the tokens of the vocabulary in each template; ``df`` training lines have the token."""
    words = dealt_tokens(numbered, lower_first).select(NUMBER, F.explode_outer("tokens").alias("token"))
    tf = words.where("token is not null").groupBy(NUMBER, "token").agg(F.count(F.lit(1)).alias("tf"))
    total = F.coalesce(fitted.agg(F.max("total")).scalar(), F.lit(0))
    unseen = F.log((1 + total).cast("double")) + 1
    # Joined first, so that the words meet one table.
    known = vocabulary.select("token", "token_id").join(
        fitted.select("token", "idf", "df", F.col("df").alias("n")), "token", "left")
    found = looked_up(tf, materialize(known), "token", [NUMBER], "inner")
    return found.select(NUMBER, "token_id", "tf", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("idf", unseen).alias("idf"))


def numbered_tfidf(
    numbered: DataFrame, fitted: DataFrame, vocabulary: DataFrame, lower_first: bool = False
) -> DataFrame:
    """The same as ``_t, token_id, weight`` for ``numbered_templates``."""
    raw = _term_rows(numbered, fitted, vocabulary, lower_first).select(NUMBER, "token_id", (F.col("tf") * F.col("idf")).alias("raw"))
    # A template has few distinct tokens, so a window over them is a short one.
    norm = F.sum("raw").over(Window.partitionBy(NUMBER))
    return raw.select(NUMBER, "token_id", (F.col("raw") / norm).alias("weight"))


# Lines whose number fits beside a token's id.
PACKED_LINES = 1 << 31


def tfidf_dictionary(
    numbered: DataFrame, fitted: DataFrame, vocabulary: DataFrame, lower_first: bool = False
) -> DataFrame:
    """The same for ``window_tfidf``, one row per template: ``feature_id, total, norm, codes, times``.

    A code is the token's id and the number of its training lines, of which the weight is worked out where it is used: codes
    of one token are alike in all templates, so they are short when they are moved. Logs of 2^31 lines or more get
    ``feature_id, token_id, weight``.
    """
    total = fitted.agg(F.max("total")).first()[0] or 0
    if total >= PACKED_LINES:
        return numbered_tfidf(numbered, fitted, vocabulary, lower_first).withColumnRenamed(NUMBER, "feature_id")
    code = F.shiftleft(F.col("token_id").cast("long"), 32).bitwiseOR(F.col("df").cast("long"))
    packed = _term_rows(numbered, fitted, vocabulary, lower_first).groupBy(NUMBER).agg(
        F.sum(F.col("tf") * F.col("idf")).alias("norm"), F.collect_list(F.struct(code.alias("code"), F.col("tf").cast("int").alias("tf"))).alias("_c"))
    return packed.select(F.col(NUMBER).alias("feature_id"), F.lit(total).cast("long").alias("total"), "norm", F.col("_c.code").alias("codes"), F.col("_c.tf").alias("times"))


def window_tfidf(windows: DataFrame, dictionary: DataFrame, size: int) -> DataFrame:
    """``session_id, window_idx, token_id, weight``: the mean tf-idf row of each window's ``size`` lines, tokens with a weight only.

    ``windows`` carry ``feature_ids``, ``dictionary`` is ``feature_id, token_id, weight`` or made by ``tfidf_dictionary``. A template's row
    is multiplied by its lines in the window before it meets the others, so windows never hold copies of rows; filler counts as zeros.
    """
    counts = windows.select("session_id", "window_idx", F.explode(id_counts(F.col("feature_ids"))).alias("feature_id", "_n"))
    counts = counts.where("feature_id >= 0")
    if "codes" not in dictionary.columns:
        rows = counts.join(broadcast_if_small(dictionary), "feature_id").withColumn("weight", F.col("_n") * F.col("weight"))
    else:
        # Whole templates, stored with their windows, move there; the tokens are then laid out where they are.
        met = materialize(counts.join(dictionary, "feature_id").drop("feature_id"), "zstd")
        laid = met.repartition("session_id", "window_idx").select("session_id", "window_idx", "_n", "total", "norm", F.inline(F.arrays_zip("codes", "times")))
        lines = F.col("codes").bitwiseAND(F.lit((1 << 32) - 1))
        idf_ = F.log((1 + F.col("total")) / (1 + lines)) + 1
        rows = laid.select(
            "session_id", "window_idx", F.shiftright("codes", 32).cast("int").alias("token_id"),
            (F.col("_n") * (F.col("times") * idf_ / F.col("norm"))).alias("weight"))
    return rows.groupBy("session_id", "window_idx", "token_id").agg((F.sum("weight") / size).alias("weight"))


def dense_tfidf(weights: DataFrame, vocab_size: int) -> DataFrame:
    """One dense row of ``vocab_size`` weights per template."""
    pairs = weights.groupBy("template").agg(
        F.map_from_entries(F.collect_list(F.struct("token_id", "weight"))).alias("_w")
    )
    return pairs.select("template", F.transform(
        F.sequence(F.lit(0), F.lit(vocab_size - 1)), lambda i: F.coalesce(F.try_element_at("_w", i), F.lit(0.0))
    ).alias("features"))


def summed_embedding(templates: DataFrame, vocabulary: DataFrame, vectors: DataFrame, name: str | Column = "template") -> DataFrame:
    """``template, vec``: sum of the vectors of all tokens of a template; unknown ones count as such.

    A template without tokens gets the padding vector. ``name`` is what stands for the template in the rows, such as its digest.
    """
    numbered = numbered_templates(templates)
    words = numbered.select(NUMBER, tokens(F.col("template")).alias("_w")).select(NUMBER, F.explode_outer("_w").alias("token"))
    coded = encode_tokens(words, _telling_tokens(vocabulary, vectors))
    token_id = F.when(F.col("token").isNull(), F.lit(PAD_ID)).otherwise(F.col("token_id"))
    weights = coded.select(NUMBER, token_id.alias("token_id"), F.lit(1.0).alias("times"))
    named = numbered.select(NUMBER, (F.col(name) if isinstance(name, str) else name).alias("template"))
    return named.join(_weighted_sum(weights, vectors, "times", NUMBER), NUMBER).select("template", "vec")


def _telling_tokens(vocabulary: DataFrame, vectors: DataFrame) -> DataFrame:
    """The tokens whose vectors add something to a sum, where it makes no difference that the others are taken for unknown: all ids
    have vectors, and the unknown one's is zeros. Else the whole vocabulary."""
    low, high, ids, unknown = vectors.agg(
        F.min("token_id"), F.max("token_id"), F.count_distinct("token_id"),
        F.max(F.when(F.col("token_id") == OOV_ID, _counts().cast("int")))).first()
    top = vocabulary.agg(F.max("token_id")).first()[0] or OOV_ID
    if not ids or ids != high - low + 1 or low > PAD_ID or high < top or unknown:
        return vocabulary
    return materialize(vocabulary.join(vectors.where(_counts()).select("token_id"), "token_id", "left_semi"))


def token_counts(numbered: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """``key, token_id, times``: how often the tokens occur in each of the templates, which have a number ``key``. Unknown tokens count
    as such; a template without tokens has the padding once."""
    words = dealt_tokens(numbered.select("template", F.col(key).alias(NUMBER))).select(NUMBER, F.explode_outer("tokens").alias("token"))
    counted = words.groupBy(NUMBER, "token").agg(F.count(F.lit(1)).cast("double").alias("times"))
    token_id = F.when(F.col("token").isNull(), F.lit(PAD_ID)).otherwise(F.col("token_id"))
    return encode_tokens(counted, vocabulary).select(F.col(NUMBER).alias(key), token_id.alias("token_id"), "times")


def weighted_embedding(weights: DataFrame, vectors: DataFrame) -> DataFrame:
    """``template, vec``: tf-idf row times the vector table."""
    return _weighted_sum(weights, vectors, "weight", "template")


def _counts() -> Column:
    """Whether a vector adds anything to a sum."""
    return F.exists("vec", lambda x: (x != 0) | x.isNull())


def _weighted_sum(weights: DataFrame, vectors: DataFrame, weight: str, *key: str) -> DataFrame:
    """``key, vec``: for every key with a ``token_id`` of the vectors, the sum of its vectors times their weight."""
    # Vectors of zeros add nothing: all rows of a key that have one become one row, inside the task they are in.
    low, high, ids, dim = vectors.agg(F.min("token_id"), F.max("token_id"), F.count_distinct("token_id"), F.max(F.size("vec"))).first()
    if ids and ids == high - low + 1:
        present = weights.where(F.col("token_id").between(low, high))
    else:
        present = weights.join(broadcast_if_small(vectors.select("token_id").distinct()), "token_id", "left_semi")
    some = materialize(vectors.where(_counts()).select("token_id", "vec"))
    telling = some.select(F.col("token_id").alias("_id")).distinct()
    first, last, ids = telling.agg(F.min("_id"), F.max("_id"), F.count(F.lit(1))).first()
    if ids == (last or 0) - (first or 0) + 1:
        marked = present.withColumn("_id", F.when(F.col("token_id").between(first, last), F.col("token_id")))
    else:
        marked = present.join(broadcast_if_small(materialize(telling)), F.col("token_id") == F.col("_id"), "left")
    return _vector_sums(marked.groupBy(*key, "_id").agg(F.sum(weight).alias("_w")), some, dim or 0, *key)


def _vector_sums(weights: DataFrame, vectors: DataFrame, dim: int, *key: str) -> DataFrame:
    """``key, vec``: the sums of the stored ``vectors`` (``token_id, vec``) that the keys have by ``_id`` times ``_w``, zeros for keys without any."""
    table = vectors.select(F.col("token_id").alias("_id"), F.col("vec").alias("_v"))
    if (40 + 8 * dim) * table.count() <= BROADCAST_BYTES:
        found = weights.repartition(*key).join(F.broadcast(table), "_id", "left")
    else:
        weights = materialize(weights)
        uses = weights.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
        found = looked_up(weights.repartition(*key), materialize(table.join(uses, "_id")), "_id", list(key))
    parts = [F.sum(F.get("_v", F.lit(i)) * F.col("_w")).alias(f"_s{i}") for i in range(dim)]
    summed = found.groupBy(*key).agg(*parts, F.count(F.lit(1)).alias("_n"))
    return summed.select(*key, F.array(*[F.coalesce(f"_s{i}", F.lit(0.0)) for i in range(dim)]).cast("array<double>").alias("vec"))


# Numbers of a table of vectors that every task may hold; longer tables are joined.
HELD_NUMBERS = 1 << 20


def _held(vectors: DataFrame, key: str, dim: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The ids of a short table of vectors, ascending, and their rows with one of zeros behind them; None for a long or incomplete table."""
    odd = F.col("vec").isNull() | (F.size("vec") != dim) | F.exists("vec", lambda x: x.isNull())
    rows, left_out = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(odd.cast("int")), F.lit(0))).first()
    if rows * dim > HELD_NUMBERS or left_out:
        return None
    found = vectors.where(F.col(key).isNotNull()).select(key, "vec").collect()
    ids, place = np.unique(np.array([r[0] for r in found], np.int64), return_inverse=True)
    table = np.zeros((len(ids) + 1, dim))
    np.add.at(table, place, np.array([r[1] for r in found], float).reshape(len(found), dim))
    return ids, table


def _pooled_in_place(windows: DataFrame, ids: np.ndarray, table: np.ndarray, size: int, output: str) -> DataFrame:
    """``mean_pooled`` with the vectors in the tasks: windows are neither exploded nor moved."""
    dim = table.shape[1]
    kept = windows.drop(output)
    names = kept.columns

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            lists, taken = batch.column(names.index("ids")), batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            start = lists.offsets.to_numpy()[:n].astype(np.int64)
            some = np.minimum(np.diff(lists.offsets.to_numpy()), taken)
            flat = lists.values.fill_null(-1).to_numpy()
            at = np.searchsorted(ids, flat)
            known = at < len(ids)
            known[known] = ids[at[known]] == flat[known]
            at[~known] = len(ids)
            total = np.zeros((n, dim))
            for k in range(int(some.max(initial=0))):
                rows = np.flatnonzero(some > k)
                total[rows] += table[at[start[rows] + k]]
            mean = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array((total / size).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, mean], names=[*names, output])

    schema = T.StructType([*kept.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))])
    return kept.mapInArrow(run, schema)


def mean_pooled(
    windows: DataFrame, vectors: DataFrame, size: int, dim: int, pad_id: int, key: str = "template_id", output: str = "features"
) -> DataFrame:
    """Average of the line vectors of each window (``session_id, window_idx, ids``) of ``size`` lines.

    ``vectors`` is ``key, vec``. Lines without a vector, and the filler ``pad_id`` behind the window's ``length`` lines, count as zeros. Ids are
    counted per window before they meet the vectors, so a window never holds copies of vectors. A short table of vectors is held by
    the tasks, which add up in place.
    """
    held = _held(vectors, key, dim) if dim else None
    if held is not None:
        return _pooled_in_place(windows, *held, size, output)
    real = F.slice("ids", F.lit(1), F.col("length"))
    counts = windows.select("session_id", "window_idx", F.explode(id_counts(real)).alias("_id", "_n"))
    table = broadcast_if_small(vectors.select(F.col(key).alias("_id"), array_to_vector("vec").alias("_v")))
    summed = counts.join(table, "_id").groupBy("session_id", "window_idx").agg(
        vector_to_array(Summarizer.sum(F.col("_v"), F.col("_n").cast("double"))).alias("_sum")
    )
    mean = F.transform(F.coalesce("_sum", F.array_repeat(F.lit(0.0), dim)), lambda x: x / size)
    return windows.join(summed, ["session_id", "window_idx"], "left").withColumn(output, mean).drop("_sum")


def pooled_tokens(
    windows: DataFrame, counts: DataFrame, vectors: DataFrame, size: int, dim: int, key: str = "template_id", output: str = "features"
) -> DataFrame:
    """What ``mean_pooled`` gives for the summed embeddings of the templates, without a vector per template.

    ``counts`` is made by ``token_counts``, ``vectors`` is ``token_id, vec``. Windows collect numbers of tokens, whose vectors are
    added up where the window is, so that vectors are neither stored nor moved per template or line.
    """
    some = materialize(vectors.where(_counts()).select("token_id", "vec"))
    telling = materialize(counts.join(broadcast_if_small(some.select("token_id")), "token_id", "left_semi"))
    real = F.slice("ids", F.lit(1), F.col("length"))
    lines = windows.select("session_id", "window_idx", F.explode(id_counts(real)).alias(key, "_n"))
    weights = lines.join(broadcast_if_small(telling), key).select(
        "session_id", "window_idx", F.col("token_id").alias("_id"), (F.col("_n") * F.col("times")).alias("_w"))
    summed = _vector_sums(weights, some, some.agg(F.max(F.size("vec"))).first()[0] or 0, "session_id", "window_idx")
    mean = F.transform(F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)), lambda x: x / size)
    return windows.join(summed, ["session_id", "window_idx"], "left").withColumn(output, mean).drop("vec")
