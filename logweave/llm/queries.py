"""One registered query per operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import (
    bit_planes,
    decontaminate,
    jaccard_join,
    line_dedup,
    near_dedup,
    packing,
    paragraph_dedup,
    pii,
    quality_gam,
    quality_rules,
    spelling,
    toxicity,
    url_filter,
)
from logweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Held-out folds: crc32(doc_id as text) modulo the first number is the second.
TOXIC_FOLD, QUALITY_FOLD = (5, 0), (3, 1)
PSEUDONYM_KEY = "test tables"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(fold: tuple[int, int]):
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    return (crc % fold[0] == fold[1]).alias("held_out")


@query
def op1_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def toxic_lexicon(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    """Learned from the documents outside the held-out fold."""
    return toxicity.learn(toxicity.labelled_texts(docs, labels, "toxic", *TOXIC_FOLD, toxicity.LABELLED_ROWS))


@query
def op2_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lexicon = toxic_lexicon(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, lexicon).select("doc_id", held_out(TOXIC_FOLD), "score", "predicted")


@query
def op3_pii_pseudonyms(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise_documents(docs, PSEUDONYM_KEY)


@query
def op4_quality_gam(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labelled = toxicity.labelled_texts(docs, table(spark, folder, "labels"), "quality", *QUALITY_FOLD, quality_gam.FIT_ROWS)
    model = quality_gam.learn(labelled)
    return quality_gam.score(docs, model).select("doc_id", held_out(QUALITY_FOLD), "score", "predicted")


@query
def op5_bm25_packing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_file, with_ids=False).drop("ids")


@query
def op6_url_vocabulary(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "term_score")


@query
def op7_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels")
    # No row is held out here: modulo 1 is never 1.
    labelled = quality_rules.with_statistics(
        toxicity.labelled_texts(docs, labels, "quality", 1, 1, quality_rules.LABELLED_ROWS)
    )
    judged = quality_rules.judge(docs, quality_rules.learn(labelled))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


@query
def op8_lsh_forest(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, width=2)


@query
def op9_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.contained_items(docs, table(spark, folder, "benchmark"))


@query
def op10_paragraph_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cleaned = paragraph_dedup.dedup_paragraphs(docs)
    return cleaned.select(
        "doc_id", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


@query
def op11_spelling_variants(spark, folder):
    return spelling.variants(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op12_bit_plane_clusters(spark, folder):
    return bit_planes.cluster_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query
def op13_jaccard_join(spark, folder):
    return jaccard_join.jaccard_join(table(spark, folder, "documents").select("doc_id", "text"))
