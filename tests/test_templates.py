"""Token features by template number: no row per token carries its line."""

from pyspark.sql import functions as F

from logweave.operators import features, vocab


def _lines(spark):
    texts = ["Open file open", "close FileHandle", "Open file open", None, "123", "Open socket"]
    return spark.createDataFrame([(t,) for t in texts], "template string")


def test_tfidf_by_digest(spark):
    lines = _lines(spark)
    vocabulary = vocab.stored(vocab.token_vocabulary(lines))
    plain = features.tfidf(lines, lines, vocabulary)
    short = features.tfidf(lines, lines, vocabulary, name=F.md5("template"))
    rows = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    assert rows(short) == rows(plain.withColumn("template", F.md5("template")))
    assert {r["template"] for r in plain.collect()} == {"Open file open", "close FileHandle", "Open socket"}


def test_rows_per_token_do_not_carry_the_line(spark):
    lines = _lines(spark)
    vocabulary = vocab.stored(vocab.token_vocabulary(lines))
    numbered = vocab.numbered_templates(lines)
    made = features.numbered_tfidf(numbered, vocab.stored(features.idf(lines)), vocabulary)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert made.columns == [vocab.NUMBER, "token_id", "weight"]
    assert not any("template" in line for line in plan.splitlines() if "Aggregate" in line or "Window" in line)


def test_summed_vectors_of_odd_templates(spark):
    lines = _lines(spark)
    vocabulary = vocab.stored(vocab.token_vocabulary(lines))
    given = spark.createDataFrame([("open", [1.0, 2.0]), ("file", [0.5, 0.0])], "token string, vec array<double>")
    table = vocab.stored(vocab.vocabulary_vectors(vocabulary, given, 2))
    made = {r["template"]: list(r["vec"]) for r in features.summed_embedding(lines, vocabulary, table).collect()}
    assert made == {"Open file open": [2.5, 4.0], "close FileHandle": [0.5, 0.0], None: [0.0, 0.0], "123": [0.0, 0.0], "Open socket": [1.0, 2.0]}
