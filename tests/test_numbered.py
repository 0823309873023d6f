"""Templates are numbered once for their vocabulary and their token ids."""

from logweave.operators import features, vocab


def test_numbered_templates_serve_vocabulary_and_ids(spark):
    texts = ["open the file", "the file the", None, "123", "open the file", "zz"]
    lines = spark.createDataFrame([(t,) for t in texts], "template string")
    numbered = vocab.numbered_templates(lines)
    counted = vocab.token_vocabulary(numbered, 2)
    assert counted.sort("token").collect() == vocab.token_vocabulary(lines, 2).sort("token").collect()
    assert counted._jdf.queryExecution().executedPlan().toString().count("template") == 0
    words = vocab.stored(counted)
    ids = {r.template: list(r.token_ids) for r in features.template_token_ids(numbered, words).collect()}
    assert ids == {"open the file": [1, 3, 2], "the file the": [3, 2, 3], None: [], "123": [], "zz": [1]}
    plan = features.template_token_ids(numbered, words)._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(token_pos" not in plan and "sort_array(_gen" not in plan
