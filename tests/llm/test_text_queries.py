"""The registered text queries against their SQL, or against plain Python where SQL cannot express them."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

import plain
from compare import DATA, connect, difference
from logweave.llm.oracle import ORACLE
from logweave.llm.queries import QUERIES, tokenizer_file

FOLDER = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def texts():
    return dict(connect(FOLDER).sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", list(ORACLE))
def test_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, str(FOLDER)), connect(FOLDER), ORACLE[name]) is None


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name,label", [("op2_toxicity", "toxic"), ("op4_quality_gam", "quality")])
def test_scores(spark, texts, name, label):
    rows = QUERIES[name](spark, str(FOLDER)).collect()
    modulus, held = (5, 0) if label == "toxic" else (3, 1)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = dict(connect(FOLDER).sql(f"SELECT doc_id, {label} FROM labels").fetchall())
    right = [r.predicted == known[r.doc_id] for r in rows if r.doc_id in known and r.held_out]
    assert np.mean(right) > 0.8


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_file())
    rows = QUERIES["op5_bm25_packing"](spark, str(FOLDER)).collect()
    plain.check_packing(rows, {d: [*tool.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()})


def test_rule_statistics(spark, texts):
    for r in QUERIES["op7_quality_rules"](spark, str(FOLDER)).collect():
        expected = plain.statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        failed = expected[0] < 20 or 100 * expected[4] > 30 * expected[0]
        assert r.base_failed == failed and r.kept == (not failed and r.rule is None)


def test_pseudonyms_can_be_undone(spark, texts):
    from logweave.llm import pii
    from logweave.llm.queries import PSEUDONYM_KEY

    made = QUERIES["op3_pii_pseudonyms"](spark, str(FOLDER))
    back = pii.pseudonymise_documents(made.select("doc_id", "text"), PSEUDONYM_KEY, back=True)
    assert {r.doc_id: r.text for r in back.collect()} == texts


@pytest.mark.parametrize("pattern", [
    r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", r"\+\d[\d ().-]{6,}\d", r"\(?\b\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b",
    r"\b\d{1,2}([./-])\d{1,2}\1\d{4}\b", r"\b\d{4}-\d{1,2}-\d{1,2}\b", r"\b\d{3}-\d{2}-\d{4}\b",
])
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_no_value_stays_in_clear(spark, pattern, scale):
    """Values of a format, found by a pattern of the test's own, are all replaced."""
    import re

    folder = DATA / scale
    if not folder.exists():
        pytest.skip("test tables are not here")
    find = lambda text: [m[0] for m in re.finditer(pattern, text or "")]
    before = {d: found for d, t in connect(folder).sql("SELECT doc_id, text FROM documents").fetchall() if (found := find(t))}
    made = QUERIES["op3_pii_pseudonyms"](spark, str(folder)).select("doc_id", "text")
    after = {r.doc_id: r.text for r in made.collect() if r.doc_id in before}
    assert not [v for d, found in before.items() for v in found if v in find(after[d])]


def test_pipeline_stages(spark, texts):
    """Every stage's decision against plain Python on what the stage before it kept."""
    import corpus_pipeline
    from logweave.llm.common import store, table

    docs = table(spark, str(FOLDER), "documents")
    items = dict(connect(FOLDER).sql("SELECT item_id, text FROM benchmark").fetchall())
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        made = store(stage(spark, docs, str(FOLDER)))
        if name == "packing":
            from tokenizers import Tokenizer

            tool = Tokenizer.from_file(tokenizer_file())
            plain.check_packing(made.collect(), {d: [*tool.encode(t or "", add_special_tokens=False).ids, 2] for d, t in before.items()})
            break
        assert made.columns == docs.columns
        after = {r.doc_id: r.text for r in made.collect()}
        if name == "toxicity":
            assert set(after) <= set(before) and all(before[d] == t for d, t in after.items())
        elif name == "line_dedup":
            assert after == {d: t for d, (t, _, _) in plain.dedup_lines(before).items()}
        elif name == "near_dedup":
            classes = plain.near_duplicates(before, 2)
            assert set(after) == {d for d, c in classes.items() if d == c}
        elif name == "decontaminate":
            assert set(after) == set(before) - {d for d, _ in plain.contained(before, items)}
        docs, before = made, after
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "packing"]
