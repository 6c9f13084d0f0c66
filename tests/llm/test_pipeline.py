"""The pipeline: each stage beside what it promises, on the smallest tables and on odd rows."""

import os
import re

import pytest

import corpus_pipeline as P
from stratafin.llm import common

from .conftest import CLASHES, SF
from .test_pairs import jaccard, shingles
from .test_scans import plain_base, plain_contamination


@pytest.fixture(scope="module")
def results(spark):
    docs, out = common.documents(spark, SF), []
    from stratafin.session import stage

    for name, step in P.STAGES:
        after = stage(step(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_order_and_columns(results):
    assert list(results) == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    for name, (before, after) in results.items():
        if name != "tokens":
            assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_rejects(spark, results):
    before, after = results["quality"]
    labels = {r["doc_id"]: r["quality"] for r in common.labels(spark, SF).collect()}
    kept = {r["doc_id"] for r in after.collect()}
    held = [(d, q) for d, q in labels.items()]
    assert sum(q == 1 and d not in kept for d, q in held) <= 0.05 * len(held)
    assert 0 < before.count() - after.count() < 0.5 * before.count()


def test_one_of_each_group(results):
    before, after = ({r["doc_id"]: shingles(r["text"]) for r in x.collect()} for x in results["near_duplicates"])
    ids = sorted(after)
    assert not [(a, b) for i, a in enumerate(ids) for b in ids[:i] if jaccard(after[a], after[b]) >= 0.85]
    for gone in set(before) - set(after):
        assert max(jaccard(before[gone], s) for d, s in before.items() if d != gone) >= 0.62


def test_no_benchmark_window_is_left(spark, results):
    before, after = results["decontamination"]
    items = [tuple(r) for r in common.benchmark(spark, SF).select("item_id", "text").collect()]
    hits = {r[0]: r[2] for r in plain_contamination([tuple(r) for r in before.select("doc_id", "text").collect()], items, 10)}
    assert {r["doc_id"] for r in after.collect()} == {d for d, n in hits.items() if n == 0}


def test_secrets_are_replaced(results):
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in results["secrets"])
    assert set(before) == set(after)
    for d, text in after.items():
        assert not plain_base(text)
        assert bool(plain_base(before[d])) == bool(re.search(r"\[SECRET\]|\[SAMPLE KEY\]", text)) or text == before[d]


def test_tokens_decode_to_the_text(results):
    import hashlib

    before, after = results["tokens"]
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(text)
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_run_is_the_stages(spark, results):
    key = lambda r: r["doc_id"]
    assert sorted(P.run(spark, SF).drop("ids").collect(), key=key) == sorted(results["tokens"][1].drop("ids").collect(), key=key)


def test_odd_rows_pass_every_stage(spark, odd, empty):
    for docs in (odd, empty):
        for name, step in P.STAGES:
            out = step(spark, docs, SF)
            assert name == "tokens" or set(CLASHES) <= set(out.columns)
            assert out.count() <= docs.count()


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(bool(re.match(r"op\d+_", n)) for n in names) == 13
    assert os.path.exists(os.path.join(os.path.dirname(P.__file__), "__spark_entry__.py"))
