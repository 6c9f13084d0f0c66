"""Quality and language classifiers: identities, held-out accuracy, odd rows."""

import numpy as np
import pytest

from stratafin.llm import common, language_svm, quality_fm

TRAIN = "/root/testdata/sf0.01"


def test_pairwise_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    model = quality_fm.fit([quality_fm.features(t, [1.0]) for t in ("a b c", "d e", "a d")], np.array([1, 0, 1], np.float32), len(quality_fm.STATS) + 1)
    model.factors = rng.normal(size=model.factors.shape).astype(np.float32)
    model.linear = rng.normal(size=model.linear.shape).astype(np.float32)
    rows = [quality_fm.features("one two two three", [None]), quality_fm.features(None, [5.0])]
    ids, values, starts = model.design(rows)
    out, _ = model.raw(ids, values, starts)
    for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
        i, x = ids[lo:hi], values[lo:hi]
        pairs = sum(model.factors[i[a]] @ model.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert out[k] == pytest.approx(model.bias + model.linear[i] @ x + pairs, rel=1e-3)


def test_quality_of_held_out_documents(spark):
    docs, labels = common.documents(spark, TRAIN), common.labels(spark, TRAIN)
    scored = quality_fm.score(docs, quality_fm.train(docs, labels))
    held = scored.join(labels, "doc_id").where(common.fold("doc_id", 5) == 0).toPandas()
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (good >= quality_fm.THRESHOLD).mean() > 0.97 and (bad < quality_fm.THRESHOLD).mean() > 0.8


def test_quality_of_odd_rows(odd, empty, labels):
    model = quality_fm.train(odd, labels)
    found = quality_fm.score(odd, model, keep=tuple(odd.columns), out="__score").collect()
    assert len(found) == odd.count() and all(0 <= r["__score"] <= 1 for r in found)
    assert len({r["__score"] for r in found if r["doc_id"] in (6, 7)}) == 1
    assert quality_fm.score(empty, model).count() == 0
    nothing = quality_fm.train(empty, labels)
    assert all(r["score"] == pytest.approx(0.5) for r in quality_fm.score(odd, nothing).collect())
    assert quality_fm.score(odd, quality_fm.train(odd, labels.where("false"))).count() == odd.count()


def test_held_out_labels_change_nothing(odd, labels):
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(common.fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: sorted(r["score"] for r in quality_fm.score(odd, quality_fm.train(odd, x)).collect())
    assert score(labels) == score(flipped)


def test_language_of_held_out_documents(spark):
    docs = common.documents(spark, TRAIN)
    found = language_svm.predict(docs, language_svm.train(docs), keep=("doc_id", "lang")).where(common.fold("doc_id", 4) == 2).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_levels_follow_families(spark):
    docs = common.documents(spark, TRAIN)
    model = language_svm.train(docs, sample_rows=200)
    assert model.family.classes == ["germanic", "romance"]
    assert {f: m.classes for f, m in model.within.items()} == {"germanic": ["de", "en"], "romance": ["es", "fr"]}


def test_language_of_odd_rows(odd, empty):
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_svm.predict(odd, language_svm.train(odd)).collect()}
    assert all(found[i] == ("und", 0.0) for i in (2, 3, 4, 60))
    assert found[1][0] != "und"
    assert language_svm.predict(empty, language_svm.train(odd)).count() == 0
    assert {r["lang_pred"] for r in language_svm.predict(odd, language_svm.train(empty)).collect()} == {"und"}
    single = language_svm.train(odd.where("lang = 'en'"))
    assert {r["score"] for r in language_svm.predict(odd, single).collect() if r["lang_pred"] == "en"} == {1.0}
