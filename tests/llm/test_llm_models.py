"""Language identification, quality ranking: held-out accuracy and defined results."""

import numpy as np


from riskloom.llm import language_id, quality_classifier

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    rows = language_id.op3_language_id(spark, SF01).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 150
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = {r.doc_id: r for r in language_id.predict(odd_docs, model).collect()}
    assert [rows[k].lang_pred for k in (0, 1, 2, 14)] == ["und"] * 4 and rows[0].score == 0
    assert rows[9].lang_pred in model.languages and rows[5].lang_pred == rows[6].lang_pred
    assert language_id.predict(no_docs, model).count() == 0
    nothing = language_id.fit(no_docs)
    assert {r.lang_pred for r in language_id.predict(odd_docs, nothing).collect()} == {"und"}


def test_logits_do_not_depend_on_the_batch():
    texts = ["the cat sat", None, "", "é" * 50, "1 2 3", "la casa es grande " * 50]
    rng = np.random.default_rng(0)
    model = language_id.LanguageModel(["a", "b"], rng.normal(size=(2, language_id.BUCKETS)), np.zeros(2))
    together = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone])


def test_quality_held_out_ranking(spark):
    rows = quality_classifier.op7_quality_classifier(spark, SF01).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    held = [(r.score, r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good = np.array([s for s, _, y in held if y == 1])
    bad = np.array([s for s, _, y in held if y == 0])
    assert len(good) > 20 and len(bad) > 3
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert np.mean([p == y for _, p, y in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    model = quality_classifier.fit(spark.read.parquet(f"{SF01}/documents.parquet"), labels)
    rows = quality_classifier.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[0] == by[1] and by[5] == by[6]
    kept = quality_classifier.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in rows if r.score >= 0.3)
    assert quality_classifier.score(no_docs, model).count() == 0
    none = quality_classifier.fit(no_docs, labels.filter("1 = 0"))
    assert {round(r.score, 9) for r in quality_classifier.score(odd_docs, none).collect()} == {0.3}
