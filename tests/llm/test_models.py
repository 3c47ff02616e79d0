import numpy as np
from pyspark.sql import functions as F

from colprobe.llm import language, quality

SF_DIR = "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = language.predict(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held >= 0.98
    assert found.count() == docs.count()
    assert found.where("score < 0 OR score > 1").count() == 0


def test_machines_follow_families():
    assert language.plan(["en", "de", "fr"]) == [("", "germanic", "romance"), ("germanic", "de", "en")]
    assert language.plan(["en"]) == []
    assert ("other", "aa", "zz") in language.plan(["aa", "zz"])


def test_language_odd_rows(odd_docs, no_docs):
    model = language.learn(odd_docs)
    rows = {r["doc_id"]: r for r in language.predict(odd_docs, model).collect() if r["doc_id"]}
    assert all(rows[n]["lang_pred"] == "und" for n in (1, 2, 3, 6))
    assert rows[4]["lang_pred"] == "en" and rows[8]["lang_pred"] == "en"
    assert language.predict(no_docs, language.learn(no_docs)).count() == 0
    unlearned = language.predict(odd_docs, language.learn(no_docs)).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"} and len(unlearned) == odd_docs.count()


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_scores(docs, quality.learn(docs, labels))
    assert found.count() == docs.count()
    judged = found.join(labels, "doc_id").where("held_out").toPandas()
    assert (judged["predicted"] == judged["quality"]).mean() >= 0.97


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    values = rng.random((4000, 4))
    labels = ((values[:, 0] > 0.5) ^ (values[:, 2] > 0.5)).astype(float)
    model = quality.fit(values, labels)
    assert ((quality.scored(model, values) >= 0.5) == labels).mean() > 0.95
    assert {0, 2} == set(model["pairs"][0][:2])


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(4, 1, 0), (5, 1, 0), (5, 1, 0), (6, 0, 0), (7, None, 0), (None, 1, 0), (99, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    model = quality.learn(odd_docs, labels)
    rows = quality.quality_scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.accepted(odd_docs, model).schema == odd_docs.schema
    assert quality.quality_scores(no_docs, model).count() == 0
    assert quality.accepted(no_docs, model).count() == 0
    nothing = quality.learn(no_docs, labels.limit(0))
    assert {r["score"] for r in quality.quality_scores(odd_docs, nothing).collect()} == {0.5}
