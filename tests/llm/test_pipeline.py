import corpus_pipeline as pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_exact_dedup import norm
from test_near_dedup import groups
from test_spans import personal_base
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.001"
STEPS = dict(pipeline.STAGES)


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}

    good = STEPS["quality"](spark, docs, SF_DIR).cache()
    kept = {r["doc_id"] for r in good.collect()}
    judged = [(labels[i] == 1, i in kept) for i in labels]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)

    single = STEPS["exact_dedup"](spark, good, SF_DIR).cache()
    first = {}
    for r in sorted(good.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(norm(r["text"]), r["doc_id"])
    assert {r["doc_id"] for r in single.collect()} == set(first.values())

    apart = STEPS["near_dedup"](spark, single, SF_DIR).cache()
    roots = groups({r["doc_id"]: r["text"] for r in single.collect()})
    assert {r["doc_id"] for r in apart.collect()} == set(roots.values())

    masked = STEPS["personal_data"](spark, apart, SF_DIR).cache()
    assert masked.columns == apart.columns == docs.columns
    before = {r["doc_id"]: r["text"] for r in apart.collect()}
    for r in masked.collect():
        if not personal_base(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
        else:
            assert r["text"] != before[r["doc_id"]] and r["n_chars"] == len(r["text"])

    packed = STEPS["packing"](spark, masked, SF_DIR)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(r["text"]).ids) + 1 for r in masked.collect())
    assert packed.agg(F.sum("length")).first()[0] == total


def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, step in pipeline.STAGES:
            out = step(spark, docs, SF_DIR)
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()


def test_run(spark):
    rows = pipeline.run(spark, SF_DIR)
    assert rows.count() > 0 and "sequence_id" in rows.columns
