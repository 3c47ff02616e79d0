"""The chunk store that follows its documents, and pages of files that are read in splits."""

import os

import pytest
from pyspark.sql import functions as F

from colprobe.operators.embedding import embed
from colprobe.plans import refresh as plans
from colprobe.session import new_path
from colprobe.sources import corpus as source

WORDS = "river bridge apple orchard stone market winter engine copper letter".split()


def corpus_of(spark, texts):
    """Documents from {doc_id: [text of each page]}."""
    rows = [(d, f"s{d}", p, text) for d, pages in texts.items() for p, text in enumerate(pages)]
    return spark.createDataFrame(rows, "doc_id long, source string, page int, text string")


def words(n, start):
    return " ".join(WORDS[(start + i * i) % len(WORDS)] for i in range(n))


def content(chunks):
    kept = chunks.select("id", "doc_id", "source", "page", "chunk_index", "text", "embedding")
    return sorted(tuple(map(str, r)) for r in kept.collect())


def full_run(documents, model):
    return content(embed(plans.chunked(documents), model))


def files(path):
    found = {}
    for folder, _, names in os.walk(f"{path}/chunks"):
        for name in names:
            if name.endswith(".parquet"):
                found.setdefault(os.path.basename(folder), set()).add(name)
    return found


def runs(chunks):
    return {r["doc_id"]: r["run"] for r in chunks.groupBy("doc_id").agg(F.max("run").alias("run")).collect()}


@pytest.fixture(scope="module")
def texts():
    pages = {d: [words(30 + d, d)] for d in range(30)}
    pages[3] = [words(400, 1), "", words(20, 5), words(20, 5)]  # a blank page, repeated pages
    pages[None] = [words(12, 2)]
    pages[30] = ["  \n"]
    return pages


def test_only_changes_are_embedded(spark, texts):
    path = new_path(spark, "store")
    documents = corpus_of(spark, texts)
    chunks, model = plans.refresh(documents, path, buckets=16)
    assert content(chunks) == full_run(documents, model)
    assert set(runs(chunks).values()) == {1} and 30 not in runs(chunks)
    before = files(path)
    # nothing changed: rows in another order, and nothing is written
    chunks, _ = plans.refresh(documents.orderBy(F.desc("page"), F.desc("text")), path, buckets=16)
    assert files(path) == before and set(runs(chunks).values()) == {1}
    # a page changed, a document without id changed, one removed, one new, one went blank
    later = dict(texts)
    later[3] = [*texts[3][:3], words(21, 5)]
    later[None] = [words(13, 2)]
    later[40] = [words(9, 4)]
    later[7] = [" "]
    del later[8]
    documents = corpus_of(spark, later)
    chunks, again = plans.refresh(documents, path, buckets=16)
    assert content(chunks) == full_run(documents, model) == full_run(documents, again)
    assert {d for d, run in runs(chunks).items() if run == 2} == {3, None, 40}
    ids = spark.createDataFrame([(d,) for d in (3, None, 40, 7, 8)], "doc_id long")
    touched = {f"bucket={r[0]}" for r in ids.select(plans.bucket_of(F.col("doc_id"), 16)).collect()}
    after = files(path)
    assert all(after[b] == names for b, names in before.items() if b not in touched)
    # a run that was cut off: a bucket is missing, the next run fills it again
    lost = sorted(after)[0]
    for name in after[lost]:
        os.remove(f"{path}/chunks/{lost}/{name}")
    chunks, _ = plans.refresh(documents, path, buckets=16)
    assert content(chunks) == full_run(documents, model)


def test_store_is_emptied_and_filled_again(spark, texts):
    path = new_path(spark, "store")
    documents = corpus_of(spark, {d: texts[d] for d in (1, 2, None)})
    with pytest.raises(ValueError):
        plans.refresh(documents.where("false"), path, buckets=4)
    plans.refresh(documents, path, buckets=4)
    chunks, _ = plans.refresh(documents.where("false"), path, buckets=4)
    assert chunks.count() == 0
    chunks, model = plans.refresh(documents, path, buckets=4)
    assert content(chunks) == full_run(documents, model)


def test_digests_tell_pages_apart(spark):
    def digest(*pages):
        frame = spark.createDataFrame([(1, *p) for p in pages], "doc_id int, source string, page int, text string")
        return plans.document_digests(frame).first()["doc_digest"]

    one = digest(("a", 0, "xy"), ("a", 1, "z"))
    assert one == digest(("a", 1, "z"), ("a", 0, "xy"))
    others = [
        digest(("a", 0, "xy")),
        digest(("a", 0, "xy"), ("a", 1, "z"), ("a", 1, "z")),
        digest(("a", 1, "xy"), ("a", 0, "z")),
        digest((None, 0, "xy"), ("a", 1, "z")),
        digest(("a0", 0, "xy"), ("a", 1, "z")),
    ]
    assert len({one, *others}) == 6


def test_files_are_split_at_page_breaks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    written = {
        "long.txt": ["", *(f"page {i} — " + "x" * (i * 37 % 211) + "\nline\r\n" for i in range(300)), "end"],
        "sub/ünicode name.txt": ["über", "", "", "zwei"],
        "one.txt": ["only"],
    }
    for name, pages in written.items():
        (tmp_path / name).write_bytes("\f".join(pages).encode())
    (tmp_path / "closed.txt").write_bytes("a\fb\f".encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        pages = source.load_corpus_files(spark, str(tmp_path))
        assert pages.rdd.getNumPartitions() > 100
        read = pages.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    found = {}
    for row in read:
        found.setdefault(row["source"].rsplit("/", 1)[1], []).append((row["page"], row["text"]))
    found = {name: sorted(pages) for name, pages in found.items()}
    assert found.pop("closed.txt") == [(0, "a"), (1, "b")]
    assert len(found) == 3
    for name, pages in written.items():
        name = name.rsplit("/", 1)[-1].replace(" ", "%20").replace("ü", "%C3%BC")
        key = name if name in found else name.replace("%C3%BC", "ü")
        assert found[key] == list(enumerate(pages))
