import hashlib
import zlib

from pyspark.sql import functions as F

from colprobe.llm import merkle

SF_DIR = "/root/testdata/sf0.001"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    shown = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in shown))


def tree(digests):
    """The root, and the siblings of every leaf, level by level."""
    ways, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for n, p in enumerate(at):
            run = p // 3 * 3
            ways[n].append((digests[run:p], digests[p + 1 : run + 3]))
            at[n] = p // 3
        digests = [H("".join(digests[i : i + 3])) for i in range(0, len(digests), 3)]
    return digests[0], ways


def expected(rows, tampered=True):
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append((row["doc_id"], leaf(row, row["text"]), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for own in by_source.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: tree([r[1] for r in by_source[s]]) for s in order}
    root, over = tree([trees[s][0] for s in order])
    found = []
    for place, source in enumerate(order):
        for (ident, digest, row), way in zip(by_source[source], trees[source][1], strict=True):
            whole, folded = way + over[place], digest
            if tampered and ident is not None and zlib.crc32(str(ident).encode()) % 2 == 0 and row["text"]:
                folded = leaf(row, row["text"].replace("\n", ""))
            for left, right in whole:
                folded = H("".join(left) + folded + "".join(right))
            proof = H("".join("".join(left) + "".join(right) for left, right in whole))
            found.append((ident, digest, trees[source][0], root, proof, folded, folded == root))
    return found


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def check(docs, tampered=True):
    rows = [r.asDict() for r in docs.select(*merkle.FIELDS).collect()]
    found = merkle.proofs(docs, merkle.without_newlines() if tampered else None)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected(rows, tampered), key=key)


def test_whole_table(spark):
    check(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_trees_of_many_sizes(spark, monkeypatch):
    """Lone leaves, last runs of one and two, trees of several strides, hot lanes."""
    monkeypatch.setattr(merkle, "LANE", 7)
    rows = []
    for source, size in enumerate((1, 2, 3, 4, 9, 10, 28, 81, 82, 244, 700, 1, 5)):
        name = None if source == 3 else "ä" if source == 5 else f"s{source}"
        rows += [(len(rows) + n, f"text {n}\n\nof {source}", name, n) for n in range(size)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "en"))
    check(docs)
    check(docs.where("source = 's10'"))
    check(docs.where("doc_id = 0"), tampered=False)


def test_many_sources(spark):
    """More sources than one stride of the upper tree holds."""
    docs = spark.range(1300).selectExpr(
        "id AS doc_id", "'a\n' AS text", "concat('s', id % 700) AS source", "'en' AS lang", "id AS n_chars"
    )
    check(docs)


def test_every_change_shows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = merkle.proofs(docs, F.concat("text", F.lit("x")))
    assert found.where("verified").count() == docs.where("text IS NULL").count()
    assert found.where("leaf IS NULL OR subroot IS NULL OR folded_root IS NULL").count() == 0


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    check(odd_docs.withColumn("n_chars", F.lit(None).cast("bigint")).withColumn("lang", F.lit(None).cast("string")))
    assert merkle.proofs(no_docs, merkle.without_newlines()).count() == 0
