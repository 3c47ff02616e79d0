"""A chunk store that follows its documents: only what changed is chunked and embedded again.

The store at ``path`` has the folders ``model`` (fitted by the first run, then fixed, so that
old and new vectors can be compared), ``schema`` (an empty table) and ``chunks``, partitioned by
a hash bucket of the document. Chunks carry the digest of their document and the run that
embedded them. A run compares digests, embeds new and changed documents, and overwrites only
the buckets that these or removed documents lie in.

A run that was cut off leaves buckets of the old and of the new state side by side; the next
one finds by the digests what is left to do. One run at a time may write to a store.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colprobe.operators.chunking import chunk_recursive
from colprobe.operators.embedding import embed, fit_hashed_tfidf
from colprobe.session import files_of, shipped_if_small, stage

BUCKETS = 256
# Hex digits of a page's digest that are added up at a time; four such sums are kept.
DIGITS = 15


def bucket_of(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def document_digests(documents: DataFrame) -> DataFrame:
    """(doc_id, doc_digest), one row per document of any number of pages.

    Pages (source, page, text) are a multiset: their digests are added up, which combines
    before the shuffle, so a document of very many pages is never gathered.
    """

    def part(cell: str) -> Column:
        text = F.col(cell).cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        )

    page = F.sha2(F.concat(part("source"), part("page"), part("text")), 256)
    sums = [
        F.sum(F.conv(F.substring("d", 1 + DIGITS * i, DIGITS), 16, 10).cast("decimal(28, 0)"))
        for i in range(4)
    ]
    added = documents.select("doc_id", page.alias("d")).groupBy("doc_id")
    return added.agg(F.sha2(F.concat_ws(",", *sums), 256).alias("doc_digest"))


def chunked(documents: DataFrame, *others: str) -> DataFrame:
    chunks = chunk_recursive(documents.select("doc_id", "source", "page", "text", *others))
    return chunks.withColumnRenamed("chunk_text", "text").withColumn(
        "id", F.concat_ws("/", "doc_id", "page", "chunk_index")
    )


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(id, doc_id, source, page, chunk_index, text, embedding, doc_digest, run, bucket)"""
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(f"{path}/chunks")


def _exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = files_of(spark, path)
    return system.exists(hadoop)


def _texts(documents: DataFrame, changes: DataFrame, run: int, buckets: int) -> DataFrame:
    """Chunks of the documents in ``changes``, without vectors, stored by bucket."""
    digests = shipped_if_small(changes.select(F.col("doc_id").alias("of"), "doc_digest"))
    wanted = documents.join(digests, documents["doc_id"].eqNullSafe(digests["of"]))
    texts = chunked(wanted, "doc_digest").select(
        "id", "doc_id", "source", "page", "chunk_index", "text", "doc_digest",
        F.lit(run).alias("run"), bucket_of(F.col("doc_id"), buckets).alias("bucket"),
    )
    # texts travel, not vectors; a bucket that one document fills is cut into several tasks
    return stage(texts.hint("rebalance", "bucket"), "texts")


def _model(texts: DataFrame, path: str) -> PipelineModel:
    if not _exists(texts.sparkSession, f"{path}/model/metadata/_SUCCESS"):
        fit_hashed_tfidf(texts).write().overwrite().save(f"{path}/model")
    return PipelineModel.load(f"{path}/model")


def _embedded(texts: DataFrame, model: PipelineModel) -> DataFrame:
    return embed(texts, model).select(
        "id", "doc_id", "source", "page", "chunk_index", "text", "embedding", "doc_digest", "run", "bucket"
    )


def refresh(documents: DataFrame, path: str, buckets: int = BUCKETS) -> tuple[DataFrame, PipelineModel]:
    """Bring the store at ``path`` in line with documents (doc_id, source, page, text).

    Returns the stored chunks and the model. ``documents`` is the whole corpus: documents of the
    store that it lacks are removed. ``buckets`` stays as the store was made with. Pages without
    text count as absent; rows without an id form one document. A corpus without any text
    empties the store; it can't be the first one, as no model can be fitted to it.
    """
    spark = documents.sparkSession
    first = not _exists(spark, f"{path}/schema/_SUCCESS")
    documents = documents.where(F.col("text").rlike(r"\S"))  # blank pages have no chunks
    if first and documents.isEmpty():
        raise ValueError("the first run needs documents")
    given = document_digests(documents)
    if first:
        changes = given.selectExpr("doc_id", "doc_digest", "true AS embeds")
        known, run = None, 1
    else:
        known = stored_chunks(spark, path)
        held = known.groupBy(F.col("doc_id").alias("held_id")).agg(
            F.first("doc_digest").alias("held_digest"), F.lit(True).alias("held"), F.max("run").alias("run")
        )
        held = stage(held, "held")
        run = (held.agg(F.max("run")).first()[0] or 0) + 1
        differs = ~F.col("doc_digest").eqNullSafe(F.col("held_digest"))
        changes = given.withColumn("given", F.lit(True)).join(
            held, F.col("doc_id").eqNullSafe(F.col("held_id")), "full_outer"
        ).where(differs)
        changes = changes.select(
            F.when(F.col("given"), F.col("doc_id")).otherwise(F.col("held_id")).alias("doc_id"),
            "doc_digest",
            F.col("given").isNotNull().alias("embeds"),
        )
    changes = stage(changes.withColumn("bucket", bucket_of(F.col("doc_id"), buckets)), "changes")
    # at most as many rows as there are buckets
    touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]
    if not touched:
        return stored_chunks(spark, path), PipelineModel.load(f"{path}/model")
    texts = _texts(documents, changes.where("embeds"), run, buckets)
    model = _model(texts, path)
    rows, filled = _embedded(texts, model), texts.select("bucket")
    if known is None:
        rows.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
        system, folder = files_of(spark, f"{path}/chunks")
        system.mkdirs(folder)
    else:
        gone = shipped_if_small(changes.select(F.col("doc_id").alias("of")))
        kept = known.where(F.col("bucket").isin(touched))
        kept = kept.join(gone, kept["doc_id"].eqNullSafe(gone["of"]), "left_anti")
        rows, filled = rows.unionByName(kept), filled.unionAll(kept.select("bucket"))
    filled = {r["bucket"] for r in filled.distinct().collect()}
    # new files wait in a folder of their own until all are written, so old ones can be read
    writer = rows.write.mode("overwrite").partitionBy("bucket")
    writer.option("partitionOverwriteMode", "dynamic").parquet(f"{path}/chunks")
    for bucket in set(touched) - filled:
        system, folder = files_of(spark, f"{path}/chunks/bucket={bucket}")
        system.delete(folder, True)
    return stored_chunks(spark, path), model
