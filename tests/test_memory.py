"""What a task holds in Python is bounded, whatever the number of rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from colprobe.operators import chunking, repeats


def test_texts_reach_python_some_at_a_time(spark):
    texts = spark.range(0, 400, 1, 1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text")
    )
    counts = chunking.chunk_recursive(texts).groupBy("doc_id").count().collect()
    assert len(counts) == 400 and {r["count"] for r in counts} == {len(chunking.split_recursive("word " * 20_000))}

    @F.arrow_udf("long")
    def together(batch: pa.Array) -> pa.Array:
        return pa.array([len(batch)] * len(batch), pa.int64())

    assert texts.agg(F.max(together("text"))).first()[0] < 100  # 40 MB in one batch before


def test_slots_are_sent_before_many_are_held(spark):
    """A task held up to 4 194 304 cells, with several copies of them while it coded."""
    cells = spark.range(0, 2_500_000, 1, 1).select(F.lit(0).alias("column_ix"), F.col("id").alias("slot"))
    packed = repeats.packed_slots(cells, 32, 0)
    assert packed.count() == 3
    assert repeats.repeated_slots(packed).count() == 0
    assert repeats.repeated_slots(packed.unionAll(packed)).count() == 2_500_000
