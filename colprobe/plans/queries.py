"""The registered queries: one per operator, over the whole of the given tables.

Inputs that the tables do not offer (missing cells, infinite numbers, personal data in
tabular columns, markers) are derived from every row by an expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colprobe.functions.patterns import PATTERNS
from colprobe.functions.text import key_phrases, section_title
from colprobe.functions.types import fields_of
from colprobe.operators import anonymity, chunking, citations, compressed, constraints, interactions, neighbours
from colprobe.operators import embedding as emb
from colprobe.operators import frequencies as freq
from colprobe.operators import privacy, quality, repeats, samples, scan, sketches
from colprobe.operators.outliers import outliers
from colprobe.operators.prompts import prompt_batch as prompts_of
from colprobe.plans import corpus as corpus_plans
from colprobe.plans import refresh as refresh_plans
from colprobe.plans.profile import TableProfile
from colprobe.session import new_path, spread, stage
from colprobe.sources import corpus as corpus_source
from colprobe.sources import tables
from colprobe.streaming import state, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def query_named(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.load_table(spark, f"{sf_dir}/{name}.parquet", "parquet")


def six(name: str) -> Column:
    return F.round(F.col(name).cast("double"), 6).alias(name)


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, doubles to six places."""
    kept = df.select(*columns) if columns else df
    return kept.select(*[six(n) if t == "double" else F.col(n) for n, t in kept.dtypes])


# --- derived inputs ---------------------------------------------------------------


def orders_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a fifth of the priorities and three fifths of the prices missing."""
    return table(spark, sf_dir, "orders").withColumns(
        {
            "o_orderpriority": F.expr("nullif(o_orderpriority, '3-MEDIUM')"),
            "o_totalprice": F.when(F.col("o_totalprice") >= 300000, F.col("o_totalprice")),
        }
    )


def customer_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a national id, an address and a date of birth."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "c_name",
        "concat('S', lpad(cast(c_custkey AS string), 7, '0'), 'A') AS c_nric",
        "concat(cast(c_custkey + 1 AS string), ' Orchard Road') AS c_address",
        "concat(cast(c_nationkey + 1 AS string), '/6/', cast(1950 + c_nationkey AS string)) "
        "AS c_birth",
        "c_mktsegment",
    )


def orders_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the date as text, impossible for urgent ones."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN '2024-02-30' "
        "ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS o_date",
    )


def part_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with infinite prices, empty brands and names in three kinds of case."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "CASE WHEN p_size < 15 THEN upper(p_name) WHEN p_size < 30 THEN lower(p_name) "
        "ELSE concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) END AS p_name",
        "CASE WHEN p_size = 1 THEN '' ELSE p_brand END AS p_brand",
        "p_size",
        "CASE WHEN p_size >= 49 THEN double('infinity') ELSE p_retailprice END AS p_retailprice",
    )


# --- sources and sinks --------------------------------------------------------------


@query
def load_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "customer-csv")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    return shown(tables.load_table(spark, path, "csv"))


@query
def dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dataset_overview(table(spark, sf_dir, "orders"))


@query
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = TableProfile(table(spark, sf_dir, "customer"))
    return profile.json_report("customer", "2024-01-01T00:00:00")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_source.load_corpus_table(spark, f"{sf_dir}/documents.parquet")


@query
def corpus_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir)


@query
def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks stored with the vector of their document, and opened again."""
    stored = vectors(spark, sf_dir).select(F.col("id").alias("doc_id"), "vector")
    chunks = chunking.chunk_fixed(corpus(spark, sf_dir)).join(stored, "doc_id", "left")
    path = new_path(spark, "chunks")
    corpus_source.save_chunks(chunks.withColumnRenamed("vector", "embedding"), path)
    opened = corpus_source.open_chunks(spark, path)
    return opened.select(
        "doc_id",
        "chunk_index",
        "chunk_text",
        F.size(F.coalesce("embedding", F.array().cast("array<float>"))).alias("dimensions"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"),
        F.round(F.get("embedding", F.lit(63)).cast("double"), 6).alias("last"),
    )


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_source.corpus_stats(chunking.chunk_fixed(corpus(spark, sf_dir)))


# --- column primitives --------------------------------------------------------------


@query
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.missing_values(orders_nulls(spark, sf_dir)))


@query
def data_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.data_types(table(spark, sf_dir, "lineitem")))


@query
def value_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = freq.value_frequencies(table(spark, sf_dir, "orders"))
    return counts.select("column_name", "value", "freq")


@query
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = freq.frequency_metrics(table(spark, sf_dir, "lineitem"))
    return metrics.select("column_name", "distinct_count")


@query
def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches stored per year of shipment and united, next to the exact counts."""
    lines, path = table(spark, sf_dir, "lineitem"), new_path(spark, "sketches")
    sketches.store_sketches(lines, "year(l_shipdate)", path)
    united = sketches.united_counts(sketches.stored_sketches(spark, path), fields_of(lines))
    exact = freq.frequency_metrics(lines).select("column_ix", F.col("distinct_count").alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= F.col("exact") * 0.04
    # both have one row per column
    return united.join(F.broadcast(exact), "column_ix").select(
        "column_name", "total_count", F.col("exact").alias("distinct_count"), near.alias("within_bound")
    )


LINE_FACETS = [
    "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
]


@query
def identifying_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return anonymity.identifying_sets(lines, k=5, columns=LINE_FACETS, max_columns=4)


@query
def identifying_sets_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymity.identifying_sets(table(spark, sf_dir, "customer"), k=5)


@query
def column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.column_samples(table(spark, sf_dir, "customer"))
    return rows.select("column_name", "rank", "value")


@query
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq.duplicate_rows(table(spark, sf_dir, "events").select("event_type", "user_id"))


@query
def distinct_counts_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of ``orders``, keys and facets, unique values staying where they are."""
    return repeats.distinct_counts(table(spark, sf_dir, "orders")).drop("column_ix")


@query
def duplicate_rows_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.duplicate_rows(table(spark, sf_dir, "lineitem"))


@query
def constraint_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = checks(("o_orderkey", "unique", ""), ("o_custkey", "unique", ""))
    orders = table(spark, sf_dir, "orders")
    return shown(constraints.apply_constraints(orders, wanted, few_repeats=True))


# --- privacy --------------------------------------------------------------------------


@query
def uniqueness_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = privacy.uniqueness_risk(table(spark, sf_dir, "customer"))
    return shown(rows, "column_name", "uniqueness_score")


@query
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = privacy.pii_counts(table(spark, sf_dir, "documents"), ["text"])
    pages = privacy.pii_counts(table(spark, sf_dir, "pages"), ["html", "url"])
    return texts.unionByName(pages).drop("column_ix")


@query
def pii_counts_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pii_counts(customer_personal(spark, sf_dir)).drop("column_ix")


@query
def pattern_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scan.pattern_match_count(documents, "text", PATTERNS["email"])


@query
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = privacy.sensitivity(table(spark, sf_dir, "documents"))
    return shown(rows, "column_name", "sensitive_data_score", "sensitivity_type")


@query
def privacy_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(privacy.privacy_risk(table(spark, sf_dir, "documents")).drop("column_ix"))


@query
def privacy_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(privacy.privacy_factor(table(spark, sf_dir, "orders")).drop("column_ix"))


@query
def shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(privacy.shannon_entropy(table(spark, sf_dir, "orders")).drop("column_ix"))


@query
def hartley_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(privacy.hartley_measure(table(spark, sf_dir, "orders")).drop("column_ix"))


@query
def entropy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(privacy.entropy_profile(table(spark, sf_dir, "lineitem")).drop("column_ix"))


@query
def entropy_profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(privacy.entropy_profile(orders_nulls(spark, sf_dir)).drop("column_ix"))


@query
def risk_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = TableProfile(table(spark, sf_dir, "customer"), with_accuracy=False)
    return privacy.risk_advice(privacy.dataset_risk_level(profile.privacy_summary()))


# o_orderkey is unique, so its factor makes every product with it zero
FACTOR_COLUMNS = ["o_custkey", "o_totalprice", "o_orderdate", "no_such_column"]


@query
def cumulative_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = privacy.entropy_profile(table(spark, sf_dir, "orders"))
    return shown(privacy.cumulative_factor(profile))


@query
def cumulative_factor_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = privacy.entropy_profile(table(spark, sf_dir, "orders"))
    return shown(privacy.cumulative_factor(profile, FACTOR_COLUMNS))


@query
def entropy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = privacy.entropy_summary(privacy.entropy_profile(table(spark, sf_dir, "orders")))
    return shown(
        summary,
        "overall_privacy_factor",
        "avg_privacy_factor",
        "avg_shannon_entropy",
        "avg_hartley_measure",
    )


@query
def factor_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.factor_buckets(privacy.entropy_profile(table(spark, sf_dir, "orders")))


@query
def privacy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(privacy.privacy_profile(table(spark, sf_dir, "documents")).drop("column_ix"))


def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.privacy_summary(privacy.privacy_profile(table(spark, sf_dir, "documents")))


@query
def privacy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(document_summary(spark, sf_dir))


@query
def risk_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = privacy.privacy_profile(table(spark, sf_dir, "documents"))
    return privacy.with_risk_category(profile).select("column_name", "risk_category")


@query
def dataset_risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(privacy.dataset_risk_level(document_summary(spark, sf_dir)))


@query
def risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(privacy.risk_distribution(document_summary(spark, sf_dir)))


@query
def ranked_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four rankings of the columns of orders."""
    profile = privacy.privacy_profile(table(spark, sf_dir, "orders"))
    metrics = ("privacy_risk_score", "privacy_factor", "shannon_entropy", "hartley_measure")
    return shown(privacy.ranked_columns(profile, *metrics))


@query
def high_risk_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = privacy.privacy_profile(customer_personal(spark, sf_dir))
    return shown(privacy.high_risk_columns(profile))


# --- quality -----------------------------------------------------------------------------


@query
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.completeness(orders_nulls(spark, sf_dir)))


@query
def completeness_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.completeness_overall(orders_nulls(spark, sf_dir)))


@query
def accuracy_iforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outliers(table(spark, sf_dir, "lineitem"))
    return shown(rows, "column_name", "outlier_count", "outlier_percentage", "accuracy_score")


@query_named("outliers")
def outliers_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers with gaps: missing cells are filled with the column's median."""
    rows = outliers(orders_nulls(spark, sf_dir))
    return shown(rows, "column_name", "outlier_count", "outlier_percentage")


@query
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.validity(part_odd(spark, sf_dir)))


@query
def validity_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.validity_overall(part_odd(spark, sf_dir)))


@query
def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.uniqueness(table(spark, sf_dir, "orders")))


@query
def uniqueness_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.uniqueness_overall(table(spark, sf_dir, "orders")))


@query
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.integrity(table(spark, sf_dir, "lineitem")))


@query
def integrity_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.integrity_overall(table(spark, sf_dir, "customer")))


@query
def integrity_overall_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.integrity_overall(orders_nulls(spark, sf_dir)))


@query
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = quality.consistency(part_odd(spark, sf_dir))
    parts = parts.unionByName(quality.consistency(table(spark, sf_dir, "orders")))
    return shown(parts.na.fill(0))


@query
def consistency_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.consistency_overall(table(spark, sf_dir, "orders")))


@query
def consistency_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.consistency_legacy(part_odd(spark, sf_dir)))


SUMMARY = (
    "completeness",
    "accuracy",
    "validity",
    "uniqueness",
    "integrity",
    "consistency",
    "overall_quality_score",
)


@query
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = TableProfile(table(spark, sf_dir, "orders"))
    return shown(profile.quality_summary(), *SUMMARY)


@query
def quality_summary_noacc(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = TableProfile(table(spark, sf_dir, "orders"), with_accuracy=False)
    return shown(profile.quality_summary(), *SUMMARY)


@query
def quality_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(TableProfile(orders_nulls(spark, sf_dir)).quality_legacy())


@query
def quality_legacy_noacc(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = TableProfile(orders_nulls(spark, sf_dir), with_accuracy=False)
    return shown(profile.quality_legacy())


@query
def column_quality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = TableProfile(table(spark, sf_dir, "orders"))
    return quality.column_quality_table(profile.columns)


@query
def column_quality_table_noacc(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = TableProfile(orders_nulls(spark, sf_dir), with_accuracy=False)
    return quality.column_quality_table(profile.columns)


@query
def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = TableProfile(table(spark, sf_dir, "orders"), with_accuracy=False)
    return shown(quality.dimension_scores(profile.quality_summary()))


# --- constraints -------------------------------------------------------------------------


def checks(*triples: tuple[str, str, str]) -> list[dict]:
    return [{"column": c, "type": t, "value": v} for c, t, v in triples]


LINEITEM_CHECKS = checks(
    ("l_orderkey", "not_null", ""),
    ("l_orderkey", "unique", ""),
    ("l_quantity", "min_value", "10"),
    ("l_discount", "max_value", "0.05"),
    ("l_returnflag", "regex", "[AN]"),
    ("l_linestatus", "value_in_list", "F"),
    ("l_shipdate", "date_format", ""),
    ("l_returnflag", "min_value", "1"),
    ("l_tax", "max_value", "x"),
    ("missing_col", "not_null", ""),
    ("l_tax", "foo", ""),
)


def lineitem_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.apply_constraints(table(spark, sf_dir, "lineitem"), LINEITEM_CHECKS)


@query
def constraints_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(lineitem_results(spark, sf_dir))


@query
def constraint_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = checks(("o_orderpriority", "not_null", ""), ("o_orderkey", "not_null", ""))
    return shown(constraints.apply_constraints(orders_nulls(spark, sf_dir), wanted))


@query
def constraint_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = checks(("o_orderkey", "unique", ""), ("o_custkey", "unique", ""))
    return shown(constraints.apply_constraints(table(spark, sf_dir, "orders"), wanted))


@query
def constraint_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = checks(("l_quantity", "min_value", "10"), ("l_tax", "min_value", ""))
    return shown(constraints.apply_constraints(table(spark, sf_dir, "lineitem"), wanted))


@query
def constraint_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = checks(("l_discount", "max_value", "0.05"), ("l_quantity", "max_value", "50"))
    return shown(constraints.apply_constraints(table(spark, sf_dir, "lineitem"), wanted))


@query
def constraint_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = checks(
        ("c_name", "regex", "Customer#[0-9]{9}"),
        ("c_mktsegment", "regex", "(?P<first>[A-H])"),
        ("c_name", "regex", "["),
    )
    return shown(constraints.apply_constraints(table(spark, sf_dir, "customer"), wanted))


@query
def constraint_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = checks(
        ("o_orderstatus", "value_in_list", "O, F"), ("o_custkey", "value_in_list", "1, 2, 3.0")
    )
    return shown(constraints.apply_constraints(table(spark, sf_dir, "orders"), wanted))


@query
def constraint_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = checks(("o_date", "date_format", ""), ("o_date", "date_format", "%d/%m/%Y"))
    return shown(constraints.apply_constraints(orders_dates(spark, sf_dir), wanted))


@query
def constraint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(constraints.constraint_summary(lineitem_results(spark, sf_dir)))


@query
def constraint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.constraint_table(lineitem_results(spark, sf_dir))


# --- assessment ----------------------------------------------------------------------------


@query
def assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("customer", "orders", "part", "supplier")
    rows = [
        TableProfile(table(spark, sf_dir, n), with_accuracy=False).assessment(n) for n in names
    ]
    return shown(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]))


@query
def report_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(TableProfile(table(spark, sf_dir, "customer")).report_row())


@query
def report_row_noacc(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = TableProfile(table(spark, sf_dir, "customer"), with_accuracy=False)
    return shown(profile.report_row())


# --- corpus and retrieval -----------------------------------------------------------------


@query
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_fixed(corpus(spark, sf_dir))
    return chunks.select("doc_id", "chunk_index", "start", "chunk_text")


@query
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_recursive(corpus(spark, sf_dir))
    return chunks.select("doc_id", "chunk_index", "chunk_text")


@query
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _ = corpus_plans.ingest(corpus(spark, sf_dir))
    return corpus_source.corpus_stats(chunks)


@query
def ingest_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which run embedded what: a third of the documents is new to the second run or changed by it."""
    documents, path = corpus(spark, sf_dir), new_path(spark, "store")
    kind = F.pmod("doc_id", F.lit(6))
    changed = F.when(kind == 3, F.concat("text", F.lit(" Changed."))).otherwise(F.col("text"))
    refresh_plans.refresh(documents.where(kind != 4), path)
    later = documents.where(kind != 5).withColumn("text", changed)
    chunks, _ = refresh_plans.refresh(later, path)
    return chunks.groupBy("doc_id").agg(
        F.max("run").alias("run"),
        F.bool_and(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x) > 0.99).alias("embedded"),
    )


@query
def corpus_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of text files, read back with their page numbers."""
    folder = new_path(spark, "files")
    pages = table(spark, sf_dir, "documents").sortWithinPartitions("doc_id").select(
        F.concat_ws(" ", "doc_id", F.translate("text", corpus_source.PAGE_BREAK, " "))
    )
    pages.write.option("lineSep", corpus_source.PAGE_BREAK).text(folder)
    read = corpus_source.load_corpus_files(spark, folder)
    number, text = F.split("text", " ", 2)[0].cast("long"), F.split("text", " ", 2)[1]
    before = F.lag("doc_id").over(Window.partitionBy("source").orderBy("page"))
    in_order = F.coalesce(before < F.col("doc_id"), F.col("page") == 0)
    return read.select(
        "source", "page", number.alias("doc_id"), F.sha2(text, 256).alias("text_sha256")
    ).select("doc_id", "text_sha256", in_order.alias("in_order"))


@query
def embed_hash_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    vectors = emb.embed(documents, emb.fit_hashed_tfidf(documents))
    return vectors.select("doc_id", "embedding")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_raw(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def table_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its arrays left as arrays."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every label's mean vector."""
    stored = vectors(spark, sf_dir)
    means = stage(neighbours.centroids(stored, "label"), "means")
    return neighbours.top_k(means, stored)


@query
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(label_neighbours(spark, sf_dir))


@query
def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours of every vector among all vectors."""
    stored = vectors(spark, sf_dir)
    return shown(neighbours.top_k_indexed(stored.withColumnRenamed("id", "query_id"), stored))


@query
def knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the exact neighbours of all vectors the inverted file finds."""
    stored = vectors(spark, sf_dir).select("id", "vector")
    asked = stored.withColumnRenamed("id", "query_id")
    return recall_of(asked, stored, neighbours.top_k_indexed(asked, stored))


def recall_of(asked: DataFrame, stored: DataFrame, found: DataFrame) -> DataFrame:
    """One row: the queries, the fewest rows of one, and whether nine tenths were found."""
    exact = neighbours.top_k(asked, stored).select("query_id", "id", F.lit(1).alias("wanted"))
    found = found.select("query_id", "id", F.lit(1).alias("got"))
    both = exact.join(found, ["query_id", "id"], "full").na.fill(0)
    each = both.groupBy("query_id").agg(
        F.sum("got").alias("rows"), F.sum(F.col("got") * F.col("wanted")).alias("hits")
    )
    return each.agg(
        F.count("*").alias("queries"),
        F.min("rows").alias("least_rows"),
        (F.sum("hits") >= F.count("*") * 5 * 0.9).alias("recall_reached"),
    )


@query
def knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours of every vector among all vectors, lists out of reach left out."""
    stored = vectors(spark, sf_dir)
    return shown(neighbours.top_k_pruned(stored.withColumnRenamed("id", "query_id"), stored))


@query
def knn_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours of every vector, compared by codes of a byte for four dimensions."""
    stored = vectors(spark, sf_dir)
    return shown(compressed.top_k_compressed(stored.withColumnRenamed("id", "query_id"), stored))


@query
def knn_compressed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the codes find, and whether less than a tenth of the vectors were compared."""
    stored = vectors(spark, sf_dir).select("id", "vector")
    asked = stored.withColumnRenamed("id", "query_id")
    found = stage(compressed.top_k_compressed(asked, stored), "found")
    compared = found.agg(F.max("compared").alias("compared"))  # one row, as all that follow
    rows = stored.agg(F.count("*").alias("rows"))
    share = (F.col("compared") < 0.1 * F.col("rows")).alias("few_compared")
    return recall_of(asked, stored, found).join(compared).join(rows).select(
        "queries", "least_rows", "recall_reached", share
    )


@query_named("section_title")
def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", section_title(F.col("text")).alias("section")
    )


@query_named("key_phrases")
def key_phrase_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key phrases of every document, one row each."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(key_phrases(F.col("text"))).alias("position", "phrase")
    )


def label_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = corpus(spark, sf_dir).withColumnRenamed("doc_id", "id")
    return citations.citations(label_neighbours(spark, sf_dir), documents)


@query_named("citations")
def citation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(label_citations(spark, sf_dir))


@query
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.context_text(label_citations(spark, sf_dir))


@query
def reference_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.reference_section(label_citations(spark, sf_dir))


def benchmark_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as citations: five to a query, in the order of their ids."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(
        F.expr("item_id div 5").alias("query_id"),
        (F.col("item_id") % 5 * 10).cast("int").alias("rank"),
        F.lit("benchmark.txt").alias("source_filename"),
        F.col("item_id").cast("string").alias("page"),
        section_title(F.col("text")).alias("section"),
        F.col("text").alias("content"),
    )


def document_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the response to one of the queries of the benchmark items."""
    lists = table(spark, sf_dir, "benchmark").agg(F.expr("max(item_id) div 5 + 1").alias("lists"))
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.crossJoin(F.broadcast(lists)).select(  # lists is one row
        F.col("doc_id").alias("response_id"), F.expr("doc_id % lists").alias("query_id"), "text"
    )


@query
def citation_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses, cited = document_responses(spark, sf_dir), benchmark_citations(spark, sf_dir)
    return citations.citation_attribution(responses, cited)


@query
def citation_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses, cited = document_responses(spark, sf_dir), benchmark_citations(spark, sf_dir)
    return citations.citation_markup(responses, cited)


@query
def answer_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers to the label queries, completed with their references.

    By turn, an answer names the title of the first passage, carries markers of its own,
    quotes a phrase of the second passage, or does neither. Two of twelve queries have no
    citations.
    """
    cited = stage(label_citations(spark, sf_dir), "cited")
    first = cited.where("rank = 1").select("query_id", F.col("section").alias("title"))
    second = cited.where("rank = 2").select(
        "query_id", F.get(key_phrases(F.col("content")), F.lit(0)).alias("phrase")
    )
    named = F.coalesce("title", F.lit(""))
    quoted = F.coalesce("phrase", F.lit(""))
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    answers = (
        turns.withColumn("query_id", F.col("conv_id") % 12)
        .join(first, "query_id", "left")
        .join(second, "query_id", "left")
    )
    kind = F.col("turn") % 4
    text = (
        F.when(kind == 0, F.concat("text", F.lit(" "), named, F.lit(" again "), named))
        .when(kind == 1, F.concat("text", F.lit(" [7] and [3], [7]")))
        .when(kind == 2, F.concat(quoted, F.lit(". "), "text"))
        .otherwise(F.col("text"))
    )
    responses = answers.select(
        F.concat_ws("/", "conv_id", "turn").alias("response_id"), "query_id", text.alias("text")
    )
    return citations.answer_finish(responses, cited)


@query
def citation_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers ending in three markers, numbered anew for two citations."""
    number = F.concat(F.lit("["), (F.col("turn") + 2).cast("string"), F.lit("]"))
    answers = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    marked = F.concat("text", F.lit(" "), number, F.lit(" and [1] and "), number)
    return answers.select(
        "conv_id", "turn", citations.renumber_markers(marked, F.lit(2)).alias("text")
    )


@query
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers citing the turn before them and the first turn; user turns can be cited."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where(F.col("role") == "assistant").select(
        F.concat_ws("/", "conv_id", "turn").alias("response_id"),
        F.col("conv_id").alias("query_id"),
        F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("] and [1]")).alias("text"),
    )
    users = turns.where(F.col("role") == "user")
    cited = users.select(
        F.col("conv_id").alias("query_id"),
        (F.col("turn") + 1).alias("n"),
        F.lit("conversations").alias("source"),
        F.col("turn").cast("string").alias("page"),
        F.col("text").alias("content"),
        section_title(F.col("text")).alias("section"),
    )
    return citations.citation_resolve(answers, cited)


@query
def prompt_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for every user turn, with passages from the document corpus."""
    chunks, model = corpus_plans.ingest(corpus(spark, sf_dir))
    users = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    questions = users.select(
        F.concat_ws("/", "conv_id", "turn").alias("query_id"), F.col("text").alias("question")
    )
    return corpus_plans.prompts_for(questions, chunks, model)


@query
def prompt_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of a prompt for every user turn, with the profile of the customers.

    Passages are those of the label that the conversation's number names; two of twelve
    have none.
    """
    profile = TableProfile(table(spark, sf_dir, "customer"), with_accuracy=False)
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    contexts = stage(citations.context_text(label_citations(spark, sf_dir)), "contexts")
    asked = users.select(
        F.concat_ws("/", "conv_id", "turn").alias("query_id"),
        F.col("text").alias("question"),
        (F.col("conv_id") % 12).alias("label"),
    )
    own = asked.join(contexts.withColumnRenamed("query_id", "label"), "label")
    prompts = prompts_of(
        asked.select("query_id", "question"),
        own.select("query_id", "context"),
        shown(
            profile.privacy_summary(), "overall_privacy_score", "high_risk_columns", "high_risk_count"
        ),
        shown(profile.quality_summary(), "completeness", "validity", "overall_quality_score"),
    )
    return prompts.select(
        "query_id", F.posexplode("messages").alias("position", "message")
    ).select("query_id", "position", "message.role", "message.content")


@query
def chunk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to hold for the recursive chunks of every document and their vectors."""
    documents = corpus(spark, sf_dir)
    chunks, _ = corpus_plans.ingest(documents)
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    whole = documents.select("doc_id", F.col("text").alias("whole"))
    each = chunks.join(whole, "doc_id").select(
        "doc_id",
        (F.length("text") <= 1000).alias("short"),
        F.contains("whole", "text").alias("inside"),
        ((F.abs(norm - 1) < 1e-5) | (norm == 0)).alias("unit"),
        words.alias("words"),
    )
    found = each.groupBy("doc_id").agg(
        F.bool_and("short").alias("all_short"),
        F.bool_and("inside").alias("all_inside"),
        F.bool_and("unit").alias("all_unit"),
        F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"),
    )
    every = documents.select("doc_id", words.alias("wanted"))
    return found.join(every, "doc_id").select(
        "doc_id",
        "all_short",
        "all_inside",
        "all_unit",
        (F.size(F.array_except("wanted", "words")) == 0).alias("all_words"),
    )


@query
def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON report says, but for what depends on the outlier model."""
    report = json_report(spark, sf_dir)

    def field(path: str, kind: str) -> Column:
        return F.get_json_object("report", f"$.{path}").cast(kind).alias(path.split(".")[-1])

    return shown(
        report.select(
            field("report_type", "string"),
            field("timestamp", "string"),
            field("dataset.name", "string"),
            field("dataset.num_rows", "bigint"),
            field("dataset.num_columns", "int"),
            *[field(f"privacy_analysis.{n}", "double") for n in REPORTED_PRIVACY],
            *[field(f"quality_analysis.{n}", "double") for n in REPORTED_QUALITY],
            field("quality_analysis.duplicate_rows", "bigint"),
        )
    )


REPORTED_PRIVACY = ("overall_privacy_score", "avg_shannon_entropy", "avg_hartley_measure")
REPORTED_QUALITY = ("completeness", "validity", "uniqueness", "integrity", "consistency")


@query
def accuracy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to hold for the outliers of every column of the orders."""
    df = table(spark, sf_dir, "orders")
    numeric = F.col("column_name").isin([f.name for f in fields_of(df) if f.is_numeric])
    rows = df.agg(F.count("*").alias("num_rows"))
    return outliers(df).crossJoin(F.broadcast(rows)).select(  # rows is one row
        "column_name",
        "num_rows",
        (numeric | (F.col("outlier_count") == 0)).alias("only_numeric"),
        (F.col("outlier_count") <= F.ceil(F.col("num_rows") * 0.1)).alias("at_most_a_tenth"),
        (F.abs(F.col("outlier_percentage") + F.col("accuracy_score") - 1) < 1e-9).alias("adds_up"),
    )


# --- interactions and streams ----------------------------------------------------------------


def as_feedback(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("message_id"), F.col("event_type").alias("feedback"), "ts", "event_id"
    )


def feedback_columns(latest: DataFrame) -> DataFrame:
    return latest.select("message_id", "feedback", F.col("ts").cast("string").alias("ts"))


@query
def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = as_feedback(table(spark, sf_dir, "events"))
    return feedback_columns(interactions.feedback_latest(events))


@query
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History put together from the user turns and all other turns."""
    turns = table(spark, sf_dir, "conversations")
    users = turns.where(F.col("role") == "user")
    return interactions.chat_history(users, turns.where(F.col("role") != "user"))


@query
def chat_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with one exchange appended: its first question asked again."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("asked"))
    exchanges = first.select(
        "conv_id",
        F.concat(F.lit("Again: "), "asked").alias("question"),
        F.concat(F.lit("As said: "), F.left("asked", F.lit(20))).alias("answer"),
    )
    return interactions.append_turns(turns, exchanges)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # as a glob the path may be a single file as well as a folder of files
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


@query
def stream_value_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint, stream = new_path(spark, "stream"), event_stream(spark, sf_dir)
    state.stream_value_frequencies(stream, checkpoint).awaitTermination()
    counts = state.current_frequencies(spark, fields_of(stream), checkpoint)
    return counts.select("column_name", "value", "freq")


@query
def stream_entropy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The information measures of a stream's columns, from its state."""
    checkpoint, stream = new_path(spark, "stream"), event_stream(spark, sf_dir)
    state.stream_value_frequencies(stream, checkpoint, digest_text=True).awaitTermination()
    metrics = privacy.with_entropy(state.current_metrics(spark, fields_of(stream), checkpoint))
    return shown(metrics, "column_name", "privacy_factor", "shannon_entropy", "hartley_measure")


@query
def stream_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint = new_path(spark, "stream")
    state.stream_feedback(as_feedback(event_stream(spark, sf_dir)), checkpoint).awaitTermination()
    return feedback_columns(state.current_feedback(spark, checkpoint))


def window_columns(found: DataFrame, key: str) -> DataFrame:
    times = [F.col(end).cast("string").alias(f"{end}_time") for end in ("from", "until")]
    return shown(found.select(*times, F.col("key").alias(key), *windows.MEASURES.names))


def streamed_windows(spark: SparkSession, sf_dir: str, key: str, **period: str) -> DataFrame:
    path, checkpoint = new_path(spark, "windows"), new_path(spark, "stream")
    stream = event_stream(spark, sf_dir)
    windows.stream_windows(
        stream, "ts", key, "value", path, checkpoint, delay="1 hour", **period
    ).awaitTermination()
    return window_columns(windows.current_windows(spark, path, checkpoint), key)


@query
def stream_hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every type per hour, closed and open hours together."""
    return streamed_windows(spark, sf_dir, "event_type", width="1 hour")


@query
def stream_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every user; one ends half an hour after its last event."""
    return streamed_windows(spark, sf_dir, "user_id", gap="30 minutes")


@query
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions from the table at rest."""
    events = table(spark, sf_dir, "events")
    found = windows.windowed(events, "ts", "user_id", "value", gap="30 minutes")
    return window_columns(found, "user_id")
