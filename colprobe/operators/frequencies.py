"""Value-frequency tables: the shared state behind most column metrics.

A frequency table has one row per (column, value) with the number of rows holding
the value. Columns of one data type are unfolded together and counted under their
own type, so numbers are grouped as numbers and only the few distinct results are
ever turned into text. Map-side partial counts collapse hot values before the
shuffle. Long strings travel as SHA-256 digests whenever the values themselves are
not asked for: the metrics need equality only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprobe.functions.types import (
    INTEGRAL,
    Field,
    fields_of,
    per_field,
    sql_name,
)

# Text up to this many characters is its own grouping key. A digest with its prefix
# is longer, so a digest can never equal a plain key.
LONGEST_PLAIN_KEY = 64
DIGEST_PREFIX = "sha256:"
# Columns unfolded by one scan; more would outgrow generated code.
COLUMNS_AT_ONCE = 100


def text_key(text: str) -> str:
    """SQL for a bounded-width stand-in of a string that preserves equality."""
    digest = f"concat('{DIGEST_PREFIX}', sha2({text}, 256))"
    return f"CASE WHEN length({text}) > {LONGEST_PLAIN_KEY} THEN {digest} ELSE {text} END"


def _counted_as(field: Field) -> str:
    if isinstance(field.dtype, INTEGRAL):
        return "bigint"
    return "string" if field.type_class in ("string", "other") else field.dtype.simpleString()


def _families(fields: list[Field]) -> list[tuple[str, list[Field]]]:
    """Fields grouped by the type their values are counted under."""
    families: dict[str, list[Field]] = {}
    for field in fields:
        families.setdefault(f"{_counted_as(field)}|{field.type_class}", []).append(field)
    return [
        (key.split("|")[0], members[start : start + COLUMNS_AT_ONCE])
        for key, members in families.items()
        for start in range(0, len(members), COLUMNS_AT_ONCE)
    ]


def unfold(df: DataFrame, counted_as: str, members: list[Field], cell) -> DataFrame:
    """(column_ix, value) rows for columns of one family; one scan of just these columns."""
    pairs = ", ".join(f"{f.ix}, CAST({cell(f)} AS {counted_as})" for f in members)
    return df.selectExpr(f"stack({len(members)}, {pairs}) AS (column_ix, value)")


def text_cells(df: DataFrame, fields: list[Field], digest_text: bool = False) -> DataFrame:
    """(column_ix, value) rows with the values as ``value_frequencies`` shows them.

    All types side by side, for sources that should be read once, such as streams.
    """

    def shown(field: Field) -> str:
        cell = _binary_as_text(field)
        if digest_text and _counted_as(field) == "string":
            cell = text_key(cell)
        return cell if _counted_as(field) == "string" else f"CAST({cell} AS {_counted_as(field)})"

    groups = [fields[i : i + COLUMNS_AT_ONCE] for i in range(0, len(fields), COLUMNS_AT_ONCE)]
    return reduce(DataFrame.unionByName, [unfold(df, "string", some, shown) for some in groups])


def typed_cells(df: DataFrame, fields: list[Field]):
    """One (members, cells) pair per type family: (column_ix, value), long texts as digests."""
    for counted_as, members in _families(fields):
        is_text = counted_as == "string"

        def cell(field: Field, is_text: bool = is_text) -> str:
            value = _binary_as_text(field)
            return text_key(value) if is_text else value

        yield members, unfold(df, counted_as, members, cell)


def _counted(
    df: DataFrame, fields: list[Field], digest_text: bool, unique: tuple[str, ...] = ()
):
    """One (members, counts) pair per type family, values still in their own type."""
    keys = [f for f in fields if f.name in unique]
    others = [f for f in fields if f.name not in unique]
    families = [(*family, True) for family in _families(keys)]
    families += [(*family, False) for family in _families(others)]
    for counted_as, members, all_differ in families:
        by_digest = digest_text and counted_as == "string"

        def cell(field: Field) -> str:
            if field.dtype.simpleString() == "binary":
                return _binary_as_text(field)
            return text_key(field.cell) if by_digest else field.cell

        cells = unfold(df, counted_as, members, cell)
        once = F.lit(1).cast("bigint").alias("freq")
        if all_differ:
            present = cells.where(F.col("value").isNotNull()).select("column_ix", "value", once)
            cells = cells.where(F.col("value").isNull())
        counts = cells.groupBy("column_ix", "value").agg(F.count(F.lit(1)).alias("freq"))
        yield members, counts.unionByName(present) if all_differ else counts


def value_frequencies(
    df: DataFrame, columns: list[str] | None = None, digest_text: bool = False
) -> DataFrame:
    """(column_ix, column_name, value, freq); the missing group has value NULL."""
    fields = fields_of(df, columns)
    parts = [
        counts.select("column_ix", F.col("value").cast("string").alias("value"), "freq")
        for _, counts in _counted(df, fields, digest_text)
    ]
    name = per_field(fields, lambda f: f.name)
    return reduce(DataFrame.unionByName, parts).select(
        "column_ix", name.alias("column_name"), "value", "freq"
    )


def frequency_counts(
    df: DataFrame, columns: list[str] | None = None, unique_columns: tuple[str, ...] = ()
) -> DataFrame:
    """(column_ix, missing, number, freq): the frequency table without its texts.

    ``number`` is the value of a numeric column. The values of ``unique_columns`` are
    declared to differ from row to row and are not shuffled to be counted. Every column contributes one extra row
    of frequency 0, so a column of an empty table still gets its metrics row without a
    join against the schema.
    """
    fields = fields_of(df, columns)
    parts = []
    for members, counts in _counted(df, fields, digest_text=True, unique=tuple(unique_columns)):
        value = F.col("value")
        number = F.lit(None)
        if members[0].is_numeric:
            number = value.cast("int") if members[0].is_boolean else value
        parts.append(
            counts.select(
                "column_ix",
                value.isNull().alias("missing"),
                number.cast("double").alias("number"),
                "freq",
            )
        )
    return reduce(DataFrame.unionByName, [*parts, _seed_rows(df, fields)])


def _seed_rows(df: DataFrame, fields: list[Field]) -> DataFrame:
    positions = F.array(*[F.lit(f.ix) for f in fields])
    return df.sparkSession.range(1).select(
        F.explode(positions).alias("column_ix"),
        F.lit(True).alias("missing"),
        F.lit(None).cast("double").alias("number"),
        F.lit(0).cast("bigint").alias("freq"),
    )


def frequency_metrics(
    df: DataFrame, columns: list[str] | None = None, unique_columns: tuple[str, ...] = ()
) -> DataFrame:
    """Everything about a column that follows from its frequencies, in one aggregation.

    The missing group is a value of its own for the privacy factor and the entropy of
    numeric and datetime columns, and is ignored for all other purposes. The entropy
    is always relative to all rows.
    """
    fields = fields_of(df, columns)
    if not fields:
        raise ValueError("no column to profile")
    return metrics_from_counts(frequency_counts(df, columns, unique_columns), fields)


def approximate_distinct_counts(
    df: DataFrame, columns: list[str] | None = None, error: float = 0.02
) -> DataFrame:
    """(column_ix, column_name, distinct_count) from sketches, without a shuffle of values.

    For tables so large that exact counts are not worth their shuffle.
    """
    fields = fields_of(df, columns)

    # a sketch per group: side by side in one row, those of many columns would outgrow
    # generated code
    parts = [
        unfold(df, "bigint", fields[start : start + COLUMNS_AT_ONCE], hashed_cell)
        for start in range(0, len(fields), COLUMNS_AT_ONCE)
    ]
    seeds = _seed_rows(df, fields).select("column_ix", F.lit(None).cast("bigint").alias("value"))
    parts.append(seeds)
    cells = reduce(DataFrame.unionByName, parts)
    return cells.groupBy("column_ix").agg(
        F.approx_count_distinct("value", error).alias("distinct_count")
    ).select("column_ix", per_field(fields, lambda f: f.name).alias("column_name"), "distinct_count")


def metrics_from_counts(
    counts: DataFrame, fields: list[Field], drawn: Column | None = None
) -> DataFrame:
    """Frequency metrics; with ``drawn``, its non-NULL values are gathered per column.

    Whatever is drawn has to be a sample of bounded size.
    """
    freq = F.col("freq")
    missing_is_value = per_field(fields, lambda f: f.type_class in ("numeric", "datetime"))
    seen = freq > 0
    present = seen & ~F.col("missing")
    counted = seen & (~F.col("missing") | missing_is_value)
    totals = counts.groupBy("column_ix").agg(
        F.sum("freq").alias("total_count"),
        F.coalesce(F.sum(F.when(F.col("missing"), freq)), F.lit(0)).alias("missing_count"),
        F.count_if(present).alias("distinct_count"),
        F.coalesce(F.sum(F.when(present, freq - 1)), F.lit(0)).alias("duplicate_count"),
        F.avg(F.when(counted, 1 - 1 / freq)).alias("mean_factor"),
        F.count_if(counted).alias("groups"),
        F.sum(F.when(counted, freq)).alias("counted_rows"),
        F.sum(F.when(counted, freq * F.log2(freq))).alias("weighted_log"),
        *([] if drawn is None else [F.collect_list(drawn).alias("sample")]),
    )
    rows = F.col("total_count")
    all_missing = rows == F.col("missing_count")
    # sum of -(f/N) log2(f/N), expanded so that N is not needed before the aggregation
    entropy = (F.col("counted_rows") * F.log2(rows) - F.col("weighted_log")) / rows
    one_value = (F.col("groups") == 1) & (F.col("counted_rows") == rows)
    return totals.select(
        "column_ix",
        per_field(fields, lambda f: f.name).alias("column_name"),
        "total_count",
        "missing_count",
        (rows - F.col("missing_count")).alias("value_count"),
        "distinct_count",
        "duplicate_count",
        F.when(all_missing, F.lit(1.0)).otherwise(F.col("mean_factor")).alias("privacy_factor"),
        F.when(all_missing | one_value, F.lit(0.0))
        .otherwise(F.greatest(entropy, F.lit(0.0)))
        .alias("shannon_entropy"),
        *([] if drawn is None else ["sample"]),
    )


def row_digest(fields: list[Field]) -> str:
    """SQL for a 256-bit stand-in of a row: cells with their lengths, NULL apart from any text."""
    cells = [
        f"CASE WHEN {text} IS NULL THEN '-' ELSE concat(length({text}), ':', {text}) END"
        for text in (f"CAST({_binary_as_text(f)} AS STRING)" for f in fields)
    ]
    return f"unhex(sha2(concat({', '.join(cells)}), 256))"


def _binary_as_text(field: Field) -> str:
    binary = field.dtype.simpleString() == "binary"
    return f"hex({sql_name(field.name)})" if binary else field.cell


def hashed_cell(field: Field) -> str:
    """SQL for a 64-bit hash of a cell, NULL if it is missing."""
    cell = _binary_as_text(field)
    return f"CASE WHEN {cell} IS NOT NULL THEN xxhash64({cell}) END"


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: (row_count, duplicate_rows), counting every repeat after the first.

    Rows are compared by their digests, so the shuffle does not grow with the columns.
    """
    copies = df.selectExpr(f"{row_digest(fields_of(df))} AS digest").groupBy("digest").count()
    return copies.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"),
    )
