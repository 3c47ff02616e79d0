"""Loading flat tables: delimited text with inferred types, or Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprobe.functions.types import Field, fields_of, in_passes, ref

# Cell texts that mean "missing".
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# Column names whose texts are read as points in time when all of them are.
TIME_NAMES = ("date", "modified")
TIME_ENDINGS = ("_at", "_time")
TIME_BEGINNINGS = ("timestamp",)

_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_DECIMAL = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?)\s*$"
_BOOLEAN = ("True", "TRUE", "true", "False", "FALSE", "false")


def load_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Load a table by format, taken from the file ending if not given."""
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt == "csv":
        return load_delimited(spark, path, schema=schema)
    if fmt == "parquet":
        return normalize(spark.read.parquet(path))
    raise ValueError(f"unsupported table format: {fmt}")


def load_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    separator: str = ",",
    multiline: bool = False,
) -> DataFrame:
    """Read delimited text with a header line.

    Cells are read as text, missing tokens become NULL, and one aggregation over the
    file settles the column types. A declared ``schema`` saves that pass. Quoted line
    breaks need ``multiline``, which keeps a file from being split between tasks.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
    )
    texts = reader.csv(path)
    texts = texts.select(*[_token_to_null(ref(c)).alias(c) for c in texts.columns])
    types = {f.name: f.dataType for f in schema.fields} if schema else infer_types(texts)
    return texts.select(*[_converted(c, types[c]).alias(c) for c in texts.columns])


def _token_to_null(text: Column) -> Column:
    return F.when(~text.isin(*MISSING_TOKENS), text)


def _converted(name: str, dtype: T.DataType) -> Column:
    text = ref(name)
    if isinstance(dtype, T.StringType):
        return text
    return F.trim(text).try_cast(dtype)


def _names_a_time(name: str) -> bool:
    lowered = name.lower()
    return (
        lowered in TIME_NAMES
        or lowered.endswith(TIME_ENDINGS)
        or lowered.startswith(TIME_BEGINNINGS)
    )


def infer_types(texts: DataFrame) -> dict[str, T.DataType]:
    """Narrowest type all present cells of each column agree on.

    One aggregation, or as many as a wide table needs, each over columns of its own.
    """
    counts: dict[str, int] = {}
    for part in in_passes(fields_of(texts), lambda field: 5):
        counts |= texts.agg(*_type_tests(part)).first().asDict()
    found = {}
    for field in fields_of(texts):
        present = counts[f"n{field.ix}"]

        def all_are(key: str, ix: int = field.ix, present: int = present) -> bool:
            return present > 0 and counts.get(f"{key}{ix}") == present

        if all_are("w"):
            found[field.name] = T.LongType()
        elif all_are("d") or present == 0:
            found[field.name] = T.DoubleType()
        elif all_are("b"):
            found[field.name] = T.BooleanType()
        elif all_are("t"):
            found[field.name] = T.TimestampNTZType()
        else:
            found[field.name] = T.StringType()
    return found


def _type_tests(fields: list[Field]) -> list[Column]:
    aggregates = []
    for field in fields:
        cell = ref(field.name)
        whole = cell.rlike(_WHOLE) & F.trim(cell).try_cast("bigint").isNotNull()
        tests = {
            "n": cell.isNotNull(),
            "w": whole,
            "d": cell.rlike(_DECIMAL),
            "b": cell.isin(*_BOOLEAN),
        }
        if _names_a_time(field.name):
            tests["t"] = cell.try_cast("timestamp_ntz").isNotNull()
        aggregates += [F.count_if(test).alias(f"{key}{field.ix}") for key, test in tests.items()]
    return aggregates


def normalize(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, negative zero becomes zero, nested columns become JSON text."""
    return df.select(*[f.clean().alias(f.name) for f in fields_of(df)])


def dataset_overview(df: DataFrame) -> DataFrame:
    """One row: number of rows, number of columns and the column names."""
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        "num_rows",
        F.lit(len(df.columns)).alias("num_columns"),
        F.lit(", ".join(df.columns)).alias("column_names"),
    )
