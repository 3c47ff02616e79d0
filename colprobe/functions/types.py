"""Type classes of columns and the one meaning of "missing" used everywhere.

Missing is NULL or NaN. Negative zero counts as zero. Nested values are compared
through their JSON text and belong to the class "other".

Expressions repeated for every column are written as SQL text: for wide tables that
keeps building a plan cheap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXT = (T.StringType, T.CharType, T.VarcharType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def sql_name(name: str) -> str:
    """Column by its exact name, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ref(name: str) -> Column:
    return F.col(sql_name(name))


@dataclass(frozen=True)
class Field:
    """One profiled column: its place in the schema, name and type."""

    ix: int
    name: str
    dtype: T.DataType

    @property
    def is_boolean(self) -> bool:
        return isinstance(self.dtype, T.BooleanType)

    @property
    def is_integral(self) -> bool:
        return isinstance(self.dtype, INTEGRAL) or self.is_boolean

    @property
    def is_numeric(self) -> bool:
        """Booleans score as the numbers 0 and 1."""
        return self.is_integral or isinstance(self.dtype, (*FRACTIONAL, T.DecimalType))

    @property
    def is_datetime(self) -> bool:
        return isinstance(self.dtype, DATETIME)

    @property
    def is_string(self) -> bool:
        return isinstance(self.dtype, TEXT)

    @property
    def type_class(self) -> str:
        if self.is_numeric:
            return "numeric"
        if self.is_datetime:
            return "datetime"
        return "string" if self.is_string else "other"

    @property
    def cell(self) -> str:
        """SQL for the cell value with every kind of missing mapped to NULL."""
        name = sql_name(self.name)
        if isinstance(self.dtype, FRACTIONAL):
            # adding zero turns -0.0 into 0.0
            zero = f"CAST(0 AS {self.dtype.simpleString()})"
            return f"CASE WHEN NOT isnan({name}) THEN {name} + {zero} END"
        if isinstance(self.dtype, NESTED):
            return f"CASE WHEN {name} IS NOT NULL THEN to_json(named_struct('v', {name})) END"
        return name

    @property
    def number_cell(self) -> str:
        """SQL for the cell as a DOUBLE (numeric columns only)."""
        inner = f"CAST({sql_name(self.name)} AS INT)" if self.is_boolean else self.cell
        return f"CAST({inner} AS DOUBLE)"

    @property
    def cell_is_text(self) -> bool:
        return self.is_string or isinstance(self.dtype, NESTED)

    def clean(self) -> Column:
        return F.expr(self.cell)

    def number(self) -> Column:
        return F.expr(self.number_cell)


def fields_of(df: DataFrame, columns: list[str] | None = None) -> list[Field]:
    """Fields in schema order; ``columns`` restricts the list, unknown names are ignored."""
    wanted = None if columns is None else set(columns)
    return [
        Field(ix, f.name, f.dataType)
        for ix, f in enumerate(df.schema.fields)
        if wanted is None or f.name in wanted
    ]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return sql_text(value)
    return f"{value!r}D" if isinstance(value, float) else str(value)


def per_field(fields: list[Field], value) -> Column:
    """A per-column constant, looked up by the ``column_ix`` of the row."""
    table = {f.ix: value(f) for f in fields}
    width = max(table, default=-1) + 1
    return F.expr(f"get(array({', '.join(_literal(table.get(i)) for i in range(width))}), column_ix)")


# Whole-stage code generation gives up beyond 100 fields (spark.sql.codegen.maxFields).
LARGEST_AGGREGATE = 96


def in_passes(planned: list, width) -> list[list]:
    """Items cut into passes whose aggregates, ``width`` of each item, stay small."""
    passes, size = [[]], 0
    for item in planned:
        own = width(item)
        if passes[-1] and size + own > LARGEST_AGGREGATE:
            passes.append([])
            size = 0
        passes[-1].append(item)
        size += own
    return passes
