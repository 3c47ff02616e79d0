"""Which columns together tell rows apart: smallest sets that break k-anonymity.

A set of columns is k-anonymous if every combination of its values that occurs is shared
by at least ``k`` rows. More columns only split groups, so every superset of a set that
isn't k-anonymous isn't either: sets are tried level by level, and one is counted only if
all its subsets passed. The first level is one count per column. The columns that pass
it are grouped together once, and the higher levels count the groups of that table, or of one of
those that lack a column of many values and so are much shorter.
Driver and plan hold sets of columns, never values.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprobe.functions.types import fields_of, per_field
from colprobe.operators.frequencies import frequency_counts
from colprobe.session import stage

# Sets counted by one scan.
SETS_AT_ONCE = 50
# Tables without a column, at most, and how much shorter than the whole one they have to be.
SHORTER_TABLES = 4
SHORTER = 4

Set = tuple[int, ...]


def _smallest(groups: DataFrame, k: int) -> list:
    """Per set, its groups, the rows of the smallest one and those of all below ``k``."""
    small = F.when(F.col("freq") < k, F.col("freq"))
    return (
        groups.groupBy("set_ix")
        .agg(
            F.count("*").alias("groups"),
            F.min("freq").alias("smallest_group"),
            F.coalesce(F.sum(small), F.lit(0)).alias("rows_below"),
        )
        .collect()  # as many rows as there are sets
    )


def _shorter(table: DataFrame, names: dict[int, str], values: dict[int, int]) -> list[tuple[frozenset, DataFrame]]:
    """(columns, table) with ``table`` last, shorter ones without a column before it.

    ``values`` are the numbers of values of the columns; their product bounds a table's rows.
    """
    whole, rows = frozenset(names), table.count()
    bounds = {ix: prod(values[other] for other in names if other != ix) for ix in names}
    found = []
    for ix in sorted(names, key=bounds.get)[:SHORTER_TABLES]:
        if len(names) > 2 and bounds[ix] * SHORTER <= rows:
            kept = [name for other, name in names.items() if other != ix]
            grouped = table.groupBy(*kept).agg(F.sum("freq").alias("freq"))
            found.append((whole - {ix}, stage(grouped, "combinations")))
    return [*found, (whole, table)]


def _level(tables: list[tuple[frozenset, DataFrame]], sets: list[Set], names: dict[int, str]) -> DataFrame:
    """``_groups`` of all sets, each counted in the first table that has its columns."""
    own: dict[int, list[int]] = {}
    for place, chosen in enumerate(sets):
        first = next(n for n, (columns, _) in enumerate(tables) if columns.issuperset(chosen))
        own.setdefault(first, []).append(place)
    return reduce(
        DataFrame.unionByName,
        [_groups(tables[n][1], "freq", [sets[p] for p in places], names, places) for n, places in own.items()],
    )


def _groups(
    table: DataFrame, freq: str, sets: list[Set], names: dict[int, str], places: list[int]
) -> DataFrame:
    """(set_ix, freq), one row per set and combination of its values; ``places`` are the set_ix."""
    parts = []
    for first in range(0, len(sets), SETS_AT_ONCE):
        some = sets[first : first + SETS_AT_ONCE]
        used = sorted({ix for chosen in some for ix in chosen})
        # the grouping id has a bit for every column that a set leaves out, the first one highest
        ids = [sum(1 << (len(used) - 1 - i) for i, ix in enumerate(used) if ix not in s) for s in some]
        place = F.create_map(*[F.lit(n) for i, bits in enumerate(ids) for n in (bits, places[first + i])])
        grouped = table.groupingSets(
            [[F.col(names[ix]) for ix in chosen] for chosen in some], *[names[ix] for ix in used]
        ).agg(F.sum(freq).alias("freq"), F.grouping_id().cast("int").alias("left_out"))
        parts.append(grouped.select(place[F.col("left_out")].alias("set_ix"), "freq"))
    return reduce(DataFrame.unionByName, parts)


def identifying_sets(
    df: DataFrame, k: int = 5, columns: list[str] | None = None, max_columns: int = 3
) -> DataFrame:
    """(columns, size, smallest_group, rows_below): the smallest sets that aren't k-anonymous.

    Missing cells count as one value. ``rows_below`` are the rows in groups of fewer than
    ``k``. Sets of more than ``max_columns`` columns aren't tried. An empty table has none.
    """
    if k < 2 or max_columns < 1:
        raise ValueError("k has to be 2 or more and sets have at least one column")
    spark = df.sparkSession
    fields = {f.ix: f for f in fields_of(df, columns)}
    if not fields:
        raise ValueError("no column to try")
    found: list[tuple[str, int, int, int]] = []

    def passing(sets: list[Set], rows: list) -> list[Set]:
        """Report the sets that fail, return those that pass."""
        failed = set()
        for row in rows:
            if row["smallest_group"] < k:
                chosen = sets[row["set_ix"]]
                failed.add(chosen)
                names = ", ".join(fields[ix].name for ix in chosen)
                found.append((names, len(chosen), row["smallest_group"], row["rows_below"]))
        return [chosen for chosen in sets if chosen not in failed]

    counts = frequency_counts(df, columns).where("freq > 0")
    place = per_field(list(fields.values()), list(fields.values()).index)
    single = [(ix,) for ix in fields]
    alone = _smallest(counts.select(place.alias("set_ix"), "freq"), k)
    passed = passing(single, alone)
    if len(passed) > 1 and max_columns > 1:
        kept = [ix for (ix,) in passed]
        names = {ix: f"c{ix}" for ix in kept}
        cells = df.selectExpr(*[f"{fields[ix].cell} AS {names[ix]}" for ix in kept])
        grouped = cells.groupBy(*names.values()).agg(F.count(F.lit(1)).alias("freq"))
        values = dict.fromkeys(kept, 1) | {single[row["set_ix"]][0]: row["groups"] for row in alone}
        tables = _shorter(stage(grouped, "combinations"), names, values)
        for size in range(2, max_columns + 1):
            known = set(passed)
            sets = [
                chosen
                for chosen in combinations(sorted({ix for some in passed for ix in some}), size)
                if all(subset in known for subset in combinations(chosen, size - 1))
            ]
            if not sets:
                break
            passed = passing(sets, _smallest(_level(tables, sets, names), k))
    return spark.createDataFrame(
        found, "columns string, size int, smallest_group bigint, rows_below bigint"
    )
