"""Isolation-forest outliers per numeric column (Liu, Ting and Zhou, 2008).

In one dimension the forest's mean path length is a step function of the value. Each
column's forest is grown in one task from a sample of bounded size and kept as sorted
breakpoints with a score per step. Every row enters every tree with the same probability,
whatever the number of rows: the entries of a value are one binomial draw driven by a
hash of the value, so neither row order nor partitioning influence them.
Scoring counts the rows per step; columns with many repeats are reduced to their
frequencies first, the others are scored where they lie, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colprobe.functions.types import Field, fields_of, per_field
from colprobe.operators.frequencies import frequency_counts, unfold

# Forest settings.
CONTAMINATION = 0.1
SEED = 42
TREES = 100
TREE_SAMPLE = 256

# Columns whose step functions are shipped to the executors together (about 0.4 MB each).
COLUMNS_AT_ONCE = 64
# Of the sketch that brackets a median: its rank is off by at most rows / accuracy.
MEDIAN_ACCURACY = 10_000
# Cells that one task sorts for a median, and steps of the grid that narrows a wider bracket.
MEDIAN_ROWS, MEDIAN_GRID = 1_000_000, 200
# Rows per distinct value from which on counting values first pays for its shuffle.
REPEATS = 20


@dataclass(frozen=True)
class ColumnStats:
    rows: int
    missing: int
    low: float | None
    high: float | None

    @property
    def usable(self) -> bool:
        """Infinite values, like columns without any value, leave nothing to model."""
        return self.low is not None and math.isfinite(self.low) and math.isfinite(self.high)

@dataclass(frozen=True)
class Forest:
    """A column's step function: step ``i`` ends at breakpoint ``i``, inclusive."""

    breaks: np.ndarray
    scores: np.ndarray
    repeats: float  # estimated rows per distinct value


@dataclass(frozen=True)
class Prepared:
    """What has to be known about the numeric columns before sampling them."""

    fields: list[Field]
    stats: dict[int, ColumnStats]
    medians: dict[int, float]


# --- growing a forest ------------------------------------------------------------


def _average_path(size: int) -> float:
    """Mean depth of an unsuccessful search among ``size`` points."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1.0) + np.euler_gamma) - 2.0 * (size - 1.0) / size


def _grow_tree(points: np.ndarray, rng: np.random.Generator) -> tuple[list, list]:
    """Split positions and leaf path lengths of one random tree, left to right."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    splits, leaves = [], []
    todo = [(0, len(points), 0, None)]  # the last entry is the split just left of the node
    while todo:
        first, last, depth, left_edge = todo.pop()
        low, high = points[first], points[last - 1]
        if depth == limit or low == high:
            leaves.append(depth + _average_path(last - first))
            if left_edge is not None:
                splits.append(left_edge)
            continue
        split = rng.uniform(low, high)
        if split >= high:
            split = low
        middle = first + int(np.searchsorted(points[first:last], split, side="right"))
        todo.append((middle, last, depth + 1, split))
        todo.append((first, middle, depth + 1, left_edge))
    return splits, leaves


def grow_forest(samples: list[np.ndarray], size: int, seed) -> tuple[np.ndarray, np.ndarray]:
    """Breakpoints and anomaly scores: step ``i`` ends at breakpoint ``i``, inclusive.

    One tree grows from each of the sorted samples, which have ``size`` points expected.
    """
    rng = np.random.default_rng(seed)
    breaks, jumps, base = [], [], 0.0
    for drawn in samples:
        splits, leaves = _grow_tree(drawn, rng) if len(drawn) else ([], [0.0])
        breaks += splits
        jumps += list(np.diff(leaves))
        base += leaves[0]
    order = np.argsort(breaks, kind="stable")
    total = base + np.concatenate([[0.0], np.cumsum(np.asarray(jumps, dtype=float)[order])])
    normal = max(_average_path(size), 1.0)
    # rounding removes the summation noise that would break ties between equal steps
    scores = np.round(2.0 ** (-total / len(samples) / normal), 12)
    return np.asarray(breaks, dtype=float)[order], scores


def _copies(freq: np.ndarray, u: np.ndarray, p: float, seeds: np.ndarray) -> np.ndarray:
    """Binomial(freq, p) by inverting the distribution at ``1 - u``; at least one."""
    if p >= 1.0:
        return freq
    copies = np.ones(len(freq), dtype=np.int64)
    many = freq * p > 20
    for i in np.flatnonzero(many):
        drawn = np.random.default_rng(int(seeds[i]) & 0xFFFFFFFF).binomial(freq[i], p)
        copies[i] = max(drawn, 1)
    few = np.flatnonzero(~many & (freq > 1))
    n, target = freq[few].astype(float), 1.0 - u[few]
    mass = np.exp(n * np.log1p(-p))
    reached = mass.copy()
    count = np.zeros(len(few), dtype=np.int64)
    open_ = reached < target
    while open_.any():
        count[open_] += 1
        mass[open_] *= (n[open_] - count[open_] + 1) / count[open_] * (p / (1 - p))
        reached[open_] += mass[open_]
        open_ &= (reached < target) & (count < n)
    copies[few] = np.maximum(count, 1)
    return copies


def _forest_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """One column's sample to its step function and its rows per distinct value."""
    pdf = pdf.sort_values(["number", "seed"])
    rows, p = int(pdf["rows"].iloc[0]), float(pdf["p"].iloc[0])
    ix = int(pdf["column_ix"].iloc[0])
    freq, number = pdf["freq"].to_numpy(), pdf["number"].to_numpy(dtype=float)
    if p >= 1.0:  # every tree sees every row
        copies = freq
        samples = [np.repeat(number, freq)] * TREES
    else:
        copies = _copies(freq * TREES, pdf["u"].to_numpy(), p, pdf["seed"].to_numpy(dtype=np.int64))
        points = np.repeat(number, copies)
        tree = np.random.default_rng([SEED, ix, 1]).integers(0, TREES, len(points))
        samples = [points[tree == t] for t in range(TREES)]
    breaks, scores = grow_forest(samples, min(TREE_SAMPLE, rows), [SEED, ix])
    # summed over all rows, 1 / freq gives the number of distinct values
    repeats = 1.0 / np.average(1.0 / freq.astype(float), weights=copies)
    found = {"column_ix": [ix], "breaks": [breaks], "scores": [scores], "repeats": [repeats]}
    return pd.DataFrame(found)


# --- statistics ------------------------------------------------------------------


def column_stats(df: DataFrame, numeric: list[Field]) -> dict[int, ColumnStats]:
    """Row counts and value ranges; no shuffle of rows."""
    found = {}
    for start in range(0, len(numeric), COLUMNS_AT_ONCE):
        part = numeric[start : start + COLUMNS_AT_ONCE]
        aggregates = [F.count(F.lit(1)).alias("rows")]
        for f in part:
            aggregates += [
                F.count(f.number()).alias(f"n{f.ix}"),
                F.min(f.number()).alias(f"low{f.ix}"),
                F.max(f.number()).alias(f"high{f.ix}"),
            ]
        row = df.agg(*aggregates).first()
        for f in part:
            missing = row["rows"] - row[f"n{f.ix}"]
            found[f.ix] = ColumnStats(row["rows"], missing, row[f"low{f.ix}"], row[f"high{f.ix}"])
    return found


def exact_medians(cells: DataFrame, stats: dict[int, ColumnStats]) -> dict[int, float]:
    """Exact medians of columns of (column_ix, number) cells.

    A sketch with a known error gives two values with the median between them. Where
    more cells may lie between than one task should sort (MEDIAN_ROWS), the cells below
    are counted and a grid of quantiles of those between narrows the bracket, again and
    again. Then the few cells in between are counted by value, and the wanted ranks are
    found among them.
    """
    margin = 3.0 / MEDIAN_ACCURACY
    present = cells.where("number IS NOT NULL").select("column_ix", "number")
    around = F.percentile_approx("number", F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), F.lit(MEDIAN_ACCURACY))
    found = present.groupBy("column_ix").agg(around.alias("around")).collect()  # one row per column
    brackets = {r["column_ix"]: tuple(r["around"]) for r in found}
    held = {ix: s.rows - s.missing for ix, s in stats.items()}
    ranks = {ix: ((n - 1) // 2, n // 2) for ix, n in held.items()}
    between = {ix: math.ceil(n * 3 * margin) for ix, n in held.items()}
    while wide := [ix for ix, n in between.items() if n > MEDIAN_ROWS and brackets[ix][0] < brackets[ix][1]]:
        narrowed = _narrowed(present.where(F.col("column_ix").isin(wide)), brackets, ranks)
        if all(brackets[ix] == bracket for ix, (bracket, _) in narrowed.items()):
            break  # nearly all cells repeat the values at its ends
        for ix, (bracket, most) in narrowed.items():
            brackets[ix], between[ix] = bracket, most

    inner = F.when(F.col("number") >= F.col("low"), F.col("number"))
    counted = (
        _with_brackets(present, brackets)
        .where(F.col("number") <= F.col("high"))
        .groupBy("column_ix", inner.alias("number"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = [(ix, *pair) for ix, pair in ranks.items()]
    wanted = cells.sparkSession.createDataFrame(rows, "column_ix int, lower long, upper long")
    by_value = W.partitionBy("column_ix").orderBy(F.col("number").asc_nulls_first())
    through, before = F.sum("n").over(by_value), F.col("through") - F.col("n")
    at_ranks = (
        counted.withColumn("through", through)
        .join(F.broadcast(wanted), "column_ix")  # one row per column
        .select(
            "column_ix",
            F.when((before <= F.col("lower")) & (F.col("lower") < F.col("through")), F.col("number")).alias("a"),
            F.when((before <= F.col("upper")) & (F.col("upper") < F.col("through")), F.col("number")).alias("b"),
        )
        .groupBy("column_ix")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    return {r["column_ix"]: (r["a"] + r["b"]) / 2 for r in at_ranks.collect()}  # one row per column


def _with_brackets(present: DataFrame, brackets: dict[int, tuple[float, float]]) -> DataFrame:
    rows = [(ix, float(low), float(high)) for ix, (low, high) in brackets.items()]
    table = present.sparkSession.createDataFrame(rows, "column_ix int, low double, high double")
    return present.join(F.broadcast(table), "column_ix")  # one row per column


def _narrowed(
    present: DataFrame, brackets: dict[int, tuple[float, float]], ranks: dict[int, tuple[int, int]]
) -> dict[int, tuple[tuple[float, float], int]]:
    """Narrower brackets around the ranks, and the most distinct cells within."""
    inside = (F.col("number") >= F.col("low")) & (F.col("number") <= F.col("high"))
    grid = F.array(*[F.lit(n / MEDIAN_GRID) for n in range(MEDIAN_GRID + 1)])
    quantiles = F.percentile_approx(F.when(inside, F.col("number")), grid, F.lit(MEDIAN_ACCURACY))
    rows = _with_brackets(present, brackets).groupBy("column_ix").agg(
        F.count_if(F.col("number") < F.col("low")).alias("below"),
        F.count_if(inside).alias("inside"),
        quantiles.alias("grid"),
    )
    found = {}
    for r in rows.collect():  # one row per column
        lower, upper = ((rank - r["below"]) / r["inside"] * MEDIAN_GRID for rank in ranks[r["column_ix"]])
        first = r["grid"][max(math.floor(lower) - 1, 0)]
        last = r["grid"][min(math.ceil(upper) + 1, MEDIAN_GRID)]
        found[r["column_ix"]] = ((first, last), math.ceil(r["inside"] * 5 / MEDIAN_GRID))
    return found


# --- the operator -----------------------------------------------------------------


def prepare(df: DataFrame) -> Prepared:
    """Statistics of all usable numeric columns, and the medians of those with gaps."""
    numeric = [f for f in fields_of(df) if f.is_numeric]
    stats = {ix: s for ix, s in column_stats(df, numeric).items() if s.usable}
    fields = [f for f in numeric if f.ix in stats]
    gaps = {ix: s for ix, s in stats.items() if s.missing}
    if not gaps:
        return Prepared(fields, stats, {})
    cells = _cells(df, [f for f in fields if f.ix in gaps])
    return Prepared(fields, stats, exact_medians(cells, gaps))


def _cells(df: DataFrame, fields: list[Field]) -> DataFrame:
    """(column_ix, number, freq) with one row per cell."""
    cells = unfold(df, "double", fields, lambda f: f.number_cell)
    return cells.select("column_ix", F.col("value").alias("number"), F.lit(1).alias("freq"))


def _filled(prepared: Prepared) -> Column:
    """The number, or the median of its column where it is missing."""
    if not prepared.medians:
        return F.col("number")
    fill = per_field(prepared.fields, lambda f: prepared.medians.get(f.ix))
    return F.coalesce(F.col("number"), fill.cast("double"))


def survivor(prepared: Prepared) -> Column:
    """The value as (number, freq, u, seed) if any of its rows gets into the sample, or NULL.

    To be applied to a frequency table. Each row enters each tree with the probability
    ``p = min(1, TREE_SAMPLE / rows)``, so a value gets into the sample with probability
    ``1 - (1 - p) ^ (TREES * freq)``; how often it does is settled when the forest is grown.
    """
    ix, freq, number = F.col("column_ix"), F.col("freq"), _filled(prepared)
    rates = {i: min(1.0, TREE_SAMPLE / s.rows) for i, s in prepared.stats.items() if s.rows}
    p = per_field(prepared.fields, lambda f: rates.get(f.ix)).cast("double")
    seed = F.xxhash64(ix, number, F.lit(SEED))
    u = F.shiftrightunsigned(seed, 11) * F.lit(2.0**-53)
    alive = (p >= 1.0) | (u < -F.expm1(freq * TREES * F.log1p(-F.least(p, F.lit(0.999999)))))
    value = F.struct(number.alias("number"), freq.alias("freq"), u.alias("u"), seed.alias("seed"))
    return F.when((freq > 0) & p.isNotNull() & alive, value)


def fit_forests(sample: DataFrame, prepared: Prepared) -> dict[int, Forest]:
    """Forests from the survivors (column_ix, drawn), one task per column.

    A column's sample and its steps (at most TREES * TREE_SAMPLE) are bounded.
    """
    rows = per_field(prepared.fields, lambda f: prepared.stats[f.ix].rows)
    forests = (
        sample.select("column_ix", "drawn.*", rows.alias("rows"))
        .withColumn("p", F.least(F.lit(1.0), TREE_SAMPLE / F.col("rows")))
        .groupBy("column_ix")
        .applyInPandas(
            _forest_of,
            "column_ix int, breaks array<double>, scores array<double>, repeats double",
        )
    )
    return {
        r["column_ix"]: Forest(
            np.asarray(r["breaks"], dtype=float), np.asarray(r["scores"], dtype=float), r["repeats"]
        )
        for r in forests.collect()
    }


def _scored(freqs: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """(column_ix, score, freq): rows per anomaly score, a bounded number per column."""
    steps = {ix: (f.breaks, f.scores) for ix, f in forests.items()}
    shipped = freqs.sparkSession.sparkContext.broadcast(steps)

    @F.pandas_udf("double")
    def score(ix: pd.Series, number: pd.Series) -> pd.Series:
        columns, values = ix.to_numpy(), number.to_numpy(dtype=float)
        out = np.empty(len(columns))
        for column in np.unique(columns):
            breaks, scores = shipped.value[int(column)]
            chosen = columns == column
            out[chosen] = scores[np.searchsorted(breaks, values[chosen], side="left")]
        return pd.Series(out)

    return (
        freqs.select("column_ix", score("column_ix", "number").alias("score"), "freq")
        .groupBy("column_ix", "score")
        .agg(F.sum("freq").alias("freq"))
    )


def _outlier_counts(scored: DataFrame) -> DataFrame:
    """Rows beyond the contamination percentile of the score, ties staying inside.

    The percentile interpolates linearly between the two rows around its position, so
    the rows at the lower one fall outside exactly when the two scores differ.
    """
    by_score = W.partitionBy("column_ix").orderBy(F.desc("score"))
    position = (F.col("rows") - 1) * F.lit(CONTAMINATION)
    rank = F.floor(position)
    through, before = F.col("through"), F.col("through") - F.col("freq")
    return (
        scored.withColumn("through", F.sum("freq").over(by_score))
        .withColumn("rows", F.sum("freq").over(W.partitionBy("column_ix")))
        .where((before <= rank) & (rank < through))
        .select(
            "column_ix",
            F.when((position > rank) & (through <= rank + 1), through)
            .otherwise(before)
            .alias("outlier_count"),
            "rows",
        )
    )


def outliers(
    df: DataFrame, prepared: Prepared | None = None, sample: DataFrame | None = None
) -> DataFrame:
    """(column_ix, column_name, outlier_count, outlier_percentage, accuracy_score).

    ``sample`` may hand in the survivors (column_ix, drawn) of a frequency table counted
    for other reasons as well. Columns that are not numeric, empty or hold infinite
    values have no outliers.
    """
    fields = fields_of(df)
    prepared = prepared or prepare(df)
    counts = [_no_outliers(df, fields)]
    for start in range(0, len(prepared.fields), COLUMNS_AT_ONCE):
        part = prepared.fields[start : start + COLUMNS_AT_ONCE]
        if sample is None:
            table = frequency_counts(df, [f.name for f in part])
            drawn = table.select("column_ix", survivor(prepared).alias("drawn"))
            drawn = drawn.where(F.col("drawn").isNotNull())
        else:
            drawn = sample.where(F.col("column_ix").isin([f.ix for f in part]))
        forests = fit_forests(drawn, prepared)
        many = [f for f in part if forests[f.ix].repeats > REPEATS]
        few = [f for f in part if forests[f.ix].repeats <= REPEATS]
        for members in filter(None, (many, few)):
            cells = _cells(df, members).withColumn("number", _filled(prepared))
            if members is many:
                cells = cells.groupBy("column_ix", "number").agg(F.sum("freq").alias("freq"))
            counts.append(_outlier_counts(_scored(cells, forests)))
    found = reduce(DataFrame.unionByName, counts).groupBy("column_ix")
    totals = found.agg(F.max("outlier_count").alias("outlier_count"), F.max("rows").alias("rows"))
    portion = F.when(F.col("rows") > 0, F.col("outlier_count") / F.col("rows")).otherwise(0.0)
    return totals.select(
        "column_ix",
        per_field(fields, lambda f: f.name).alias("column_name"),
        "outlier_count",
        portion.alias("outlier_percentage"),
        (1 - portion).alias("accuracy_score"),
    )


def _no_outliers(df: DataFrame, fields: list[Field]) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(f.ix) for f in fields])).alias("column_ix"),
        zero.alias("outlier_count"),
        zero.alias("rows"),
    )
