"""Running totals and neighbour windows that do not need one task per group.

A window over ``partitionBy(group).orderBy(value)`` sorts a whole group in one task, and in flow
data one class or one source can hold a third of all rows. The helpers here cut the value axis into
ranges first, work inside ``(group, range)`` and add what the neighbouring ranges hold. Inputs of one
range take the plain window: one shuffle, no extra job.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby
from math import ceil, inf, nextafter
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.columns import named
from flowsieve.operators.bounds import MAX_CLASSES, bounded_rows, small_table

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 100_000
SAMPLES_PER_RANGE = 20
TEXT_SAMPLE = 20_000
TEXT_CUTS = 256


class Ranges(NamedTuple):
    """Cuts of an axis, and further cuts of a second axis inside values that fill whole ranges."""

    cuts: list[float]
    heavy: list[float] = []
    tie_cuts: list[float] = []


def _quantile_cuts(df: DataFrame, axis: Column, rows_per_range: int, n_rows: int) -> list[float]:
    ranges = ceil(n_rows / rows_per_range)
    if ranges <= 1:
        return []
    if ranges > MAX_RANGES:  # their totals come to the driver
        raise ValueError(f"{n_rows} rows need {ranges} ranges, more than {MAX_RANGES}; raise rows_per_range")
    fraction = min(1.0, SAMPLES_PER_RANGE * ranges / n_rows)
    sampled = df.select(axis.cast("double").alias("axis")).where("axis is not null and not isnan(axis)")
    sampled = sampled if fraction == 1.0 else sampled.sample(fraction=fraction, seed=7)
    shares = [i / ranges for i in range(1, ranges)]
    return sampled.agg(F.percentile_approx("axis", shares, max(10_000, 4 * ranges))).first()[0] or []


def cut_points(df: DataFrame, axis: Column, rows_per_range: int, n_rows: int) -> list[float]:
    """Increasing cuts that split the axis into ranges of about ``rows_per_range`` rows.

    The cuts only decide which task handles a row, never the result, so a bounded sample suffices
    to place them. They are literals in the plan: a lost executor recomputes the same ranges.
    """
    return sorted(set(_quantile_cuts(df, axis, rows_per_range, n_rows)))


def nested_ranges(df: DataFrame, axis: Column, tie_axis: Column, rows_per_range: int, n_rows: int) -> Ranges:
    """Ranges for rows ordered by ``axis`` and then ``tie_axis``.

    A value that fills several ranges by itself shows up as a repeated cut. It becomes a range of its
    own, split further along the second axis.
    """
    found = _quantile_cuts(df, axis, rows_per_range, n_rows)
    heavy = sorted({a for a, b in zip(found, found[1:]) if a == b})
    if not heavy:
        return Ranges(sorted(set(found)))
    cuts = sorted({*found, *(nextafter(v, inf) for v in heavy)})
    same = df.where(axis.cast("double").isin(heavy))
    return Ranges(cuts, heavy, cut_points(same, tie_axis, rows_per_range, same.count()))


def sortable_number(df: DataFrame, name: str, rows: DataFrame) -> Column:
    """A double that never decreases along a column: numbers and times as they are, text by the number of
    cut strings that it reaches. The cuts are evenly spaced among at most ``TEXT_SAMPLE`` distinct values,
    taken by their hash; they only place rows."""
    column, kind = named(name), df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp").cast("double")
    data = F.encode(column.cast("string"), "utf-8")
    seen = rows.select(data.alias("value")).where("value is not null").distinct().orderBy(F.xxhash64("value"), "value").limit(TEXT_SAMPLE)
    values = sorted(bytes(row["value"]) for row in seen.collect())
    cuts = sorted({values[len(values) * i // TEXT_CUTS] for i in range(TEXT_CUTS)}) if values else []
    if not cuts:
        return F.lit(0.0)
    reached = F.filter(F.array(*map(F.lit, map(bytearray, cuts))), lambda cut: cut <= data)
    return F.size(reached).cast("double")


def _bucket(df: DataFrame, axis: Column, cuts: list[float], name: str) -> DataFrame:
    splits = [float("-inf"), *cuts, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_axis", outputCol="_range")
    ranged = bucketizer.transform(df.withColumn("_axis", axis.cast("double")))
    return ranged.withColumn(name, F.col("_range").cast("bigint")).drop("_axis", "_range")


def with_range(df: DataFrame, axis: Column, ranges: list[float] | Ranges, name: str, tie_axis: Column | None = None) -> DataFrame:
    """Range number of every row, increasing along the order; equal axis values share a range unless
    the value is split along the second axis."""
    ranges = ranges if isinstance(ranges, Ranges) else Ranges(ranges)
    df = _bucket(df, axis, ranges.cuts, name)
    if not ranges.tie_cuts or tie_axis is None:
        return df
    df = _bucket(df, tie_axis, ranges.tie_cuts, "_tie")
    tie = F.when(axis.cast("double").isin(ranges.heavy), F.col("_tie")).otherwise(0)
    return df.withColumn(name, F.col(name) * (len(ranges.tie_cuts) + 1) + tie).drop("_tie")


def running_totals(
    df: DataFrame,
    group: str,
    order: list[Column],
    totals: dict[str, str],
    cuts: list[float],
    axis: Column,
    descending: bool = False,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Adds ``new = sum(old)`` over the rows of the group up to and including this one.

    ``totals`` maps new column names to summed columns. ``axis`` never decreases along ``order`` (never
    increases if ``descending``) and keeps the groups on separate stretches, so there are no more
    (group, range) pairs than ranges and groups together; their totals come to the driver, are added
    up and go out as a broadcast table. ``counted`` may give the rows behind the totals where they
    are cheaper to get than ``df``.
    """
    to_here = (Window.unboundedPreceding, Window.currentRow)
    if not cuts:
        window = Window.partitionBy(group).orderBy(*order).rowsBetween(*to_here)
        return df.withColumns({new: F.sum(old).over(window) for new, old in totals.items()})

    per_range = (
        with_range(df if counted is None else counted, axis, cuts, "_part")
        .groupBy(group, "_part")
        .agg(*[F.sum(old).cast("bigint").alias(new) for new, old in totals.items()])
    )
    sums = bounded_rows(per_range, len(cuts) + 1 + MAX_CLASSES, "totals by range")
    offsets = []
    for value, rows in groupby(sorted(sums, key=lambda r: (r[group], r["_part"])), key=lambda r: r[group]):
        by_part = {row["_part"]: row for row in rows}
        first, last = min(by_part), max(by_part)
        so_far = [0] * len(totals)
        for part in range(last, first - 1, -1) if descending else range(first, last + 1):
            offsets.append((value, part, *so_far))
            if part in by_part:
                so_far = [a + by_part[part][new] for a, new in zip(so_far, totals)]
    kind = df.schema[group].dataType.simpleString()
    before = small_table(df.sparkSession, offsets, ", ".join([f"`{group}` {kind}", "_part bigint", *[f"_before_{n} bigint" for n in totals]]))
    local = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(*to_here)
    return (
        with_range(df, axis, cuts, "_part")
        .join(before, [group, "_part"], "left")
        .withColumns({new: F.sum(old).over(local) + F.coalesce(f"_before_{new}", F.lit(0)) for new, old in totals.items()})
        .drop("_part", *[f"_before_{new}" for new in totals])
    )


def neighbour_windows(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    axis: Column,
    before: int,
    after: int,
    cuts: list[float] | Ranges,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    tie_axis: Column | None = None,
) -> DataFrame:
    """Window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``add(table, window)`` adds them. One shuffle sorts the rows by (group, range); rows whose
    neighbourhood lies inside their range are done. For the few at the ends of a range, the rows around
    all range ends of a group are sorted once more: a constant number per range, however large the
    group is.
    """
    if not (cuts.cuts if isinstance(cuts, Ranges) else cuts):
        return add(df, Window.partitionBy(*groups).orderBy(*order))
    margin = before + after
    inner = Window.partitionBy(*groups, "_part")
    placed = with_range(df, axis, cuts, "_part", tie_axis).withColumns(
        {"_row": F.row_number().over(inner.orderBy(*order)), "_rows": F.count(F.lit(1)).over(inner)}
    )
    row, left = F.col("_row"), F.col("_rows") - F.col("_row")
    inside = (row > before) & (left >= after)
    at_ends = placed.where((row <= margin) | (left < margin))
    done = add(placed, inner.orderBy(*order)).where(inside)
    ends = add(at_ends, Window.partitionBy(*groups).orderBy(*order)).where(~inside)
    return done.unionByName(ends).drop("_part", "_row", "_rows")
