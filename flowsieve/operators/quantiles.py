"""Exact quantiles of many columns, at any row count.

A sketch opens a narrow bracket around every wanted rank, one pass counts the rows below and inside the
brackets, and the values of small brackets are sorted. A bracket that still holds many rows is closed in on
with histogram passes: each counts its rows by bin (combined before the shuffle) and keeps the bin that holds
the rank. The sketch and the bins only narrow; the result is exact.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor, inf, nextafter
from operator import or_
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from flowsieve.functions.columns import finite_or_null, named

#: Items of a level of the sketch, the most that it takes, and the share of the rows that a rank is given on either side.
SKETCH, MARGIN = 16384, 0.0005
BINS = 256
LAST_ROWS = 20_000


class Bracket(NamedTuple):
    """Closed value range known to hold a wanted rank; ``below`` rows lie under it."""

    column: str
    low: float
    high: float
    below: int
    rows: int


def exact_quantiles(
    df: DataFrame, columns: list[str], shares: list[float], last_rows: int = LAST_ROWS
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column, skipping NULL, NaN and infinities.

    A column without any value gives ``None``. Brackets of up to ``last_rows`` rows are sorted.
    """
    if not columns:
        return {}
    names = [f"v{i}" for i in range(len(columns))]
    values = df.select(*[finite_or_null(named(c).cast("double")).alias(v) for c, v in zip(columns, names)])
    ends = [max(s - MARGIN, 0.0) for s in shares] + [min(s + MARGIN, 1.0) for s in shares]
    facts = values.agg(
        *[
            F.struct(
                F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"),
                F.when(F.count(v) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(v, F.lit(SKETCH)), F.array(*map(F.lit, ends)))).alias("ends"),
            ).alias(v)
            for v in names
        ]
    ).first()
    wanted = {
        (v, rank): k
        for v in names
        for k, share in enumerate(shares)
        if facts[v].n
        for rank in (floor((facts[v].n - 1) * share), ceil((facts[v].n - 1) * share))
    }
    brackets = _counted(values, facts, wanted, len(shares))
    ranked = order_statistics(values, brackets, last_rows=last_rows)
    quantiles: dict[str, list[float | None]] = {}
    for c, v in zip(columns, names):
        n = facts[v].n
        quantiles[c] = []
        for share in shares:
            if not n:
                quantiles[c].append(None)
                continue
            place = (n - 1) * share
            low, high = ranked[v, floor(place)], ranked[v, ceil(place)]
            quantiles[c].append(low + (high - low) * (place - floor(place)))
    return quantiles


def _counted(values: DataFrame, facts: Row, wanted: dict[tuple[str, int], int], n_shares: int) -> dict[tuple[str, int], Bracket]:
    """The bracket of every wanted rank: the sketch's, or what lies beside it should it miss the rank."""
    spans = {(v, k): (facts[v].ends[k], facts[v].ends[k + n_shares]) for (v, _), k in wanted.items()}
    if not spans:
        return {}
    counts = values.agg(
        *[
            F.struct(F.count_if(F.col(v) < low).alias("below"), F.count_if(F.col(v).between(low, high)).alias("rows")).alias(f"{v}_{k}")
            for (v, k), (low, high) in spans.items()
        ]
    ).first()
    brackets = {}
    for (v, rank), k in wanted.items():
        (low, high), count, whole = spans[v, k], counts[f"{v}_{k}"], facts[v]
        if rank < count.below:
            brackets[v, rank] = Bracket(v, whole.low, nextafter(low, -inf), 0, count.below)
        elif rank < count.below + count.rows:
            brackets[v, rank] = Bracket(v, low, high, count.below, count.rows)
        else:
            so_far = count.below + count.rows
            brackets[v, rank] = Bracket(v, nextafter(high, inf), whole.high, so_far, whole.n - so_far)
    return brackets


def order_statistics(
    df: DataFrame, targets: dict[tuple[str, int], Bracket], bins: int = BINS, last_rows: int = LAST_ROWS
) -> dict[tuple[str, int], float]:
    """The value at each wanted ``(column, zero-based rank)``."""
    brackets = dict(targets)
    while True:
        open_brackets = sorted({b for b in brackets.values() if b.low < b.high})
        if not open_brackets:
            return {target: bracket.low for target, bracket in brackets.items()}
        # few rows have a value in a bracket; only for these the cells are made
        near = reduce(or_, [F.col(b.column).between(b.low, b.high) for b in open_brackets])
        rows = df.where(near).select(
            F.inline(
                F.filter(F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("id"), F.col(b.column).alias("v"), F.lit(b.low).alias("low"), F.lit(b.high).alias("high")
                        )
                        for i, b in enumerate(open_brackets)
                    ]
                ), lambda b: b["v"].between(b["low"], b["high"]))
            )
        )

        if all(b.rows <= last_rows for b in open_brackets):
            places = {
                i: sorted({rank - b.below for (_, rank), held in brackets.items() if held == b}) for i, b in enumerate(open_brackets)
            }
            wanted = F.element_at(F.create_map(*[x for i, at in places.items() for x in (F.lit(i), F.array(*map(F.lit, at)))]), F.col("id"))
            ordered = rows.groupBy("id").agg(F.sort_array(F.collect_list("v")).alias("vs"))
            found = ordered.select("id", F.transform(wanted, lambda place: F.get("vs", place)).alias("vs")).collect()
            values = {(open_brackets[row["id"]], place): v for row in found for place, v in zip(places[row["id"]], row["vs"])}
            return {target: values.get((b, target[1] - b.below), b.low) for target, b in brackets.items()}

        # halves keep the width finite for columns that span the whole double range
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        counted = (
            rows.withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
            .groupBy("id", "bin")
            .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .collect()  # at most open brackets x bins rows
        )
        by_bracket: dict[Bracket, list] = {b: [] for b in open_brackets}
        for row in sorted(counted, key=lambda r: (r["id"], r["bin"])):
            by_bracket[open_brackets[row["id"]]].append(row)
        for target, bracket in brackets.items():
            below = bracket.below
            for row in by_bracket.get(bracket, ()):
                if target[1] < below + row["n"]:
                    brackets[target] = Bracket(bracket.column, row["low"], row["high"], below, row["n"])
                    break
                below += row["n"]
