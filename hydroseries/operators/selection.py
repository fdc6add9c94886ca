"""Exact percentiles of groups of any size, by distributed selection.

A group's sought ranks start in one range, from its least to its greatest value. Ranges that hold more than HELD values are cut into BINS, whose
counts are sums over all tasks; only the bins that hold a sought rank go on, narrowed to their own least and greatest value. Bins are
even in value; where one got more than half of its range, the next ones are even in the logarithm, so steep data take few rounds. When
none is larger than HELD, or all its values are equal, the values of each are sorted and the rank is read. So a task never holds more than
HELD values of a group, whatever the group's share of the rows, and only counts are shuffled before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroseries.sources.shared import write_shared

#: Values of one range that may stand in one task.
HELD = 10_000
BINS = 1024
#: Added to logarithms: those of the least positive numbers stay positive.
LEAST_LOG = 746.0


def percentiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float], count: str | None = None, held: int = HELD, bins: int = BINS) -> DataFrame:
    """keys and a column for each of shares: that percentile of value, between two values by linear interpolation; and how many values there are, as count.

    Null, NaN and infinite values count as none; groups with no other values have no row. Null keys are a group.
    rows is read once for extents, once for each narrowing (most data take one, small groups none) and once at the end.
    """
    v = value.cast("double")
    finite = F.abs(v) < F.lit(float("inf"))  # NaN is greater than any number
    inside = rows.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], v.alias("_v")).where(finite)
    own = [f"_{i}" for i in range(len(keys))]
    sought = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(_place(q)), F.ceil(_place(q))) for q in shares.values()])))
    ranges = inside.groupBy(*own).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("n"))
    ranges = write_shared(ranges.select(*own, "low", "high", F.lit(0).cast("bigint").alias("below"), "n", F.col("n").alias("size"), F.lit(False).alias("logs"), sought.alias("ranks")), "ranges")
    large = (F.col("size") > held) & (F.col("low") < F.col("high"))
    while not (todo := ranges.where(large)).isEmpty():
        ranges = write_shared(ranges.where(~large).unionByName(_narrow(inside, todo, own, bins)), "ranges")

    alike = F.col("low") == F.col("high")
    sorted_values = _meet(inside, ranges.where(~alike), own).groupBy(*own, "low", "below", "n", "ranks").agg(F.sort_array(F.collect_list("_v")).alias("values"))
    read = sorted_values.select(*own, "n", F.transform("ranks", lambda r: F.struct(r.alias("rank"), F.get("values", (r - F.col("below")).cast("int")).alias("value"))).alias("found"))
    same = ranges.where(alike).select(*own, "n", F.transform("ranks", lambda r: F.struct(r.alias("rank"), F.col("low").alias("value"))).alias("found"))
    told = read.unionByName(same).groupBy(*own).agg(F.any_value("n").alias("n"), F.map_from_entries(F.flatten(F.collect_list("found"))).alias("at"))
    figures = [_between(q).alias(name) for name, q in shares.items()] + ([F.col("n").alias(count)] if count else [])
    return told.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], *figures)


def beside(rows: DataFrame, figures: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the figures (one row a key) of their keys; null keys meet too."""
    own = {k: f"_own{i}" for i, k in enumerate(keys)}
    renamed = figures.select(*[F.col(k).alias(o) for k, o in own.items()], *[c for c in figures.columns if c not in own])
    alike = [rows[k].eqNullSafe(renamed[o]) for k, o in own.items()]
    return rows.join(renamed, alike, how).drop(*own.values())


def _place(share: float) -> Column:
    return F.lit(float(share)) * (F.col("n") - 1)


def _between(share: float) -> Column:
    place = _place(share)
    low, high = F.floor(place), F.ceil(place)
    a, b = F.element_at("at", low), F.element_at("at", high)
    return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)


def _meet(inside: DataFrame, ranges: DataFrame, own: list[str]) -> DataFrame:
    """Each value beside the range that holds it: ranges of a group do not overlap. Ranges are few beside values; Spark broadcasts them if they are small, else it can split large keys."""
    mine = ranges.select(*[F.col(o).alias(f"r{o}") for o in own], *[c for c in ranges.columns if c not in own])
    near = F.col("_v").between(F.col("low"), F.col("high"))
    for o in own:
        near = near & F.col(o).eqNullSafe(F.col(f"r{o}"))
    return inside.join(mine, near).drop(*[f"r{o}" for o in own])


def _narrow(inside: DataFrame, ranges: DataFrame, own: list[str], bins: int) -> DataFrame:
    """The bins of ranges that hold sought ranks. The least value is in the first bin and the greatest in the last, so each narrowing makes progress."""
    v, low, high, logs = (F.col(c) for c in ("_v", "low", "high", "logs"))
    # Halved first: the distance of two finite numbers may not be finite.
    even, steep = (lambda x: x / 2), (lambda x: F.signum(x) * (F.ln(F.when(x != 0, F.abs(x))) + LEAST_LOG))
    share = F.when(logs, F.try_divide(_or0(steep(v)) - _or0(steep(low)), _or0(steep(high)) - _or0(steep(low)))).otherwise(F.try_divide(even(v) - even(low), even(high) - even(low)))
    bin_ = F.when(v == low, 0).when(v == high, bins - 1).otherwise(F.greatest(F.lit(0), F.least(F.floor(share * bins), F.lit(bins - 1))))
    met = _meet(inside, ranges.withColumnRenamed("size", "whole"), own).withColumn("bin", bin_)
    counted = met.groupBy(*own, "below", "n", "whole", "logs", "ranks", "bin").agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy(*own, "below").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # at most bins rows
    placed = counted.withColumn("below", F.col("below") + before)
    kept = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("size")))
    stuck = 2 * F.col("size") > F.col("whole")
    return placed.select(*own, "low", "high", "below", "n", "size", (stuck != logs).alias("logs"), kept.alias("ranks")).where(F.size("ranks") > 0)


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))
