"""Points in intervals without a range condition in the join: nodes of a binary tree over all bounds.

Bounds and points may be strings of any length or other ordered values. Their distinct values are numbered in order, and an interval
of numbers is cut into at most two nodes per level of a binary tree: an interval covers a point exactly if
one of its nodes is an ancestor of the point, and then only one is. So the range condition is an equality on
(keys, level, node) with no residual test; rows are intervals or points times the logarithm of the distinct values,
and open ends are ordinary intervals up to the last number.

Joins run on distinct intervals and points. ``stab_sums`` never pairs them: intervals are aggregated per
node, and a point adds up its ancestors, so a point inside a million intervals costs one row per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlens.operators.skew import number_rows
from docketlens.session import cut_lineage


def _numbered(values: DataFrame) -> tuple[DataFrame, int]:
    """(value, no) for the distinct non-NULL values, and how many there are."""
    distinct = values.filter("value IS NOT NULL").distinct().withColumn("_all", F.lit(1))
    table = cut_lineage(number_rows(distinct, ["_all"], ["value"], "no").select("value", (F.col("no") - 1).alias("no")))
    return table, table.count()


def _interval_nodes(low: Column, high: Column, levels: int) -> Column:
    """array<struct<level, node>> that tile [low, high]; empty where low > high."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first = F.floor((low + size - 1) / size).cast("long")
        last = F.floor((high + 1) / size).cast("long") - 1
        return F.array(F.when((first <= last) & (first % 2 == 1), F.struct(level.alias("level"), first.alias("node"))),
                       F.when((first <= last) & (last % 2 == 0), F.struct(level.alias("level"), last.alias("node"))))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))


def _point_nodes(no: Column, levels: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(
        level.alias("level"), F.floor(no / F.call_function("shiftleft", F.lit(1).cast("long"), level)).cast("long").alias("node")))


def _placed(points: DataFrame, ranges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct points (keys, value, level, node) and ranges (keys, low, high, level, node). NULL keys match nothing."""
    # Numbering and placing both read them: made once.
    p = cut_lineage(points.select(*keys, "value").filter("value IS NOT NULL").distinct())
    r = cut_lineage(ranges.select(*keys, "low", "high").filter("low IS NOT NULL").distinct())
    table, n = _numbered(p.select("value").union(r.select("low")).union(r.select("high")))
    levels = max(1, n).bit_length()
    low = table.select(F.col("value").alias("low"), F.col("no").alias("low_no"))
    high = table.select(F.col("value").alias("high"), F.col("no").alias("high_no"))
    last = F.coalesce("high_no", F.lit(n - 1).cast("long"))
    r = r.join(low, "low").join(high, "high", "left").select(
        *keys, "low", "high", F.explode(_interval_nodes(F.col("low_no"), last, levels)).alias("at")).select(*keys, "low", "high", "at.*")
    p = p.join(table, "value").select(*keys, "value", F.explode(_point_nodes(F.col("no"), levels)).alias("at")).select(*keys, "value", "at.*")
    return p, r


def stab(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, value, low, high) with low <= value <= high under equal keys; a NULL high is open.

    ``points`` has the keys and ``value``, ``ranges`` the keys, ``low`` and ``high``.
    """
    p, r = _placed(points, ranges, keys)
    return p.join(r, [*keys, "level", "node"]).select(*keys, "value", "low", "high")


def stab_sums(points: DataFrame, ranges: DataFrame, keys: list[str], counts: str, least: str) -> DataFrame:
    """(keys, value, n, least): over the range rows that cover a point, the sum of ``counts`` and the minimum of ``least``."""
    p, r = _placed(points, ranges, keys)
    per = ranges.groupBy(*keys, "low", "high").agg(F.sum(counts).alias("_n"), F.min(least).alias("_least"))
    r = r.withColumnsRenamed({k: f"_{k}" for k in [*keys, "low", "high"]})
    same = F.col("low").eqNullSafe(F.col("_low")) & F.col("high").eqNullSafe(F.col("_high"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    nodes = per.join(r, same).groupBy(*keys, "level", "node").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"))
    return p.join(nodes, [*keys, "level", "node"]).groupBy(*keys, "value").agg(F.sum("_n").alias("n"), F.min("_least").alias("least"))
