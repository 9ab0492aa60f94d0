"""Equality of two large tables: digests per bucket first, rows only where digests differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 4096


def _row_text(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)))


def bucket_digests(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows, one, two): two sums of row hashes that do not depend on row order; at most ``buckets`` rows."""
    text = _row_text(df.columns)
    total = lambda h: F.sum(h.cast("decimal(20,0)"))
    return _bucketed(df, keys, buckets).groupBy(F.col("_bucket").alias("bucket")).agg(
        F.count("*").alias("rows"), total(F.xxhash64(text)).alias("one"), total(F.xxhash64(F.lit("second"), text)).alias("two"))


def differing_buckets(left: DataFrame, right: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    a, b = bucket_digests(left, keys, buckets), bucket_digests(right, keys, buckets)
    held = lambda d, n: F.struct(f"{d}.rows", f"{d}.one", f"{d}.two")
    both = a.alias("a").join(b.alias("b"), F.col("a.bucket") == F.col("b.bucket"), "full_outer")
    return both.filter(~held("a", 0).eqNullSafe(held("b", 0))).select(F.coalesce("a.bucket", "b.bucket").alias("_bucket"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows that one side has more often, with ``side`` (left or right) and ``copies`` (how many more).

    Columns are matched by name; keys only choose the buckets. NULLs are equal. Equal tables read two columns of sums.
    """
    right = right.select(*[F.col(f"`{c}`") for c in left.columns])
    open_ = F.broadcast(differing_buckets(left, right, keys, buckets))  # at most ``buckets`` rows
    one = lambda df, n: _bucketed(df, keys, buckets).join(open_, "_bucket", "left_semi").withColumn("_n", F.lit(n))
    names = [F.col(f"`{c}`") for c in left.columns]
    more = one(left, 1).unionByName(one(right, -1)).groupBy(*names).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return more.select(*names, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").alias("copies"))


def same_tables(left: DataFrame, right: DataFrame, keys: list[str], buckets: int = BUCKETS) -> bool:
    return sorted(left.columns) == sorted(right.columns) and differing_buckets(
        left, right.select(*[F.col(f"`{c}`") for c in left.columns]), keys, buckets).isEmpty()
