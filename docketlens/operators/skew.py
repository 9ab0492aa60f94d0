"""Numbering rows inside groups that may be larger than one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docketlens.session import cut_lineage


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str, slices: int | None = None) -> DataFrame:
    """1-based row number within ``keys`` by ``order``, without gathering a group in one task.

    Rows are range-partitioned by (keys, order), so a hot group spreads over many slices. Each
    slice numbers its own rows and the slice sizes give the offsets. The slice of a row must not
    change when a task is run again, so it is fixed by a checkpoint.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()))
    sizes = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    same = F.lit(True)
    numbered = cut.withColumn("_inside", F.row_number().over(inside))
    o = offsets.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_slice").alias("_o_slice"), "_offset")
    for k in keys:
        c = numbered[k].eqNullSafe(o[f"_o_{k}"])
        same = same & c
    return (numbered.join(o, same & (numbered["_slice"] == o["_o_slice"]))
            .withColumn(out, (F.col("_inside") + F.col("_offset")).cast("long"))
            .drop("_slice", "_inside", "_offset", "_o_slice", *[f"_o_{k}" for k in keys]))
