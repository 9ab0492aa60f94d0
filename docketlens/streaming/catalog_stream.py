"""Catalog refresh as an incremental job over a file listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docketlens import rules
from docketlens.sources import catalog, sinks

LISTING = "source_root_id string, relative_path string, file_size long, file_mtime timestamp"


def refresh_once(spark: SparkSession, batch: DataFrame, store: str, batch_id: int,
                 vendors: rules.Vendors = rules.Vendors()) -> None:
    """Write one batch's new catalog rows to its own folder; a repeated batch rewrites the same rows."""
    rows = catalog.classify_listing(batch, vendors).filter("skip_reason IS NULL").drop("skip_reason")
    rows = rows.groupBy("source_root_id", "relative_path").agg(
        F.max_by(F.struct(*[c for c in rows.columns if c not in ("source_root_id", "relative_path")]), "file_mtime").alias("r")
    ).select("source_root_id", "relative_path", "r.*")
    own = f"{store}/batch_id={batch_id}"
    if sinks.exists(spark, store):
        known = spark.read.parquet(store).filter(F.col("batch_id") != batch_id) if spark.read.parquet(store).columns else None
    else:
        known = None
    if known is not None:
        rows = rows.join(known.select("source_root_id", "relative_path"), ["source_root_id", "relative_path"], "left_anti")
    rows.write.mode("overwrite").parquet(own)


def refresh_stream(spark: SparkSession, listings: str, store: str, checkpoint: str,
                   vendors: rules.Vendors = rules.Vendors()) -> StreamingQuery:
    """Consume listing files (JSON lines) that have arrived since the last run, then stop."""
    source = spark.readStream.schema(LISTING).json(listings)
    return (source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda df, i: refresh_once(df.sparkSession, df, store, i, vendors)).start())
