"""Sharding by vector bin packing over bytes, tokens and rows jointly.

Rows with the same key (by default, equal texts) form a group with a size vector, scaled so that one shard
has capacity 1 in every dimension. A group goes to the shard where the dot product of its vector with the
residual capacity is highest. Dimensions have weights in that product, so that the first ones end nearer to
their targets. Placement runs in two steps:

1. Heavy groups, those above 1 / ``HEAVY`` of a shard in some dimension, are placed first, one after the
   other, on the driver. There are at most dimensions * shards * HEAVY of them by definition. Only a group larger
   than a whole shard is cut, by a hash of its rows, into pieces of about ``MAX_PIECE`` of a shard.
2. The other groups are hashed into slices. Each slice owns an equal part of the capacity that is left and
   places its groups by the same rule, largest first. Slices are independent tasks; a shard's error is that of
   many small slices, each within one light group of its share.

The number of slices grows with the square root of the number of groups.

Defined results:

* NULL texts group with empty texts: size 1, no tokens. Repeated rows belong to the same group.
* Slots number a shard's rows from 0 without gaps, in order of a row hash, then id.
* Very long texts are heavy groups like any other. An empty table gives an empty result.
* Reruns agree: every choice depends on hashes of keys and on sums.
* Columns of the input are kept; shard and slot replace columns of these names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from docketlens.llm.words import n_words
from docketlens.session import cut_lineage

HEAVY = 32
MAX_PIECE = 0.25


def place(vectors: np.ndarray, residual: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bin of each vector in turn: highest weighted dot product with the residual capacity, first bin on ties.

    ``residual`` (bins x dimensions) is reduced in place. A bin without room has residuals below zero, so its
    dot product falls behind all others.
    """
    out = np.empty(len(vectors), np.int32)
    for i, v in enumerate(vectors):
        out[i] = best = int(np.argmax(residual @ (v * weights)))
        residual[best] -= v
    return out


def text_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with ``group_key``, ``bytes`` (UTF-8 bytes plus 1) and ``tokens`` (words) of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"group_key": F.sha2(body, 256), "bytes": (F.octet_length(body) + 1).cast("long"), "tokens": n_words(body)})


def pack(rows: DataFrame, shards: int, id_col: str, key: str = "group_key", sizes: tuple[str, ...] = ("bytes", "tokens"),
         weights: tuple[float, ...] = (64, 8, 1)) -> DataFrame:
    """``rows`` with shard and slot. Rows should be narrow: they are written once to the checkpoint folder.

    ``weights``: of the ``sizes`` and, last, of the row count.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = cut_lineage(rows.drop("shard", "slot"))
    dims = [f"_d{i}" for i in range(len(sizes) + 1)]
    groups = cut_lineage(rows.groupBy(F.col(key).alias("_key")).agg(*[F.sum(c).cast("double").alias(d) for c, d in zip(sizes, dims)],
                                                                    F.count("*").cast("double").alias(dims[-1])))
    totals = groups.agg(F.count("*").alias("n"), *[F.sum(d).alias(d) for d in dims]).first()
    share = [F.col(d) / F.lit(float(totals[d] or 0.0) / shards or 1.0) for d in dims]
    scaled = groups.select("_key", *[s.alias(d) for s, d in zip(share, dims)]).withColumns({
        "_top": F.greatest(*dims), "_sum": sum((F.col(d) * w for d, w in zip(dims, weights)), F.lit(0.0))})
    heavy = scaled.filter(F.col("_top") > 1 / HEAVY).orderBy(F.desc("_sum"), "_key").collect()
    residual, scale = np.ones((shards, len(dims))), np.array(weights, float)
    spark = rows.sparkSession
    # At most dimensions * shards * HEAVY groups: tables of proven size.
    cut_to = [(g["_key"], max(1, int(np.ceil(g["_top"] / MAX_PIECE))) if g["_top"] > 1 else 1) for g in heavy]
    pieces_of = F.broadcast(spark.createDataFrame(cut_to, "_hkey string, _pieces int"))
    tagged = rows.join(pieces_of, F.col(key) == F.col("_hkey"), "left").drop("_hkey")
    piece = F.pmod(F.xxhash64(id_col), "_pieces").cast("int")
    counts = {(r["k"], r["p"]): r["count"] for r in tagged.filter("_pieces > 1").groupBy(F.col(key).alias("k"), piece.alias("p")).count().collect()}
    homes = []
    for g, (_, pieces) in zip(heavy, cut_to):
        parts = [counts.get((g["_key"], p), 0) for p in range(pieces)] if pieces > 1 else [1]
        vectors = np.outer(np.array(parts) / sum(parts), [g[d] for d in dims])
        homes += [(g["_key"], p, int(b)) for p, b in enumerate(place(vectors, residual, scale))]
    heavy_homes = F.broadcast(spark.createDataFrame(homes, "_hkey string, _piece int, _shard int"))

    slices = max(1, int(np.ceil(np.sqrt(totals["n"] or 0) / 32)))
    left = residual / slices
    light = scaled.filter(F.col("_top") <= 1 / HEAVY).withColumn("_slice", F.pmod(F.xxhash64("_key"), F.lit(slices)))

    def place_slice(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_sum", "_key"], ascending=[False, True])
        return pd.DataFrame({"_key": part["_key"], "_shard": place(part[dims].to_numpy(), left.copy(), scale)})

    light_homes = light.groupBy("_slice").applyInPandas(place_slice, "_key string, _shard int")
    in_light = tagged.filter("_pieces IS NULL").drop("_pieces").join(light_homes, F.col(key) == F.col("_key")).drop("_key")
    in_heavy = (tagged.filter("_pieces IS NOT NULL").withColumn("_p", piece).drop("_pieces")
                .join(heavy_homes, (F.col(key) == F.col("_hkey")) & (F.col("_p") == F.col("_piece"))).drop("_hkey", "_piece", "_p"))
    return numbered(in_light.unionByName(in_heavy).withColumnRenamed("_shard", "shard"), id_col, totals[dims[-1]] or 0)


def numbered(rows: DataFrame, id_col: str, n: float) -> DataFrame:
    """Gapless slots from 0 in each shard; a shard is numbered in slices, so it is never one task."""
    rows = cut_lineage(rows.withColumn("_h", F.xxhash64(id_col)))
    slices = max(1, int(np.ceil(np.sqrt(n) / 8)))
    rows = rows.withColumn("_part", F.pmod("_h", F.lit(slices)))
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    past = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_part").orderBy("_h", id_col)
    return (rows.join(starts, ["shard", "_part"]).withColumn("slot", (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
            .drop("_h", "_part", "_start"))


def crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
