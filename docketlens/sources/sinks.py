"""Exports and snapshot writes."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

BOM = "﻿"


class ForeignRows(RuntimeError):
    """The target holds rows the job did not write; it is not replaced."""


def write_csv(df: DataFrame, path: str, headers: dict[str, str]) -> None:
    """Fixed headers, every value quoted with doubled quotes, BOM in front of each file's header.

    The rows are rebalanced over parts of even size, so that no part is a header without rows.
    """
    names = list(headers.items())
    out = df.select(*[F.col(c).alias(BOM + h if i == 0 else h) for i, (c, h) in enumerate(names)])
    out.hint("rebalance").write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Parquet snapshot, read back: cuts lineage and survives executor loss."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path for a program's own file calls if it is in the file system that all machines mount, else None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def write_files(df: DataFrame, path: str, folders: list[str], content: str) -> None:
    """One file per row in folders ``column=value``, the text and a line feed in it; NULL is an empty text.

    Spark's text writer makes several processes and renames per file in a local file system, which costs more than the texts; there the tasks
    write the files themselves, under names made of text and task, so that a task run again writes the same files.
    """
    base = local_path(df.sparkSession, path)
    if base is None:
        df.select(*folders, content).write.partitionBy(*folders).option("maxRecordsPerFile", 1).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            for *values, text in zip(*(b.column(c).to_pylist() for c in (*folders, content))):
                steps = [re.sub("[\x00-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]", lambda m: f"%{ord(m[0]):02X}", v or "__HIVE_DEFAULT_PARTITION__") for v in values]
                folder = os.path.join(base, *[f"{c}={v}" for c, v in zip(folders, steps)])
                data = (text or "").encode() + b"\n"
                name = f"part-{md5(data).hexdigest()}-{part}"
                seen[folder, name] += 1
                name = f"{name}-{seen[folder, name]}.txt"
                os.makedirs(folder, exist_ok=True)
                own = os.path.join(folder, f".{name}-{TaskContext.get().taskAttemptId()}")
                with open(own, "wb") as f:
                    f.write(data)
                os.replace(own, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["files"])

    df.select(*[F.col(c).cast("string").alias(c) for c in folders], content).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def new_sections(sections: DataFrame, indexed: DataFrame, max_documents: int | None = None) -> DataFrame:
    """Sections of documents that are not indexed yet, the longest documents first, one row per id."""
    fresh = sections.join(indexed.select("document_id").distinct(), "document_id", "left_anti")
    if max_documents is not None:
        sizes = fresh.groupBy("document_id").agg(F.sum(F.length("section_text")).alias("chars"))
        picked = sizes.orderBy(F.col("chars").desc(), "document_id").limit(max_documents).select("document_id")
        fresh = fresh.join(picked, "document_id", "left_semi")
    rest = [c for c in fresh.columns if c != "section_id"]
    return (fresh.groupBy("section_id").agg(F.max(F.struct(*rest)).alias("r")).select("section_id", "r.*")
            .withColumn("embedding_state", F.lit("pending")))


def upsert_sections(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.join(new.select("section_id"), "section_id", "left_anti").unionByName(new, allowMissingColumns=True)


def assert_own_rows(target: DataFrame, own: DataFrame, key: str) -> None:
    """Refuse to rebuild a target that holds keys outside the job's own set."""
    foreign = target.select(key).join(own.select(key).distinct(), key, "left_anti")
    if not foreign.isEmpty():
        raise ForeignRows(f"{foreign.count()} rows of another origin")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
