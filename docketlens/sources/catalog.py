"""File catalog: listing, delta against the stored catalog, dry-run reports."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketlens import rules
from docketlens.functions import text as tx
from docketlens.operators import classify, identity
from docketlens.session import cut_lineage
from docketlens.sources.sinks import local_path


class UnreachableRoot(RuntimeError):
    """A listed root does not exist; nothing is written in that run."""


def _hidden(name: str) -> bool:
    """The names that Spark's file sources pass over."""
    passed = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return passed and not name.startswith(("_common_metadata", "_metadata"))


_ENTRY = pa.schema([("source_root_id", pa.string()), ("base", pa.string()), ("relative_path", pa.string()), ("is_folder", pa.bool_()),
                    ("file_size", pa.int64()), ("file_mtime", pa.timestamp("us", "UTC"))])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_root_id, base, folder) -> what lies directly in the folder; a folder of very many files passes in pieces."""
    for b in batches:
        rows = []
        for root, base, folder in zip(*(b.column(c).to_pylist() for c in ("source_root_id", "base", "relative_path"))):
            with os.scandir(os.path.join(base, folder)) as found:
                for e in found:
                    try:
                        state = e.stat()
                    except FileNotFoundError:  # gone since, or a link to nothing
                        continue
                    if not _hidden(e.name):
                        name = os.fsencode(e.name).decode("utf-8", "replace")
                        at = datetime.fromtimestamp(state.st_mtime_ns // 1_000_000_000, timezone.utc).replace(microsecond=state.st_mtime_ns // 1_000_000 % 1000 * 1000)
                        rows.append((root, base, f"{folder}/{name}" if folder else name, e.is_dir(), state.st_size, at))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY)], schema=_ENTRY)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY)], schema=_ENTRY)


def _list_folders(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """One round per level of folders: tasks list the folders of the level, the driver sees how many there are."""
    slots = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(r, base, "") for r, base in roots.items()], "source_root_id string, base string, relative_path string")
    levels, folders = [], len(roots)
    while folders:
        found = cut_lineage(level.repartition(min(folders, 4 * slots)).mapInArrow(
            _entries, "source_root_id string, base string, relative_path string, is_folder boolean, file_size long, file_mtime timestamp"))
        levels.append(found.filter("NOT is_folder").select("source_root_id", "relative_path", "file_size", "file_mtime"))
        level = found.filter("is_folder").select("source_root_id", "base", "relative_path")
        folders = level.count()
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out


def list_files(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Recursive listing of every root; file contents are never read.

    A missing root stops the whole run before any row is produced. Folders that every machine mounts are listed in tasks; in other
    stores Spark's file source lists them.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    missing, local = [], {}
    for root_id, path in roots.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            missing.append(f"{root_id} -> {path}")
        elif fs.getFileStatus(p).isDirectory() and (folder := local_path(spark, path)):
            local[root_id] = folder
    if missing:
        raise UnreachableRoot("; ".join(missing))
    parts = [_list_folders(spark, local)] if local else []
    for root_id, path in roots.items():
        if root_id in local:
            continue
        # Roots may be URIs; like the listed paths they are compared without their scheme.
        base = re.sub(r"^[a-z0-9]+:/*(?=/)", "", path.rstrip("/")) + "/"
        raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
               .select("path", "length", "modificationTime"))
        rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), f"^.*?\\Q{base}\\E", "")
        parts.append(raw.select(F.lit(root_id).alias("source_root_id"), rel.alias("relative_path"),
                                F.col("length").alias("file_size"), F.col("modificationTime").alias("file_mtime")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_extension(path: Column | str) -> Column:
    name = tx.base_name(path)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))


def classify_listing(listing: DataFrame, vendors: rules.Vendors = rules.Vendors()) -> DataFrame:
    """Project, extension, role and ``skip_reason`` (loose / excluded / system / NULL) per file."""
    project = F.substring_index("relative_path", "/", 1)
    loose = ~F.contains("relative_path", F.lit("/"))
    with_role = (listing.withColumn("project_folder", F.when(~loose, project))
                 .withColumn("file_ext", file_extension("relative_path"))
                 .withColumn("document_role", classify.classify_path("relative_path", vendors)["role"]))
    return with_role.withColumn(
        "skip_reason",
        F.when(loose, "loose").when(F.contains("project_folder", F.lit(rules.EXCLUDED_FOLDER_WORD)), "excluded")
        .when(F.col("document_role") == rules.SYSTEM_TEMP, "system"))


def skip_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.coalesce("skip_reason", F.lit("scanned")).alias("reason")).agg(F.count("*").alias("files"))


def catalog_delta(scanned: DataFrame, stored: DataFrame, with_meta: bool = True) -> DataFrame:
    """``action`` per scanned file: insert, update_meta or keep. Stored rows are never deleted."""
    keys = ["source_root_id", "relative_path"]
    old = stored.select(*keys, F.col("file_size").alias("_size"), F.col("file_mtime").alias("_mtime"), F.lit(True).alias("_known"))
    changed = ~(F.col("file_size").eqNullSafe(F.col("_size")) & F.col("file_mtime").eqNullSafe(F.col("_mtime")))
    action = F.when(F.col("_known").isNull(), "insert").when(F.lit(with_meta) & changed, "update_meta").otherwise("keep")
    return (scanned.join(old, keys, "left").withColumn("action", action)
            .withColumn("document_id", identity.document_id("source_root_id", "relative_path"))
            .drop("_size", "_mtime", "_known"))


def limited_inserts(delta: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` new files in key order; the same ones on every run."""
    return delta.filter("action = 'insert'").orderBy("source_root_id", "relative_path").limit(limit)


def action_counts(delta: DataFrame) -> DataFrame:
    """Dry-run summary: what a run would do, nothing written."""
    return delta.groupBy("action").agg(F.count("*").alias("rows"))


def next_catalog(delta: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows with changed size and time replaced, plus the inserts."""
    keys = ["source_root_id", "relative_path"]
    fresh = delta.filter("action = 'update_meta'").select(*keys, F.col("file_size").alias("_size"), F.col("file_mtime").alias("_mtime"))
    kept = (stored.join(fresh, keys, "left").withColumn("file_size", F.coalesce("_size", "file_size"))
            .withColumn("file_mtime", F.coalesce("_mtime", "file_mtime")).select(*stored.columns))
    new = delta.filter("action = 'insert'")
    return kept.unionByName(new.select(*[c for c in stored.columns if c in new.columns]), allowMissingColumns=True)


def duplicate_keys(stored: DataFrame) -> DataFrame:
    """Uniqueness test of the catalog: empty when every (root, path) is stored once."""
    return stored.groupBy("source_root_id", "relative_path").count().filter("count > 1")


def set_report(scanned: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows only scanned, only known and in both."""
    a, b = scanned.select(*keys).distinct(), known.select(*keys).distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), keys, "full_outer")
    part = (F.when(F.col("_a").isNull(), "only_known").when(F.col("_b").isNull(), "only_scanned").otherwise("both"))
    return both.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))


def same_keys(scanned: DataFrame, known: DataFrame, keys: list[str]) -> bool:
    """True when both sides hold the same keys (both differences are empty)."""
    a, b = scanned.select(*keys), known.select(*keys)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
