"""What past responses said per module: headings used, time commitments, key points, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docketlens.functions import text as tx
from docketlens.operators import times


def coverage(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("module").agg(
        F.count_distinct("document_id").alias("files"), F.count_distinct(F.coalesce("project_folder", "project_key", F.lit(""))).alias("projects"),
        F.count("*").alias("sections"), F.count_if(F.col("verdict") == "heading").alias("heading_hits"))


def heading_frequency(evidence: DataFrame, top: int = 20) -> DataFrame:
    counts = (evidence.withColumn("heading", tx.strip("heading")).filter("heading <> ''")
              .groupBy("module", "heading").agg(F.count("*").alias("sections")))
    w = Window.partitionBy("module").orderBy(F.col("sections").desc(), "heading")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def commitment_values(evidence: DataFrame, keys: list[str], ref: str, text: str = "section_text") -> DataFrame:
    """(keys, slot, minutes): first wording and number of distinct sources."""
    found = times.commitments(evidence, [*keys, ref], text)
    return found.groupBy(*keys, "slot", "minutes").agg(
        F.min_by("value", F.struct(ref, "position")).alias("value"), F.min_by("context", F.struct(ref, "position")).alias("context"),
        F.count_distinct(ref).alias("sources"))


def commitment_slots(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per slot: distinct values, strictest and longest, and the conflict flag (never resolved)."""
    return values.groupBy(*keys, "slot").agg(
        F.count("*").alias("distinct_values"), F.min("minutes").alias("strictest"), F.max("minutes").alias("longest"),
        (F.count("*") > 1).alias("conflict"))


def conflicts(evidence: DataFrame, keys: list[str], ref: str, text: str = "section_text") -> DataFrame:
    """Slots with more than one value from at least two sources; several values inside one source are not one."""
    found = times.commitments(evidence, [*keys, ref], text)
    per = found.groupBy(*keys, "slot").agg(
        F.count_distinct("minutes").alias("distinct_values"), F.count_distinct(ref).alias("sources"))
    return per.filter("distinct_values > 1 AND sources >= 2")


def key_points(evidence: DataFrame, per_project: int = 3, cut: int = 220) -> DataFrame:
    """First characters of each section, at most ``per_project`` per project in pick order."""
    project = F.coalesce("project_folder", "project_key", F.lit(""))
    w = Window.partitionBy("module", "project").orderBy("pick")
    return (evidence.filter(~tx.blank("section_text")).withColumn("project", project)
            .withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_project)
            .select("module", "project", "section_id", "heading", tx.left(tx.strip("section_text"), cut).alias("excerpt")))
