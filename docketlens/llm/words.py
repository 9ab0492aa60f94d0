"""The word rule that all operators of this subpackage share, and row helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A word is a longest run of characters other than these six.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def words(text: Column) -> Column:
    """All words of a text, in order; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(columns: list[str], base: str) -> str:
    """``base``, longer where a column already has this name."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def apart(df: DataFrame, read: list[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn`` on a table whose columns other than ``read`` have names that no step can clash with; they get theirs back.

    Columns that ``fn`` adds stand behind and replace those of equal names.
    """
    safe = {c: c if c in read else f"_apart_{i}" for i, c in enumerate(df.columns)}
    out = fn(df.select(*[F.col(f"`{c}`").alias(s) for c, s in safe.items()]))
    added = [c for c in out.columns if c not in safe.values()]
    kept = [(c, s) for c, s in safe.items() if s in out.columns and c not in added]
    return out.select(*[F.col(f"`{s}`").alias(c) for c, s in kept], *[F.col(f"`{c}`") for c in added])
