"""Keyword dictionaries: name -> keywords, order kept, keys that start with '_' ignored."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from docketlens.session import lookup_table


def load(path: str) -> dict[str, tuple[str, ...]]:
    with open(path, encoding="utf-8") as f:
        return {k: tuple(v) for k, v in json.load(f).items() if not k.startswith("_")}


def as_table(spark: SparkSession, words: dict[str, tuple[str, ...]]) -> DataFrame:
    """(name, keyword, priority, position); first-match rules sort by priority."""
    rows = [(name, w, i, j) for i, (name, ws) in enumerate(words.items()) for j, w in enumerate(ws)]
    return lookup_table(spark, rows, "name string, keyword string, priority int, position int")
