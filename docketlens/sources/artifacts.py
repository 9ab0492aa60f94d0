"""Text extraction with a content-hash cache, and batch state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from docketlens.functions import text as tx

PARSER, VERSION = "html_text", "1"
OUT = "sha256 string, text string, error string"


def html_text(html: Column | str) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed, basic entities decoded."""
    t = F.regexp_replace(tx.text_or_empty(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/h[1-6]|/li|/tr|/div)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(ch))
    return tx.strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def cache_misses(docs: DataFrame, artifacts: DataFrame, parser: str = PARSER, version: str = VERSION) -> DataFrame:
    """Documents whose content no artifact of this parser and version covers, one per content."""
    have = artifacts.filter((F.col("parser_name") == parser) & (F.col("parser_version") == version)).select("sha256").distinct()
    return docs.join(have, "sha256", "left_anti").groupBy("sha256").agg(F.min("content").alias("content"))


def extract_html(docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """New artifacts for the built-in HTML decoder; stays inside the JVM."""
    return cache_misses(docs, artifacts).select(
        "sha256", html_text("content").alias("text"), F.lit(None).cast("string").alias("error"),
        F.lit(PARSER).alias("parser_name"), F.lit(VERSION).alias("parser_version"))


def extract_with(docs: DataFrame, artifacts: DataFrame, decode: Callable[[bytes | str], str], parser: str, version: str) -> DataFrame:
    """New artifacts from a plug-in decoder; a failure is a row with ``error``, never a lost document."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            texts, errors = [], []
            for content in pdf["content"]:
                try:
                    texts.append(decode(content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pdf[["sha256"]].assign(text=texts, error=errors)

    return (cache_misses(docs, artifacts, parser, version).mapInPandas(run, OUT)
            .withColumn("parser_name", F.lit(parser)).withColumn("parser_version", F.lit(version)))


def outcomes(docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every document with its artifact's text and error."""
    return docs.select("document_id", "sha256").join(artifacts.select("sha256", "text", "error"), "sha256", "left")
