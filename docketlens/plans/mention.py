"""Contracts whose text names a product that their detail lines do not list."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from docketlens import rules
from docketlens.functions import text as tx
from docketlens.plans import locate


def context_pattern(alias: str, words: tuple[str, ...] = rules.MENTION_CONTEXT_WORDS,
                    window: int = rules.MENTION_WINDOW) -> str:
    """Regex for ``alias`` with a context word within ``window`` characters on either side.

    A word may lie beside the alias, overlap its edge, or sit inside it.
    """
    a = re.escape(alias)
    if any(w in alias for w in words):
        return a
    options = []
    for w in words:
        if alias in w:
            i = w.index(alias)
            options.append(f"(?<={re.escape(w[:i])}){a}(?={re.escape(w[i + len(alias):])})")
        for o in range(min(len(w), len(alias) + 1)):
            head, tail = w[:o], w[o:]
            if alias.endswith(head) and len(tail) <= window:
                gap = f"[\\s\\S]{{0,{window - len(w)}}}" if o == 0 else ""
                options.append(f"{a}(?={gap}{re.escape(tail)})")
            head, tail = w[:len(w) - o], w[len(w) - o:]
            if alias.startswith(tail) and len(head) <= window:
                gap = f"[\\s\\S]{{0,{window - len(w)}}}" if o == 0 else ""
                options.append(f"(?<={re.escape(head)}{gap}){a}")
    # The look-ahead lets every other position fail on its first character.
    return f"(?={a})(?:{'|'.join(dict.fromkeys(options))})" if options else r"(?!)"


def line_around(text: Column, pos: Column, size: int, cut: int = 200, tail: int = 60) -> Column:
    """The line holding the 1-based ``pos``; without a line break after it, ``tail`` more characters."""
    before = F.substring(text, F.lit(1), pos - 1)
    start = pos - F.length(F.substring_index(before, "\n", -1))
    stop = F.position(F.lit("\n"), text, pos + size)
    end = F.when(stop > 0, stop).otherwise(pos + size + tail)
    return tx.left(tx.strip(F.substring(text, start, end - start)), cut)


def _line_at(body: Column, size: int):
    def line(pos: Column) -> Column:
        return F.when(pos > 0, line_around(body, pos, size))

    return line


def mention_line(text: Column | str, aliases: tuple[str, ...],
                 words: tuple[str, ...] = rules.MENTION_CONTEXT_WORDS) -> Column:
    """Evidence line of the first alias (in list order) found in business context, else NULL."""
    body = tx.text_or_empty(text)
    found = []
    for alias in [a for a in aliases if a]:
        pattern = context_pattern(alias, words)
        at = F.when(F.contains(body, F.lit(alias)), F.regexp_instr(body, F.lit(pattern)))
        found.append(tx.let(at, _line_at(body, len(alias))))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def mention_contracts(contracts: DataFrame, documents: DataFrame, texts: DataFrame, items: DataFrame,
                      cond: locate.LocateCondition, product: str, answered: DataFrame | None = None,
                      approved: DataFrame | None = None,
                      words: tuple[str, ...] = rules.MENTION_CONTEXT_WORDS) -> DataFrame:
    """The mention group: never filtered by amount, product exclusions act on the whole text."""
    docs = documents.filter(locate.role_ok() & ~F.coalesce(F.col("parse_status").isin(*rules.BLOCKED_STATUSES), F.lit(False))
                            & ~F.coalesce(F.col("doc_subtype").isin(*rules.BLOCKED_SUBTYPES), F.lit(False)))
    if approved is not None:
        docs = docs.withColumn("id_prefix", tx.left("document_id", 12)).join(approved, "id_prefix", "left_semi").drop("id_prefix")
    if answered is not None:
        docs = docs.join(answered.select("document_id").distinct(), "document_id", "left_anti")
    c = contracts.filter(F.col("contract_id").startswith("CTL-")
                         & locate.party_filter(cond.party_include, cond.party_exclude)
                         & locate.date_filter(cond.date_from, cond.date_to))
    listed = (items.filter((F.col("row_type") == "detail") & tx.contains_any("product_raw", cond.keywords))
              .select("contract_id").distinct())
    # The text is reduced to one evidence line while it is scanned, before any join carries it.
    hits = (texts.filter(~tx.contains_any("text", cond.product_exclude) & tx.contains_any("text", cond.keywords))
            .select("canonical_document_id", F.explode_outer(F.array(mention_line("text", cond.keywords, words))).alias("evidence_snippet"))
            .filter("evidence_snippet IS NOT NULL"))
    return (c.join(docs, "document_id").join(hits, "canonical_document_id")
            .join(listed, "contract_id", "left_anti").withColumn("product", F.lit(product)))


def mention_order() -> list[Column]:
    return [F.coalesce(F.col("total_amount"), F.lit(0)).desc(), locate.date_number("contract_date").desc(),
            F.col("contract_id")]
