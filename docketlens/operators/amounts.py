"""Product amounts: sums of detail lines only, unknown never counted as zero, conflicts kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docketlens import rules
from docketlens.functions import text as tx
from docketlens.session import checked_broadcast


def category_of(product_raw: Column | str) -> Column:
    """Part before the first slash; the whole text when there is no slash."""
    return F.substring_index(tx.text_or_empty(product_raw), "/", 1)


def service_of(product_raw: Column | str) -> Column:
    raw = tx.text_or_empty(product_raw)
    return F.when(F.contains(raw, F.lit("/")), F.regexp_replace(raw, r"^[^/]*/", "")).otherwise(F.lit(""))


def product_key(product_raw: Column | str) -> Column:
    """Category when present, else the service name."""
    raw = tx.text_or_empty(product_raw)
    return F.when(category_of(raw) != "", category_of(raw)).otherwise(service_of(raw))


def is_detail() -> Column:
    return F.col("row_type") == "detail"


def status_columns() -> list[Column]:
    """Aggregates over the rows of one product of one contract.

    ``row_order`` is any orderable column giving the document order; max_by keeps the last
    declared subtotal. All of them combine partially before the shuffle.
    """
    detail, known = is_detail(), F.col("line_amount").isNotNull()
    declared = (F.col("row_type") == "product_subtotal") & known
    return [
        F.sum(F.when(detail, F.col("line_amount"))).alias("detail_sum"),
        F.max_by("line_amount", F.when(declared, F.col("row_order"))).alias("subtotal_declared"),
        F.coalesce(F.bool_or(detail & ~known), F.lit(False)).alias("has_unknown"),
        F.count_if(detail).alias("detail_rows"),
        F.count_if(detail & known).alias("known_rows"),
        F.count_if(detail & (F.col("line_amount") == 0)).alias("zero_rows"),
        F.coalesce(F.bool_or(detail & (F.col("product_amount_source") == rules.DERIVED)), F.lit(False)).alias("any_derived"),
        F.coalesce(F.bool_or(detail & (F.col("product_amount_source") == rules.FILENAME_TOTAL)), F.lit(False)).alias("any_filename"),
        F.max_by("product_amount_source",
                 F.when(detail & (F.col("product_amount_source") != ""), F.col("row_order"))).alias("last_source"),
    ]


def conflict() -> Column:
    return F.coalesce(
        ~F.col("has_unknown")
        & (F.abs(F.col("detail_sum") - F.col("subtotal_declared")) > rules.CONFLICT_TOLERANCE), F.lit(False))


def amount_status(items: DataFrame) -> DataFrame:
    """Per contract and product key: detail sum, declared subtotal, unknown and conflict flags."""
    keyed = items.withColumn("product_key", product_key("product_raw"))
    return (keyed.groupBy("contract_id", "product_key").agg(*status_columns())
            .withColumn("conflict", conflict()))


def status_label() -> Column:
    return F.when(F.col("has_unknown"), "unknown").when(F.col("conflict"), "conflict").otherwise("ok")


def derive_missing_amounts(items: DataFrame) -> DataFrame:
    """quantity x unit price for missing amounts, only when every detail row has both."""
    detail = is_detail()
    full = (F.col("quantity") > 0) & (F.col("unit_price") > 0)
    ready = items.groupBy("contract_id").agg(
        F.every(~detail | F.coalesce(full, F.lit(False))).alias("_ready"),
        F.bool_or(detail & F.col("line_amount").isNull()).alias("_gap"),
    ).filter("_ready AND _gap").select("contract_id", F.lit(True).alias("_fill"))
    fill = F.coalesce(F.col("_fill"), F.lit(False)) & detail & F.col("line_amount").isNull()
    amount = F.round(F.col("quantity") * F.col("unit_price"), 2)
    return (items.join(ready, "contract_id", "left")
            .withColumn("product_amount_source", F.when(fill, rules.DERIVED).otherwise(F.col("product_amount_source")))
            .withColumn("line_amount", F.when(fill, amount.cast(items.schema["line_amount"].dataType))
                        .otherwise(F.col("line_amount")))
            .drop("_fill"))


def evidence_text(rows: DataFrame, keys: list[str], piece: int = 80, total: int = 240, sep: str = "；") -> DataFrame:
    """First pieces of the rows of a key in document order, joined and cut.

    Only the first ``total + 1`` rows of a key can reach the cut, so the ranked limit before the
    list keeps every group small without changing the text; Spark applies it before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy("row_order")
    kept = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= total + 1)
    parts = F.array_sort(F.collect_list(F.struct("_rn", tx.left(tx.text_or_empty("evidence_text"), piece).alias("t"))))
    return kept.groupBy(*keys).agg(
        F.substring(F.array_join(F.transform(parts, lambda x: x["t"]), sep), 1, total).alias("detail_evidence"))


def status_with_evidence(rows: DataFrame, keys: list[str], *more: Column, evidence: bool = True, piece: int = 80, total: int = 240, sep: str = "；") -> DataFrame:
    """``status_columns``, the columns ``more`` and, if asked for, ``detail_evidence`` as by ``evidence_text``: one pass over the rows.

    Rows that lie together by some of the keys are not shuffled again.
    """
    out = [*status_columns(), *more]
    if evidence:
        w = Window.partitionBy(*keys, "_detail").orderBy("row_order")
        rows = rows.withColumn("_detail", is_detail()).withColumn("_rn", F.row_number().over(w))
        first = F.when(F.col("_detail") & (F.col("_rn") <= total + 1), F.struct("_rn", tx.left(tx.text_or_empty("evidence_text"), piece).alias("t")))
        out.append(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["t"]), sep), 1, total).alias("detail_evidence"))
    return rows.groupBy(*keys).agg(*out)


def beside_contracts(items: DataFrame, matches: DataFrame, piece: int = 80) -> DataFrame:
    """Items with the rows of ``matches`` for their product text, dealt by contract.

    A table of matches within the broadcast bound goes to the items: only those it names are shuffled, once and before they fan out.
    """
    cut = tx.left(tx.text_or_empty("evidence_text"), piece).alias("evidence_text")
    lines = items.select("contract_id", "row_order", "product_raw", "line_amount", "row_type", "product_amount_source", cut)
    table = checked_broadcast(matches)
    if table is matches:
        return lines.join(matches, "product_raw").repartition("contract_id")
    named = F.broadcast(matches.select("product_raw").distinct())
    return lines.join(named, "product_raw", "left_semi").repartition("contract_id").join(table, "product_raw")


def product_rollup(items: DataFrame) -> DataFrame:
    """Per contract and product text: amount, rows, known and zero rows, last source, derived flag."""
    named = items.filter(is_detail() & F.col("product_raw").isNotNull() & ~F.col("product_raw").isin("---", ""))
    return named.groupBy("contract_id", "product_raw").agg(*status_columns()).select(
        "contract_id", "product_raw", F.col("detail_sum").alias("amount"),
        F.coalesce("last_source", F.lit(rules.DECLARED)).alias("amount_source"),
        "detail_rows", (F.col("known_rows") > 0).alias("amount_known"),
        F.col("zero_rows").alias("zero_amount_rows"), F.col("any_derived").alias("derived"))


def family_summary(rollup: DataFrame, family: Column) -> DataFrame:
    """Product families: product rows counted (not distinct contracts), known amounts summed."""
    return rollup.groupBy(family.alias("family")).agg(
        F.count("*").alias("contracts"), F.sum("amount").alias("amount"),
        F.bool_or("amount_known").alias("amount_known"))
