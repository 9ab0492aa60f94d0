"""Claims listed in our own response files: filters, dispositions and folded copies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docketlens import rules
from docketlens.functions import text as tx
from docketlens.operators import identity


@dataclass(frozen=True)
class ClaimCondition:
    party: str = ""
    products: tuple[str, ...] = ()
    year: str = ""
    min_amount: float | None = None   # zero and None both mean "no threshold"


def claim_project(evidence: Column | str) -> Column:
    """Project name written inside the claim's evidence text."""
    return tx.strip(F.regexp_extract(tx.text_or_empty(evidence), tx.rx(rules.CLAIM_PROJECT), 1))


def absent_reason(evidence: Column | str, amount: Column | str) -> Column:
    return F.when(tx.col(amount).isNotNull(), "").otherwise(
        F.regexp_extract(tx.text_or_empty(evidence), tx.rx(rules.CLAIM_ABSENT), 1))


def filtered_claims(contracts: DataFrame, documents: DataFrame, cond: ClaimCondition) -> DataFrame:
    """Matching claims with ``disposition``: shown, below_amount or no_amount (none is dropped)."""
    ev = tx.text_or_empty("evidence_text")
    keep = F.col("contract_id").startswith("LEDGER-")
    if cond.party:
        keep = keep & F.contains(tx.text_or_empty("party_a"), F.lit(cond.party))
    words = tuple(p for p in cond.products if p)
    if cond.products:
        keep = keep & tx.contains_any(ev, words)
    if cond.year:
        keep = keep & F.contains(ev, F.lit(cond.year))
    docs = documents.filter(F.col("document_role").isin(*rules.EVIDENCE_ROLES))
    disposition = F.lit("shown")
    if cond.min_amount:
        disposition = (F.when(F.col("total_amount").isNull(), "no_amount")
                       .when(F.col("total_amount") < cond.min_amount, "below_amount").otherwise("shown"))
    return contracts.filter(keep).join(docs, "document_id").withColumn("disposition", disposition)


def disposition_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("disposition").count().withColumnRenamed("count", "claims")


def track_records(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folded records, their other locations) of the shown claims."""
    shown = claims.filter("disposition = 'shown'").select(
        "party_a", "contract_id", "ordinal", "total_amount", "evidence_text", "document_id", "relative_path",
        "project_folder", "content_format", "document_role")
    reps, also = identity.fold_claims(shown, ["party_a", "contract_id"])
    return (reps.withColumn("project", claim_project("evidence_text"))
            .withColumn("amount_absent", absent_reason("evidence_text", "total_amount")),
            also.select("fold_key", "contract_id", "relative_path", "document_id", "project_folder", "content_format"))


def capped(records: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(first ``cap`` records in list order, one row with the full count and the truncation flag)."""
    head = records.orderBy(F.asc_nulls_first("party_a"), "contract_id").limit(cap)
    totals = records.agg(F.count("*").alias("folded"), F.coalesce(F.sum("copy_count"), F.lit(0)).alias("raw")).select(
        "folded", "raw", (F.col("raw") - F.col("folded")).alias("folded_copies"),
        (F.col("folded") > cap).alias("truncated"))
    return head, totals
