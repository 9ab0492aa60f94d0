"""One contract answer: detail hits, claims and mentions, kept apart by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def labelled(df: DataFrame, label: str, amount: str) -> DataFrame:
    return df.select(F.lit(label).alias("result_group"), "contract_id", "document_id", "party_a",
                     F.col(amount).cast("double").alias("amount"))


def contract_answer(hits: DataFrame, claims: DataFrame, mentions: DataFrame) -> DataFrame:
    return (labelled(hits, "contracts", "amount").unionByName(labelled(claims, "claims", "total_amount"))
            .unionByName(labelled(mentions, "mentions", "total_amount")))
