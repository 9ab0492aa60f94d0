"""Overview and detail of contracts with their products, families and payment evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlens import rules
from docketlens.functions import text as tx
from docketlens.operators import identity


def approved_contracts(contracts: DataFrame, approved: DataFrame) -> DataFrame:
    """Original contracts whose document id starts with an approved 12-character prefix."""
    return (contracts.filter(F.col("contract_id").startswith("CTL-"))
            .withColumn("id_prefix", tx.left("document_id", 12)).join(approved, "id_prefix", "left_semi")
            .drop("id_prefix"))


def match_numbers(side: DataFrame, contracts: DataFrame, number: str = "contract_number") -> DataFrame:
    """Attach the stored contract number by the confusable-safe key; the greatest one wins a tie."""
    stored = (contracts.filter(tx.text_or_empty("contract_number") != "")
              .select(identity.confusable_key("contract_number").alias("_key"), F.col("contract_number").alias("_n"))
              .groupBy("_key").agg(F.max("_n").alias("matched_contract_number")))
    return (side.withColumn("_key", identity.confusable_key(number)).join(stored, "_key", "left").drop("_key"))


def voucher_state(payee: Column | str, pay_time: Column | str) -> Column:
    """no: the ledger says 'not received'; yes: a payment time; unknown: neither is written."""
    return (F.when(F.contains(tx.text_or_empty(payee), F.lit("未到款")), "no")
            .when(tx.strip(tx.text_or_empty(pay_time)) != "", "yes").otherwise("unknown"))


def payment_status(contracts: DataFrame, vouchers: DataFrame, receipts: DataFrame) -> DataFrame:
    """Voucher ledger first, then receipt files: yes / no / unknown / receipt_file / ledger_absent."""
    key = F.upper(F.coalesce("matched_contract_number", "contract_number"))
    v = (vouchers.withColumn("_k", key).groupBy("_k")
         .agg(F.max_by("has_payment", "record_no").alias("has_payment")))
    r = (receipts.filter("matched_contract_number IS NOT NULL").withColumn("_k", F.upper("matched_contract_number"))
         .groupBy("_k").agg(F.count("*").alias("receipt_count")))
    c = contracts.withColumn("_k", F.upper(tx.text_or_empty("contract_number")))
    count = F.coalesce("receipt_count", F.lit(0))
    return (c.join(v, "_k", "left").join(r, "_k", "left").withColumn("receipt_count", count)
            .withColumn("payment_status", F.when(F.col("has_payment").isNotNull(), F.col("has_payment"))
                        .when(F.col("receipt_count") > 0, "receipt_file").otherwise("ledger_absent"))
            .drop("_k"))


def overview(contracts: DataFrame, facts: DataFrame, approved: DataFrame,
             finance: tuple[str, ...] = rules.FINANCE_FACT_TYPES, instruments: tuple[str, ...] = rules.INSTRUMENT_FACT_TYPES) -> DataFrame:
    """Cards of the three modules; the same type lists feed the detail pages."""
    card = F.when(F.col("fact_type").isin(*finance), "finance").when(F.col("fact_type").isin(*instruments), "instruments")
    by_fact = (facts.withColumn("module", card).filter("module IS NOT NULL").groupBy("module").agg(F.count("*").alias("items")))
    signed = approved_contracts(contracts, approved).agg(F.count("*").alias("items")).select(F.lit("contracts").alias("module"), "items")
    return signed.unionByName(by_fact)


def product_order() -> list[Column]:
    """Products inside a contract: unknown amounts last, then the largest first."""
    return [F.when(F.col("amount").isNull(), 1).otherwise(0), F.coalesce(F.col("amount"), F.lit(0)).desc(), F.col("product_raw")]


def newest_contracts(contracts: DataFrame, cap: int) -> DataFrame:
    """Allow-list already applied; newest first, undated last."""
    return contracts.orderBy(F.desc_nulls_last("contract_date"), "contract_id").limit(cap)


def kind_counts(contracts: DataFrame) -> DataFrame:
    kind = F.when(F.col("contract_id").startswith("CTL-"), "CTL").otherwise("LEDGER")
    return contracts.groupBy(kind.alias("kind")).agg(F.count("*").alias("contracts"))


def suffix_matches(gold: DataFrame, catalog: DataFrame) -> DataFrame:
    """gold.source_path ends with catalog.relative_path; the longest catalog path wins.

    Every suffix of a gold path that still holds a slash becomes a join key, so the join is an
    equality on whole paths and a file name shared by millions of files costs nothing.
    """
    clean = lambda c: F.lower(F.regexp_replace(F.replace(tx.col(c), F.lit("\\"), F.lit("/")), "^/+|/+$", ""))
    keys = gold.columns
    suffixes = lambda s: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substring(s, i, F.length(s))),
                                  lambda x: F.contains(x, F.lit("/")))
    g = gold.withColumn("_r", F.explode_outer(tx.let(clean("source_path"), suffixes))).filter("_r IS NOT NULL")
    c = catalog.select("document_id", clean("relative_path").alias("_r"))
    return (g.join(c, "_r").groupBy(*keys)
            .agg(F.max_by("document_id", F.struct(F.length("_r"), "document_id")).alias("document_id")))
