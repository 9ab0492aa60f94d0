"""Tender requirements against past commitments and material pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketlens import rules


def compare_with_history(requirements: DataFrame, history: DataFrame) -> DataFrame:
    """covered / stricter / uncovered per requirement; history is (slot, minutes) of any module."""
    best = history.groupBy("slot").agg(F.min("minutes").alias("strictest"), F.count_distinct("minutes").alias("known_values"))
    verdict = (F.when(F.col("strictest").isNull(), "uncovered").when(F.col("minutes") >= F.col("strictest"), "covered")
               .otherwise("stricter"))
    return requirements.join(best, "slot", "left").withColumn("verdict", verdict)


def summary(compared: DataFrame, keys: list[str]) -> DataFrame:
    is_v = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return compared.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("mandatory").alias("mandatory"),
                                       is_v("covered"), is_v("stricter"), is_v("uncovered"))


def material_pools(facts: DataFrame, contracts: DataFrame) -> DataFrame:
    """Rows and distinct documents per material pool, contracts as a pool of their own."""
    pool = F.lit(None).cast("string")
    for name, types in rules.POOL_FACT_TYPES.items():
        pool = F.when(F.col("fact_type").isin(*types), name).otherwise(pool)
    by_fact = (facts.withColumn("pool", pool).filter("pool IS NOT NULL").groupBy("pool")
               .agg(F.count("*").alias("rows"), F.count_distinct("document_id").alias("documents")))
    signed = contracts.filter(F.col("contract_id").startswith("CTL-")).agg(F.count("*").alias("rows")).select(
        F.lit("contracts").alias("pool"), "rows", F.col("rows").alias("documents"))
    return by_fact.unionByName(signed)


def check_table(requirements: DataFrame, pools: DataFrame) -> DataFrame:
    """Each hard requirement with its pool's size; a category without a pool stays NULL."""
    table = F.create_map(*[F.lit(x) for kv in rules.CATEGORY_POOL.items() for x in kv])
    return requirements.withColumn("pool", F.element_at(table, F.col("category"))).join(
        F.broadcast(pools.select("pool", F.col("documents").alias("pool_documents"))), "pool", "left")


def by_category(requirements: DataFrame) -> DataFrame:
    return requirements.groupBy("category").agg(F.count("*").alias("requirements"))
