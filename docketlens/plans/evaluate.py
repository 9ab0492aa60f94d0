"""Recall, precision, agreement and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docketlens.functions import text as tx


def recall(gold: DataFrame, hits: DataFrame, queryable: DataFrame) -> DataFrame:
    """Per query: relevant queryable records, how many were hit, recall, false positives.

    ``gold``: (query_id, record_id, document_id, relevant); ``hits``: (query_id, document_id).
    """
    judged = gold.join(queryable.select("document_id").distinct(), "document_id", "left_semi")
    got = hits.select("query_id", "document_id").distinct().withColumn("_hit", F.lit(True))
    rows = judged.join(got, ["query_id", "document_id"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False)))
    out = rows.groupBy("query_id").agg(
        F.count_if("relevant").alias("relevant"), F.count_if(F.col("relevant") & F.col("hit")).alias("retrieved"),
        F.count_if(~F.col("relevant")).alias("irrelevant"), F.count_if(~F.col("relevant") & F.col("hit")).alias("false_positives"))
    return out.withColumn("recall", F.when(F.col("relevant") > 0, F.round(F.col("retrieved") / F.col("relevant"), 4)))


def recall_total(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.sum("relevant").alias("relevant"), F.sum("retrieved").alias("retrieved"),
                         F.sum("false_positives").alias("false_positives"),
                         F.round(F.sum("retrieved") / F.sum("relevant"), 4).alias("recall"))


def precision_at(ranked: DataFrame, gold: DataFrame, order: list[Column], success_k: int = 5, precision_k: int = 10) -> DataFrame:
    """Per query: success@k, precision@k over the rows really shown, unlabelled rows, upper bound."""
    w = Window.partitionBy("query_id").orderBy(*order)
    top = ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(success_k, precision_k))
    good = gold.filter("relevant").select("query_id", "document_id").distinct().withColumn("_good", F.lit(True))
    rows = top.join(good, ["query_id", "document_id"], "left").withColumn("ok", F.coalesce("_good", F.lit(False)))
    inside = F.col("rank") <= precision_k
    out = rows.groupBy("query_id").agg(
        F.bool_or(F.col("ok") & (F.col("rank") <= success_k)).alias("success"), F.count_if(inside).alias("shown"),
        F.count_if(inside & F.col("ok")).alias("relevant_shown"), F.count_if(inside & ~F.col("ok")).alias("unlabelled"))
    return (out.join(good.select("query_id").distinct(), "query_id", "left_semi")
            .withColumn("precision", F.round(F.col("relevant_shown") / F.col("shown"), 4))
            .withColumn("precision_upper", F.round((F.col("relevant_shown") + F.col("unlabelled")) / F.col("shown"), 4)))


def majority(labels: DataFrame) -> DataFrame:
    """(item_id, label, votes, voters): most frequent label, ties to the smaller label; agreement flag."""
    counts = labels.groupBy("item_id", "label").agg(F.count("*").alias("votes"))
    return counts.groupBy("item_id").agg(
        F.min_by("label", F.struct((-F.col("votes")).alias("v"), "label")).alias("label"),
        F.max("votes").alias("votes"), F.sum("votes").alias("voters"), (F.count("*") == 1).alias("unanimous"))


def fleiss_kappa(labels: DataFrame) -> DataFrame:
    """Agreement beyond chance for items judged by the same number of labellers."""
    counts = labels.groupBy("item_id", "label").agg(F.count("*").alias("n"))
    per_item = counts.groupBy("item_id").agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    p_item = per_item.agg(F.avg((F.col("sq") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("p_bar"))
    shares = counts.groupBy("label").agg(F.sum("n").alias("n"))
    chance = shares.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("p_e"))
    null = F.lit(None).cast("double")
    both = (p_item.select("p_bar", null.alias("p_e")).unionByName(chance.select(null.alias("p_bar"), "p_e"))
            .agg(F.max("p_bar").alias("p_bar"), F.max("p_e").alias("p_e")))
    return both.select(F.round("p_bar", 4).alias("observed"), F.round("p_e", 4).alias("expected"),
                       F.round((F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e")), 4).alias("kappa"))


def confusion(truth: DataFrame, predicted: DataFrame, classes: list[str]) -> DataFrame:
    """One row per true class, one column per predicted class."""
    both = truth.select("item_id", F.col("label").alias("truth")).join(predicted.select("item_id", F.col("label").alias("predicted")), "item_id")
    return both.groupBy("truth").pivot("predicted", classes).count().fillna(0)


def binary_scores(truth: DataFrame, predicted: DataFrame, positive: str) -> DataFrame:
    both = truth.select("item_id", (F.col("label") == positive).alias("t")).join(
        predicted.select("item_id", (F.col("label") == positive).alias("p")), "item_id")
    c = both.agg(F.count_if(F.col("t") & F.col("p")).alias("tp"),
                 F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"),
                 F.count_if(~F.col("t") & ~F.col("p")).alias("tn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
                    F.round(2 * p * r / (p + r), 4).alias("f1"),
                    F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 4).alias("accuracy"))


def date_precision(date: Column | str) -> Column:
    n = F.length(tx.text_or_empty(date))
    return F.when(n == 10, "day").when(n == 7, "month").when(n == 0, "none").otherwise("other")


def precision_shift(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """How many rows moved from one date precision to another."""
    b = before.select(key, date_precision(column).alias("before"))
    a = after.select(key, date_precision(column).alias("after"))
    return b.join(a, key).groupBy("before", "after").agg(F.count("*").alias("rows"))


def fill_rates(table: DataFrame, columns: list[str]) -> DataFrame:
    """Non-empty rows per column, one pass."""
    counts = table.agg(F.count("*").alias("rows"), *[F.count_if(tx.text_or_empty(F.col(c).cast("string")) != "").alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in columns])
    return counts.select("rows", F.inline(pairs)).withColumn("rate", F.round(F.col("filled") / F.col("rows"), 4))


def canonical_effect(items: DataFrame, raw: str, canonical: Column) -> DataFrame:
    d = items.withColumn("_c", canonical)
    return d.agg(F.count_distinct(raw).alias("raw_values"), F.count_distinct("_c").alias("families"),
                 F.count_if(F.col(raw).isNotNull() & F.col("_c").isNull()).alias("noise_rows"))


def reconcile(contracts: DataFrame, items: DataFrame, file_amount: Column, tolerance: float = 1.0) -> DataFrame:
    """Detail sum against the file-name amount: match / mismatch / uncomparable / no_detail, and the impossible case."""
    d = items.filter("row_type = 'detail'").groupBy("contract_id").agg(
        F.sum("line_amount").cast("double").alias("detail_sum"), F.bool_or(F.col("line_amount").isNull()).alias("has_unknown"))
    got = F.coalesce("detail_sum", F.lit(0.0))
    verdict = (F.when(F.col("file_amount").isNull(), "uncomparable").when(F.col("has_unknown").isNull(), "no_detail")
               .when(F.col("has_unknown"), "uncomparable").when(F.abs(got - F.col("file_amount")) < tolerance, "match").otherwise("mismatch"))
    return (contracts.withColumn("file_amount", file_amount).join(d, "contract_id", "left").withColumn("verdict", verdict)
            .withColumn("impossible", F.coalesce((F.col("file_amount").isNotNull()) & (got > F.col("file_amount") + 1) & F.col("has_unknown").isNotNull(), F.lit(False))))
