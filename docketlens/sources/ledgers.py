"""JSON side tables, cell dumps and archive member lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketlens.functions import text as tx
from docketlens.plans import modules


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the ``records`` list of JSON side files; the schema is given, nothing is inferred."""
    df = spark.read.schema(f"records array<struct<{schema}>>").option("multiLine", True).json(path)
    return df.select(F.inline("records"))


def read_allow_list(spark: SparkSession, path: str) -> DataFrame:
    """12-character id prefixes of the approved documents (a JSON list of objects)."""
    df = spark.read.schema("document_id string").option("multiLine", True).json(path)
    return df.filter("document_id <> ''").select(tx.left("document_id", 12).alias("id_prefix")).distinct()


def sheet_rows(docs: DataFrame, columns: list[str], text: str = "text", sheet: str = "Sheet1", first_row: int = 3) -> DataFrame:
    """``Sheet!A1=value`` dumps as one row per sheet row; a cell written twice keeps its last value."""
    pattern = rf"(?m){sheet}!([A-Z]+)(\d+)=(.+?)(?=\s*\|\s*{sheet}!|\s*\n\s*{sheet}!|$)"
    every = lambda g: F.regexp_extract_all(tx.text_or_empty(text), F.lit(tx.rx(pattern)), F.lit(g))
    cells = F.arrays_zip(every(1).alias("column_name"), every(2).alias("row_no"), every(3).alias("cell"))
    d = docs.filter(F.contains(text, F.lit(f"{sheet}!"))).withColumn("_cells", F.transform(cells, lambda x, i: F.struct(
        x["column_name"].alias("column_name"), x["row_no"].cast("int").alias("row_no"), x["cell"].alias("cell"), i.alias("at"))))
    rows = tx.unfold(d, "_cells", ["document_id", "relative_path"]).filter(F.col("row_no") >= first_row)
    value = lambda c: tx.strip(F.coalesce(F.max_by("cell", F.when(F.col("column_name") == c, F.col("at"))), F.lit("")))
    return rows.groupBy("document_id", "relative_path", "row_no").agg(*[value(c).alias(c) for c in columns])


def voucher_records(docs: DataFrame) -> DataFrame:
    """Payment ledger rows (number, project, service, amount, dates, payee), duplicates removed."""
    rows = sheet_rows(docs, list("CDEFHIJK")).filter("H <> ''")
    one = rows.groupBy(F.upper("H").alias("k"), "C", "E").agg(F.min_by(F.struct(*rows.columns), F.struct("document_id", "row_no")).alias("r"))
    return one.select("r.*").select(
        F.col("H").alias("contract_number"), F.col("C").alias("project"), F.col("D").alias("service"), F.col("E").alias("amount_wan"),
        F.col("F").alias("sign_date"), F.col("I").alias("invoice_no"), F.col("J").alias("pay_time"), F.col("K").alias("payee"),
        modules.voucher_state("K", "J").alias("has_payment"), tx.base_name("relative_path").alias("source_file"),
        F.col("document_id").alias("source_document_id"))


def receipt_records(members: DataFrame, path: Column | str = "inner_path", pattern: str = r"[A-Z]{2,4}\d{8,}") -> DataFrame:
    """Archive members whose path carries a contract number; contents are not read."""
    return (members.withColumn("contract_number", tx.rx_group(tx.col(path), pattern, 0)).filter("contract_number IS NOT NULL"))


