"""Contract location, amounts, folds and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlens import rules
from docketlens.operators import amounts
from docketlens.plans import locate
from workload import views as v
from workload.registry import query
from workload.sqlviews import with_views

# Demonstration conditions over the fixture vocabulary (p_type / p_name).
BIG_PROMO = locate.LocateCondition(keywords=("PROMO", "widget"), min_amount=40_000, date_from="1996-02",
                                   date_to="2000-06", party_exclude=("Customer#000000001",),
                                   match_exclude=("red widget",))
NOT_SMALL = locate.LocateCondition(keywords=("LARGE",), min_amount=20_000, product_exclude=("SMALL/",),
                                   party_include=("Supplier#00000001", "Customer#00000002"))


def located(spark, sf, cond):
    return locate.locate_contracts(v.contract_items(spark, sf), v.contracts(spark, sf),
                                   v.contract_documents(spark, sf), v.contract_artifacts(spark, sf), cond,
                                   v.approved_documents(spark, sf))


def result_columns(df, *more):
    return df.select(*more, "contract_id", "product", F.round("amount", 2).alias("amount"), "amount_status",
                     "amount_source", "hit", "skipped_reason", "document_role", "content_format", "contract_number",
                     "party_a", "party_b", "contract_date", "detail_evidence",
                     F.col("total_amount").cast("double").alias("total_amount"), "document_id", "project_folder")


def any_of(expr, words):
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")" if words else "FALSE"


def locate_sql(c: locate.LocateCondition, tail: str) -> str:
    kw = lambda e: any_of(e, c.keywords)
    parties = "(coalesce(party_a,'') || '|' || coalesce(party_b,''))"
    where = [f"NOT {any_of(parties, c.party_exclude)}"]
    if c.party_include:
        where.append(any_of(parties, c.party_include))
    if c.date_from or c.date_to:
        where.append("contract_date IS NOT NULL")
    if c.date_from:
        where.append(f"contract_date >= '{c.date_from}'")
    if c.date_to:
        where.append(f"contract_date <= '{c.date_to}'")
    return with_views(f"""
, gate AS (
  SELECT c.*, d.project_folder, d.relative_path, d.content_format, d.document_role,
    CASE WHEN d.document_role NOT IN ('our_response','final_signed','contract_evidence') THEN 'role:' || d.document_role
         WHEN d.parse_status IN ('holding_review','paused','blocked','skipped') THEN 'status:' || d.parse_status
         WHEN d.doc_subtype = 'framework_sample' THEN 'subtype:framework_sample'
         WHEN a.sha256 <> d.canonical_document_id THEN 'content_version_mismatch'
         WHEN c.source_sha256 IS NULL OR c.parser_version IS NULL THEN 'fingerprint_missing'
         WHEN c.source_sha256 <> d.canonical_document_id OR c.parser_version <> a.parser_version THEN 'fingerprint_stale'
    END AS reject_reason
  FROM contracts c JOIN contract_documents d USING (document_id)
  JOIN contract_artifacts a ON a.canonical_document_id = d.canonical_document_id
  WHERE substr(c.document_id, 1, 12) IN (SELECT id_prefix FROM approved_documents) AND {' AND '.join(where)}),
usable AS (SELECT * FROM gate WHERE reject_reason IS NULL
  AND contract_id NOT IN (SELECT contract_id FROM contract_items WHERE row_type='detail' AND {any_of('product_raw', c.product_exclude)})),
k AS (SELECT DISTINCT contract_id, CASE WHEN {kw('p_type')} THEN p_type ELSE p_name END AS product, {kw('p_type')} AS by_category
  FROM contract_items WHERE row_type = 'detail' AND NOT {any_of('product_raw', c.match_exclude)} AND ({kw('p_type')} OR {kw('p_name')})),
r AS (SELECT i.*, k.product, k.by_category FROM contract_items i JOIN k ON i.contract_id = k.contract_id
  AND contains(CASE WHEN k.by_category THEN i.p_type ELSE i.product_raw END, k.product)),
s AS (SELECT contract_id, product, by_category,
   sum(line_amount) FILTER (row_type='detail') AS detail_sum,
   coalesce(bool_or(line_amount IS NULL) FILTER (row_type='detail'), FALSE) AS has_unknown,
   arg_max(line_amount, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) FILTER (row_type='product_subtotal' AND line_amount IS NOT NULL) AS subtotal,
   coalesce(bool_or(product_amount_source='derived_qty_x_price') FILTER (row_type='detail'), FALSE) AS any_derived,
   substr(coalesce(string_agg(substr(evidence_text,1,80), '；' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) FILTER (row_type='detail'), ''), 1, 240) AS detail_evidence
  FROM r GROUP BY ALL),
found AS (SELECT u.*, s.product, s.detail_evidence,
   CASE WHEN s.has_unknown THEN 'unknown' WHEN s.by_category AND abs(detail_sum - subtotal) > 0.01 THEN 'conflict' ELSE 'ok' END AS amount_status,
   CASE WHEN s.by_category OR NOT s.has_unknown THEN detail_sum END AS amount,
   CASE WHEN s.any_derived THEN 'derived_qty_x_price' ELSE 'declared' END AS amount_source
  FROM usable u JOIN s USING (contract_id)),
results AS (
 SELECT contract_id, document_id, project_folder, contract_number, party_a, party_b, contract_date, total_amount, product,
   round(CAST(amount AS DOUBLE), 2) AS amount, amount_status, detail_evidence, amount_source, '' AS skipped_reason,
   content_format, document_role, coalesce(amount_status = 'ok' AND amount >= {c.min_amount}, FALSE) AS hit FROM found
 UNION ALL SELECT contract_id, document_id, project_folder, contract_number, party_a, party_b, contract_date, total_amount,
   '', NULL, 'skipped', '', NULL, reject_reason, content_format, document_role, FALSE FROM gate WHERE reject_reason IS NOT NULL
 UNION ALL SELECT contract_id, document_id, project_folder, contract_number, party_a, party_b, contract_date, total_amount,
   '', NULL, 'dataless', '', NULL, 'no_detail_lines', NULL, NULL, FALSE FROM usable
   WHERE contract_id NOT IN (SELECT contract_id FROM contract_items))
{tail}""")


RESULT_TAIL = """SELECT contract_id, product, amount, amount_status, amount_source, hit, skipped_reason, document_role,
 content_format, contract_number, party_a, party_b, contract_date, detail_evidence, CAST(total_amount AS DOUBLE) AS total_amount,
 document_id, project_folder FROM results"""


@query("locate_contracts_by_product_amount", locate_sql(BIG_PROMO, RESULT_TAIL))
def locate_contracts(spark, sf):
    return result_columns(located(spark, sf, BIG_PROMO)).orderBy(*locate.result_order())


@query("locate_contracts_with_exclusions", locate_sql(NOT_SMALL, RESULT_TAIL))
def locate_exclusions(spark, sf):
    return result_columns(located(spark, sf, NOT_SMALL))


@query("locate_top_ranked", locate_sql(BIG_PROMO, """SELECT contract_id, product, amount, hit, rank FROM (
 SELECT contract_id, product, amount, hit, row_number() OVER (ORDER BY
   CASE WHEN document_role IN ('our_response','final_signed') THEN 0 ELSE 9 END,
   CASE content_format WHEN 'native_text' THEN 0 WHEN 'native_pdf_text' THEN 0 WHEN 'native_xlsx_text' THEN 0 WHEN 'mixed' THEN 1
     WHEN 'scanned_ocr' THEN 2 ELSE 3 END,
   CASE WHEN hit THEN 0 ELSE 1 END, coalesce(amount, -1.0) DESC,
   CASE WHEN length(replace(coalesce(contract_date,''),'-','')) < 6 THEN -1
     ELSE CAST(rpad(replace(contract_date,'-',''), 8, '0') AS INT) END DESC, contract_id, product) AS rank FROM results)
 WHERE rank <= 50"""))
def locate_top(spark, sf):
    from pyspark.sql import Window

    top = located(spark, sf, BIG_PROMO).orderBy(*locate.result_order()).limit(50)
    return top.select("contract_id", "product", F.round("amount", 2).alias("amount"), "hit",
                      F.row_number().over(Window.orderBy(*locate.result_order())).alias("rank"))


@query("locate_folded_by_contract", locate_sql(BIG_PROMO, """SELECT contract_id,
  arg_min(product, (-coalesce(amount,-1.0), NOT hit, product)) AS product,
  max(amount) AS amount, arg_min(amount_status, (-coalesce(amount,-1.0), NOT hit, product)) AS amount_status,
  count(*) AS record_count, count(*) FILTER (hit) AS hits FROM results GROUP BY 1"""))
def locate_folded(spark, sf):
    return locate.fold_by_contract(located(spark, sf, BIG_PROMO)).select(
        "contract_id", "product", F.round("amount", 2).alias("amount"), "amount_status", "record_count", "hits")


@query("product_amount_status", with_views("""
SELECT contract_id, p_type AS product_key, CAST(sum(line_amount) FILTER (row_type='detail') AS DOUBLE) AS detail_sum,
 CAST(arg_max(line_amount, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) FILTER (row_type='product_subtotal') AS DOUBLE) AS subtotal_declared,
 coalesce(bool_or(line_amount IS NULL) FILTER (row_type='detail'), FALSE) AS has_unknown,
 count(*) FILTER (row_type='detail') AS detail_rows,
 coalesce(NOT coalesce(bool_or(line_amount IS NULL) FILTER (row_type='detail'), FALSE) AND
   abs(sum(line_amount) FILTER (row_type='detail') - arg_max(line_amount, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) FILTER (row_type='product_subtotal')) > 0.01, FALSE) AS conflict
FROM contract_items GROUP BY ALL"""))
def product_amount_status(spark, sf):
    return amounts.amount_status(v.contract_items(spark, sf)).select(
        "contract_id", "product_key", F.col("detail_sum").cast("double").alias("detail_sum"),
        F.col("subtotal_declared").cast("double").alias("subtotal_declared"), "has_unknown", "detail_rows", "conflict")


@query("derived_missing_amounts", with_views("""
, g AS (SELECT contract_id FROM contract_items GROUP BY 1 HAVING bool_and(row_type <> 'detail' OR (quantity > 0 AND unit_price > 0))
   AND bool_or(row_type = 'detail' AND line_amount IS NULL))
SELECT contract_id, count(*) AS filled, CAST(sum(CAST(quantity AS INT) * unit_price) AS DOUBLE) AS filled_amount
FROM contract_items JOIN g USING (contract_id) WHERE row_type = 'detail' AND line_amount IS NULL GROUP BY 1
"""))
def derived_missing(spark, sf):
    items = v.contract_items(spark, sf)
    before = F.col("product_amount_source")
    got = amounts.derive_missing_amounts(items.withColumn("was_null", F.col("line_amount").isNull()))
    return (got.filter("was_null AND line_amount IS NOT NULL AND row_type = 'detail'").filter(before == rules.DERIVED)
            .groupBy("contract_id").agg(F.count("*").alias("filled"), F.sum("line_amount").cast("double").alias("filled_amount")))


@query("product_rollup_per_contract", with_views("""
SELECT contract_id, product_raw, CAST(sum(line_amount) AS DOUBLE) AS amount,
 arg_max(product_amount_source, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS amount_source,
 count(*) AS detail_rows, count(line_amount) > 0 AS amount_known, count(*) FILTER (line_amount = 0) AS zero_amount_rows,
 bool_or(product_amount_source = 'derived_qty_x_price') AS derived
FROM contract_items WHERE row_type = 'detail' GROUP BY ALL"""))
def product_rollup(spark, sf):
    return amounts.product_rollup(v.contract_items(spark, sf)).withColumn("amount", F.col("amount").cast("double"))


@query("product_family_summary", with_views("""
, r AS (SELECT contract_id, product_raw, p_type, sum(line_amount) AS amount FROM contract_items WHERE row_type = 'detail' GROUP BY ALL)
SELECT p_type AS family, count(*) AS contracts, CAST(sum(amount) AS DOUBLE) AS amount, bool_or(amount IS NOT NULL) AS amount_known
FROM r GROUP BY 1"""))
def product_family_summary(spark, sf):
    roll = amounts.product_rollup(v.contract_items(spark, sf))
    return (amounts.family_summary(roll, amounts.category_of("product_raw"))
            .withColumn("amount", F.col("amount").cast("double")))
