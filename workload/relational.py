"""Claims, mentions, payments, material facts, saved queries and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlens.plans import answer, locate, material, mention, modules, saved, track
from workload import views as v
from workload.contracts import RESULT_TAIL, any_of, located, locate_sql, result_columns
from workload.registry import query
from workload.sqlviews import with_views

CLAIM = track.ClaimCondition(party="Buyer 1", products=("BUILDING", "MACHINERY"), year="199", min_amount=60_000)
CLAIM_SQL = """
, f AS (SELECT c.*, d.relative_path, d.project_folder, d.content_format, d.document_role,
   CASE WHEN total_amount IS NULL THEN 'no_amount' WHEN total_amount < 60000 THEN 'below_amount' ELSE 'shown' END AS disposition
 FROM claims c JOIN contract_documents d USING (document_id)
 WHERE d.document_role IN ('our_response','final_signed') AND contains(party_a, 'Buyer 1')
   AND (contains(evidence_text, 'BUILDING') OR contains(evidence_text, 'MACHINERY')) AND contains(evidence_text, '199'))"""


def claim_rows(spark, sf, cond=CLAIM):
    return track.filtered_claims(v.claims(spark, sf), v.contract_documents(spark, sf), cond)


@query("claim_dispositions", with_views(CLAIM_SQL + "SELECT disposition, count(*) AS claims FROM f GROUP BY 1"))
def claim_dispositions(spark, sf):
    return track.disposition_counts(claim_rows(spark, sf))


ALL_SHOWN = track.ClaimCondition(min_amount=0)
FOLD_SQL = """
, f AS (SELECT c.*, d.relative_path, d.project_folder, d.content_format, d.document_role,
   CASE WHEN evidence_text <> '' THEN evidence_text ELSE party_a || '|' || coalesce(CAST(total_amount AS VARCHAR), 'None') || '|' || ordinal END AS k
 FROM claims c JOIN contract_documents d USING (document_id) WHERE d.document_role IN ('our_response','final_signed')),
g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY party_a, contract_id) AS rn, count(*) OVER (PARTITION BY k) AS copy_count FROM f)"""


@query("claims_folded", with_views(FOLD_SQL + """
SELECT contract_id, party_a, CAST(total_amount AS DOUBLE) AS amount, copy_count, relative_path,
 CASE WHEN contains(evidence_text, '项目:') THEN split_part(split_part(evidence_text, '项目:', 2), ' 采购人:', 1) ELSE '' END AS project,
 CASE WHEN total_amount IS NULL AND contains(evidence_text, '本行未取到') THEN '本行未取到' ELSE '' END AS amount_absent
FROM g WHERE rn = 1"""))
def claims_folded(spark, sf):
    reps, _ = track.track_records(claim_rows(spark, sf, ALL_SHOWN))
    return reps.select("contract_id", "party_a", F.col("total_amount").cast("double").alias("amount"), "copy_count",
                       "relative_path", "project", "amount_absent")


@query("claim_copies", with_views(FOLD_SQL + "SELECT contract_id, relative_path, document_id, project_folder FROM g WHERE rn > 1"))
def claim_copies(spark, sf):
    _, also = track.track_records(claim_rows(spark, sf, ALL_SHOWN))
    return also.select("contract_id", "relative_path", "document_id", "project_folder")


@query("claims_capped_list", with_views(FOLD_SQL + """
SELECT contract_id, party_a, copy_count FROM g WHERE rn = 1 ORDER BY party_a, contract_id LIMIT 40"""))
def claims_capped(spark, sf):
    reps, _ = track.track_records(claim_rows(spark, sf, ALL_SHOWN))
    return track.capped(reps, 40)[0].select("contract_id", "party_a", "copy_count")


@query("claims_cap_totals", with_views(FOLD_SQL + """
SELECT count(*) FILTER (rn = 1) AS folded, count(*) AS raw, count(*) FILTER (rn > 1) AS folded_copies,
 count(*) FILTER (rn = 1) > 40 AS truncated FROM g"""))
def claims_totals(spark, sf):
    reps, _ = track.track_records(claim_rows(spark, sf, ALL_SHOWN))
    return track.capped(reps, 40)[1]


MENTION = locate.LocateCondition(keywords=("thion", "reti"), date_from="2024-02", date_to="2024-10",
                                 party_exclude=("src7",), product_exclude=("ouqueaux",))
MENTION_WORDS = ("and", "tion", "the on")
MENTION_SQL = f"""
, p AS (SELECT document_id, contract_id, contract_date, total_amount, party_a, text, alias
  FROM text_contracts JOIN text_documents USING (document_id), (VALUES ('thion'), ('reti')) a(alias)
  WHERE NOT contains(party_a || '|' || party_b, 'src7') AND contract_date >= '2024-02' AND contract_date <= '2024-10'
   AND document_role <> 'tender_requirement' AND NOT contains(text, 'ouqueaux') AND contains(text, alias)),
h AS (SELECT *, list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(alias)) = alias
   AND {any_of("substr(text, greatest(1, i - 12), least(i - 1, 12) + length(alias) + 12)", MENTION_WORDS)})[1] AS i FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY alias = 'reti') AS rn FROM h WHERE i IS NOT NULL),
m AS (SELECT contract_id, document_id, party_a, total_amount, contract_date,
  substr(trim(CASE WHEN contains(substr(text, i + length(alias)), chr(10))
   THEN substr(text, i - length(regexp_extract(substr(text, 1, i - 1), '[^\\n]*$')), length(regexp_extract(substr(text, 1, i - 1), '[^\\n]*$')) + length(alias)
      + instr(substr(text, i + length(alias)), chr(10)) - 1)
   ELSE substr(text, i - length(regexp_extract(substr(text, 1, i - 1), '[^\\n]*$')), length(regexp_extract(substr(text, 1, i - 1), '[^\\n]*$')) + length(alias) + 60) END), 1, 200) AS evidence_snippet
 FROM b WHERE rn = 1 AND contract_id NOT IN (SELECT contract_id FROM text_contract_items WHERE contains(product_raw, 'thion') OR contains(product_raw, 'reti')))
"""


def mentions(spark, sf, answered=None):
    docs = v.text_documents(spark, sf)
    catalog = docs.select("document_id", "relative_path", "project_folder", "document_role", "content_format",
                          F.lit("done").alias("parse_status"), F.lit("").alias("doc_subtype"),
                          F.col("document_id").alias("canonical_document_id"))
    texts = docs.select(F.col("document_id").alias("canonical_document_id"), "text")
    return mention.mention_contracts(v.text_contracts(spark, sf), catalog, texts, v.text_contract_items(spark, sf),
                                     MENTION, "thion", answered, words=MENTION_WORDS)


@query("mention_contracts", with_views(MENTION_SQL + "SELECT contract_id, evidence_snippet FROM m"))
def mention_contracts(spark, sf):
    return mentions(spark, sf).select("contract_id", "evidence_snippet")


@query("mention_top", with_views(MENTION_SQL + """SELECT contract_id, CAST(total_amount AS DOUBLE) AS total_amount FROM m
 ORDER BY m.total_amount DESC, contract_date DESC, contract_id LIMIT 30"""))
def mention_top(spark, sf):
    return (mentions(spark, sf).orderBy(*mention.mention_order()).limit(30)
            .select("contract_id", F.col("total_amount").cast("double").alias("total_amount")))


@query("contract_answer_groups", locate_sql(
    locate.LocateCondition(keywords=("PROMO",), min_amount=60_000), MENTION_SQL + """
, answer_claims AS (SELECT contract_id, CAST(c.document_id AS VARCHAR) AS document_id, party_a, CAST(total_amount AS DOUBLE) AS amount
   FROM claims c JOIN contract_documents d USING (document_id) WHERE d.document_role IN ('our_response','final_signed') AND total_amount >= 150000)
SELECT 'contracts' AS result_group, contract_id, document_id, party_a, amount FROM results WHERE hit
UNION ALL SELECT 'claims', contract_id, document_id, party_a, amount FROM answer_claims
UNION ALL SELECT 'mentions', contract_id, CAST(document_id AS VARCHAR), party_a, CAST(total_amount AS DOUBLE) FROM m
 WHERE document_id NOT IN (SELECT document_id FROM text_contracts JOIN text_contract_items USING (contract_id) WHERE product_raw = 'other/basic')"""))
def contract_answer(spark, sf):
    hits = located(spark, sf, locate.LocateCondition(keywords=("PROMO",), min_amount=60_000)).filter("hit")
    shown = claim_rows(spark, sf, track.ClaimCondition(min_amount=150_000)).filter("disposition = 'shown'")
    other = v.text_contract_items(spark, sf).filter("product_raw = 'other/basic'").join(v.text_contracts(spark, sf), "contract_id").select("document_id")
    named = mentions(spark, sf, other).withColumn("document_id", F.col("document_id").cast("string"))
    return answer.contract_answer(hits, shown, named).withColumn("amount", F.round("amount", 2))


@query("payment_status", with_views("""
, n AS (SELECT max(contract_number) AS contract_number, translate(upper(contract_number), 'OIL', '011') AS k FROM contracts GROUP BY 2),
v AS (SELECT n.contract_number, arg_max(CASE WHEN contains(payee, '未到款') THEN 'no' WHEN pay_time <> '' THEN 'yes' ELSE 'unknown' END, record_no) AS has_payment
  FROM vouchers x JOIN n ON n.k = translate(upper(x.contract_number), 'OIL', '011') GROUP BY 1),
r AS (SELECT contract_number, count(*) AS receipt_count FROM receipts GROUP BY 1)
SELECT c.contract_number, coalesce(receipt_count, 0) AS receipt_count,
 CASE WHEN has_payment IS NOT NULL THEN has_payment WHEN receipt_count > 0 THEN 'receipt_file' ELSE 'ledger_absent' END AS payment_status
FROM contracts c LEFT JOIN v USING (contract_number) LEFT JOIN r USING (contract_number)"""))
def payment_status(spark, sf):
    c = v.contracts(spark, sf)
    pay = modules.match_numbers(v.vouchers(spark, sf), c).withColumn("has_payment", modules.voucher_state("payee", "pay_time"))
    rec = modules.match_numbers(v.receipts(spark, sf), c)
    return modules.payment_status(c, pay, rec).select("contract_number", "receipt_count", "payment_status")


@query("approved_contracts_newest", with_views("""
SELECT contract_id, contract_date FROM contracts WHERE substr(document_id, 1, 12) IN (SELECT id_prefix FROM approved_documents)
ORDER BY contract_date DESC NULLS LAST, contract_id LIMIT 100"""))
def approved_newest(spark, sf):
    got = modules.approved_contracts(v.contracts(spark, sf), v.approved_documents(spark, sf))
    return modules.newest_contracts(got, 100).select("contract_id", "contract_date")


@query("contract_kind_counts", with_views("""
SELECT 'CTL' AS kind, count(*) AS contracts FROM contracts UNION ALL SELECT 'LEDGER', count(*) FROM claims"""))
def contract_kinds(spark, sf):
    both = v.contracts(spark, sf).select("contract_id").unionByName(v.claims(spark, sf).select("contract_id"))
    return modules.kind_counts(both)


FACT = material.FactCondition(fact_type="click", fact_value="2024-01")
FACT_SQL = """
, j AS (SELECT f.*, d.relative_path, d.project_folder, d.document_role,
  CASE WHEN contains(evidence_text, '] ') AND trim(split_part(evidence_text, '] ', 2)) <> '' AND ends_with(relative_path, trim(split_part(evidence_text, '] ', 2))) THEN 1
       WHEN NOT contains(evidence_text, '] ') AND (trim(evidence_text) = '' OR ends_with(relative_path, trim(evidence_text))) THEN 1 ELSE 0 END AS shell,
  CASE WHEN coalesce(fact_value, '') = '' THEN 1 ELSE 0 END AS no_value
 FROM facts f JOIN fact_documents d USING (document_id)),
e AS (SELECT * FROM j WHERE fact_type = 'click' AND contains(fact_value, '2024-01'))"""


def fact_rows(spark, sf):
    return material.material_facts(v.facts(spark, sf), v.fact_documents(spark, sf), FACT, ("click",))


@query("material_facts_page", with_views(FACT_SQL + """
SELECT event_id, fact_value, relative_path FROM e ORDER BY shell, no_value, relative_path, event_id LIMIT 50"""))
def material_page(spark, sf):
    rows, _ = material.first_page(fact_rows(spark, sf), 50, material.fact_order() + [F.col("event_id")])
    return rows.select("event_id", "fact_value", "relative_path")


@query("material_facts_totals", with_views(FACT_SQL + "SELECT count(*) AS total_available, count(*) > 50 AS truncated FROM e"))
def material_totals(spark, sf):
    return material.first_page(fact_rows(spark, sf), 50, material.fact_order())[1]


@query("material_facts_related", with_views(FACT_SQL + """
SELECT event_id, fact_value FROM j WHERE fact_type = 'click' AND contains(fact_value, '~')
 AND ((ends_with(fact_value, '~') AND rtrim(fact_value, '~') <= '2024-02') OR (NOT ends_with(fact_value, '~') AND split_part(fact_value,'~',1) <= '2024-02' AND '2024-02' <= split_part(fact_value,'~',2)))
 AND (relative_path, evidence_text) NOT IN (SELECT (relative_path, evidence_text) FROM j WHERE fact_type = 'click' AND contains(fact_value, '2024-02'))"""))
def material_related(spark, sf):
    cond = material.FactCondition(fact_type="click", fact_value="2024-02")
    facts, docs = v.facts(spark, sf), v.fact_documents(spark, sf)
    exact = material.material_facts(facts, docs, cond, ())
    return material.related_facts(facts, docs, cond, exact).select("event_id", "fact_value")


@query("material_facts_by_file", with_views(FACT_SQL + """
SELECT relative_path, count(*) AS record_count, count(DISTINCT coalesce(fact_value, '')) AS period_values,
 min(fact_value) AS first_period, max(fact_value) AS last_period, min(event_id) AS event_id FROM j GROUP BY 1"""))
def material_by_file(spark, sf):
    rows = v.facts(spark, sf).join(v.fact_documents(spark, sf), "document_id")
    files, _ = material.fold_by_file(rows.withColumn("ord", F.col("event_id")), "ord")
    return files.select("relative_path", "record_count", "period_values", "first_period", "last_period", "event_id")


@query("material_file_periods", with_views(FACT_SQL + """
SELECT relative_path, coalesce(fact_value, '') AS period, count(*) AS facts FROM j GROUP BY 1, 2"""))
def material_periods(spark, sf):
    rows = v.facts(spark, sf).join(v.fact_documents(spark, sf), "document_id")
    _, periods = material.fold_by_file(rows.withColumn("ord", F.col("event_id")), "ord")
    return periods.select("relative_path", F.coalesce("fact_value", F.lit("")).alias("period"), "facts")


@query("material_roles_annotated", with_views(FACT_SQL + """
SELECT event_id, CASE WHEN document_role = 'our_response' THEN 'our' WHEN document_role = 'tender_requirement' THEN 'tender' ELSE 'other' END AS role_scope,
 shell = 1 AND evidence_text <> '' AS evidence_is_filename,
 CASE WHEN shell = 1 THEN '' ELSE trim(regexp_replace(evidence_text, '^\\[[a-z_]+\\]\\s*', '')) END AS evidence
FROM j"""))
def material_roles(spark, sf):
    rows = v.facts(spark, sf).join(v.fact_documents(spark, sf), "document_id")
    return material.annotate_role(rows).select("event_id", "role_scope", "evidence_is_filename",
                                               F.col("evidence_text").alias("evidence"))


@query("material_type_counts", with_views(FACT_SQL + """
SELECT fact_type, count(*) AS facts, count(*) FILTER (document_role = 'our_response') AS our,
 count(*) FILTER (document_role = 'tender_requirement') AS tender, count(*) FILTER (document_role = 'process_material') AS other
FROM j WHERE fact_type IN ('view','error','click') GROUP BY 1"""))
def material_type_counts(spark, sf):
    return material.type_counts(v.facts(spark, sf), v.fact_documents(spark, sf), ("view", "error", "click"))


SAVED = {
    "S1": locate.LocateCondition(("PROMO",), 50_000), "S2": locate.LocateCondition(("LARGE", "widget"), 30_000, "1997-01", "1999-12"),
    "S3": locate.LocateCondition(("SMALL",), 20_000, product_exclude=("PROMO", "LARGE")),
    "S4": locate.LocateCondition(("ring",), 0, match_exclude=("small ring",)),
    "S5": locate.LocateCondition(("ECONOMY",), 90_000, party_include=("Customer#0000001",)),
    "S6": locate.LocateCondition(("bolt",), 10_000, party_exclude=("Supplier#00000000",)),
}


def saved_sql(tail: str) -> str:
    parts = []
    for name, c in SAVED.items():
        kw = lambda e: any_of(e, c.keywords)
        where = ["TRUE"]
        if c.party_include:
            where.append(any_of("(coalesce(party_a,'') || '|' || coalesce(party_b,''))", c.party_include))
        if c.party_exclude:
            where.append("NOT " + any_of("(coalesce(party_a,'') || '|' || coalesce(party_b,''))", c.party_exclude))
        if c.date_from:
            where.append(f"contract_date >= '{c.date_from}'")
        if c.date_to:
            where.append(f"contract_date <= '{c.date_to}'")
        if c.product_exclude:
            where.append(f"contract_id NOT IN (SELECT contract_id FROM contract_items WHERE row_type='detail' AND {any_of('product_raw', c.product_exclude)})")
        parts.append(f"""SELECT '{name}' AS query_id, contract_id, contract_number, product, CAST(amount AS DOUBLE) AS amount, amount_status,
  coalesce(amount_status = 'ok' AND amount >= {c.min_amount}, FALSE) AS hit FROM (
  SELECT contract_id, product, CASE WHEN by_category OR NOT u THEN d END AS amount,
   CASE WHEN u THEN 'unknown' WHEN by_category AND abs(d - s) > 0.01 THEN 'conflict' ELSE 'ok' END AS amount_status FROM (
   SELECT i.contract_id, k.product, k.by_category, sum(line_amount) FILTER (row_type='detail') AS d,
    coalesce(bool_or(line_amount IS NULL) FILTER (row_type='detail'), FALSE) AS u,
    arg_max(line_amount, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) FILTER (row_type='product_subtotal' AND line_amount IS NOT NULL) AS s
   FROM contract_items i JOIN (SELECT DISTINCT contract_id, CASE WHEN {kw('p_type')} THEN p_type ELSE p_name END AS product, {kw('p_type')} AS by_category
     FROM contract_items WHERE row_type='detail' AND NOT {any_of('product_raw', c.match_exclude)} AND ({kw('p_type')} OR {kw('p_name')})) k
   ON i.contract_id = k.contract_id AND contains(CASE WHEN by_category THEN i.p_type ELSE i.product_raw END, k.product) GROUP BY ALL))
  JOIN contracts USING (contract_id) WHERE {' AND '.join(where)}""")
    return with_views(", sr AS (" + "\nUNION ALL ".join(parts) + ")\n" + tail)


@query("saved_queries_results", saved_sql("SELECT query_id, contract_id, product, amount, amount_status, hit FROM sr"))
def saved_results(spark, sf):
    return saved.locate_many(v.contract_items(spark, sf), v.contracts(spark, sf), saved.condition_table(spark, SAVED)).select(
        "query_id", "contract_id", "product", F.round("amount", 2).alias("amount"), "amount_status", "hit")


@query("saved_queries_gated", "\nUNION ALL ".join(f"SELECT '{n}' AS query_id, * FROM ({locate_sql(c, RESULT_TAIL)})" for n, c in SAVED.items()))
def saved_gated(spark, sf):
    """Every saved condition with the qualification gate: hits, non-hits, rejected and line-less contracts."""
    rows = saved.locate_all(v.contract_items(spark, sf), v.contracts(spark, sf), v.contract_documents(spark, sf), v.contract_artifacts(spark, sf),
                            saved.condition_table(spark, SAVED), v.approved_documents(spark, sf))
    return result_columns(rows, "query_id")


@query("gold_path_suffix_join", with_views("""
SELECT document_id, 'D:\\archive\\' || source_root_id || '\\' || replace(relative_path, '/', '\\') AS source_path
FROM order_paths WHERE o_orderkey % 5 = 0"""))
def gold_paths(spark, sf):
    cat = v.contract_documents(spark, sf)
    gold = cat.filter(F.col("o_orderkey") % 5 == 0).select(F.concat(
        F.lit("D:\\archive\\"), "source_root_id", F.lit("\\"),
        F.replace("relative_path", F.lit("/"), F.lit("\\"))).alias("source_path"))
    return modules.suffix_matches(gold, cat)


@query("catalog_set_operations", with_views("""
, a AS (SELECT relative_path FROM order_paths WHERE o_orderkey % 2 = 0), b AS (SELECT relative_path FROM order_paths WHERE o_orderkey % 3 = 0)
SELECT 'only_scanned' AS part, count(*) AS paths FROM a WHERE relative_path NOT IN (SELECT relative_path FROM b)
UNION ALL SELECT 'both', count(*) FROM a WHERE relative_path IN (SELECT relative_path FROM b)
UNION ALL SELECT 'only_known', count(*) FROM b WHERE relative_path NOT IN (SELECT relative_path FROM a)"""))
def catalog_sets(spark, sf):
    from docketlens.sources import catalog

    o = v.order_paths(spark, sf)
    return catalog.set_report(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"), ["relative_path"]).select(
        "part", F.col("rows").alias("paths"))
