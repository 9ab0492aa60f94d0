"""Batch filters, period joins, overview cards, outlines and module knowledge."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window, functions as F

from docketlens.functions import periods, text as tx
from docketlens.operators import amounts, classify, sections, skew, times
from docketlens.plans import kb, material, modules
from docketlens.session import checkpoint_dir
from docketlens.sources import artifacts, sinks
from workload import views as v
from workload.catalog_queries import CLEAN_SQL
from workload.extraction import MT
from workload.ranking_queries import commitment_texts, slot_sql
from workload.registry import query
from workload.sqlviews import with_views


@query("batch_candidates", with_views("""
SELECT document_id FROM contract_documents WHERE document_role IN ('final_signed','our_response') AND content_format = 'scanned_ocr' AND parse_status = 'done' AND length(relative_path) < 80"""))
def batch_candidates(spark, sf):
    d = v.contract_documents(spark, sf).withColumn("file_size", F.length("relative_path"))
    got = classify.batch_candidates(d, ("final_signed", "our_response"), (".pdf",), ("scanned_ocr",), ("done",), 80)
    return got.select("document_id")


COVERS = """contains(fact_value, '~') AND ((ends_with(fact_value, '~') AND rtrim(fact_value, '~') <= period)
 OR (NOT ends_with(fact_value, '~') AND split_part(fact_value, '~', 1) <= period AND period <= split_part(fact_value, '~', 2)))"""


@query("period_questions_answered", with_views(f"""
, q AS (SELECT event_id AS question_id, event_type AS fact_type, CASE WHEN event_id % 2 = 0 THEN '2024-0' || (event_id % 5 + 1) ELSE '202' || (event_id % 4 + 3) END AS period FROM events)
SELECT question_id, count(*) AS facts, min(event_id) AS first_event FROM q JOIN facts f USING (fact_type) WHERE {COVERS} GROUP BY 1"""))
def period_questions(spark, sf):
    k = F.col("event_id")
    q = v.read(spark, sf, "events").select(
        k.alias("question_id"), F.col("event_type").alias("fact_type"),
        F.when(k % 2 == 0, F.concat(F.lit("2024-0"), (k % 5 + 1).cast("string"))).otherwise(F.concat(F.lit("202"), (k % 4 + 3).cast("string"))).alias("period"))
    return material.covering_counts(v.facts(spark, sf), q, "event_id").withColumnRenamed("first", "first_event")


# Every order asks with its own date: days, months and years from outside any fixed calendar. Facts run from order to ship date.
ORDER_RANGES = """, f AS (SELECT l_orderkey * 8 + l_linenumber AS fact_id, l_returnflag AS fact_type, strftime(o_orderdate, '%Y-%m-%d') || '~' || CASE WHEN l_linenumber % 3 = 0 THEN ''
  WHEN l_linenumber % 3 = 1 THEN strftime(l_shipdate, '%Y-%m') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS fact_value FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
q AS (SELECT o_orderkey AS question_id, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS period FROM orders)"""


def ship_ranges(spark, sf):
    li, o = v.read(spark, sf, "lineitem"), v.read(spark, sf, "orders")
    n = F.col("l_linenumber") % 3
    until = F.when(n == 0, "").when(n == 1, F.date_format("l_shipdate", "yyyy-MM")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fact_id"), F.col("l_returnflag").alias("fact_type"),
                                                            F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("~"), until).alias("fact_value"))


def dated_questions(spark, sf):
    k = F.col("o_orderkey") % 3
    period = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    o, li = v.read(spark, sf, "orders"), v.read(spark, sf, "lineitem")
    modes = li.groupBy("l_orderkey").agg(F.min("l_returnflag").alias("fact_type"))
    return o.join(modes, o.o_orderkey == modes.l_orderkey).select(F.col("o_orderkey").alias("question_id"), "fact_type", period.alias("period"))


# SQL compares each distinct (mode, period) with each distinct range.
@query("dated_questions_counted", f"""WITH x AS (SELECT 1) {ORDER_RANGES},
w AS (SELECT question_id, period, fact_type FROM q JOIN (SELECT l_orderkey, min(l_returnflag) AS fact_type FROM lineitem GROUP BY 1) ON l_orderkey = question_id),
d AS (SELECT fact_type, fact_value, count(*) AS n, min(fact_id) AS least FROM f GROUP BY ALL), p AS (SELECT DISTINCT fact_type, period FROM w),
a AS (SELECT fact_type, period, sum(n) AS facts, min(least) AS first_fact FROM p JOIN d USING (fact_type) WHERE {COVERS} GROUP BY ALL)
SELECT question_id, facts::BIGINT AS facts, first_fact FROM w JOIN a USING (fact_type, period)""")
def dated_questions_counted(spark, sf):
    return material.covering_counts(ship_ranges(spark, sf), dated_questions(spark, sf), "fact_id").withColumnRenamed("first", "first_fact")


@query("fact_period_bounds", with_views("""
SELECT event_id, split_part(fact_value, '~', 1) AS lo, CASE WHEN ends_with(fact_value, '~') THEN NULL WHEN contains(fact_value, '~') THEN split_part(fact_value, '~', 2) ELSE fact_value END AS hi,
 ends_with(fact_value, '~') AS is_open FROM facts WHERE fact_value IS NOT NULL"""))
def fact_period_bounds(spark, sf):
    f = v.facts(spark, sf).withColumn("p", periods.period_struct("fact_value")).filter("p IS NOT NULL")
    return f.select("event_id", "p.lo", "p.hi", "p.is_open")


@query("scanned_periods", with_views(MT + """
SELECT document_id, CASE m WHEN 0 THEN array_to_string(list_sort(list_distinct([ym, '2024-12'])), '|') WHEN 1 THEN '2023' WHEN 3 THEN ym ELSE '' END AS found FROM mt"""))
def scanned_periods(spark, sf):
    got = periods.scan_periods(F.lit("f"), "text")
    return v.material_texts(spark, sf).select("document_id", F.array_join(got, "|").alias("found"))


@query("module_overview", with_views("""
SELECT 'contracts' AS module, count(*) AS items FROM contracts WHERE substr(document_id, 1, 12) IN (SELECT id_prefix FROM approved_documents)
UNION ALL SELECT 'finance', count(*) FROM facts WHERE fact_type IN ('view', 'click') UNION ALL SELECT 'instruments', count(*) FROM facts WHERE fact_type = 'error'"""))
def module_overview(spark, sf):
    return modules.overview(v.contracts(spark, sf), v.facts(spark, sf), v.approved_documents(spark, sf), ("view", "click"), ("error",))


@query("products_by_contract_order", with_views("""
, r AS (SELECT contract_id, product_raw, sum(line_amount) AS amount FROM contract_items WHERE row_type = 'detail' GROUP BY ALL)
SELECT contract_id, product_raw, CAST(amount AS DOUBLE) AS amount, row_number() OVER (PARTITION BY contract_id ORDER BY amount IS NULL, coalesce(amount, 0) DESC, product_raw) AS rank FROM r"""))
def products_ordered(spark, sf):
    roll = amounts.product_rollup(v.contract_items(spark, sf)).select("contract_id", "product_raw", F.col("amount").cast("double").alias("amount"))
    return roll.withColumn("rank", F.row_number().over(Window.partitionBy("contract_id").orderBy(*modules.product_order())))


@query("requirements_ranked", with_views(slot_sql() + """
SELECT document_id, module, slot, minutes, row_number() OVER (PARTITION BY module ORDER BY NOT mandatory, minutes, document_id, slot) AS rank FROM ct"""))
def requirements_ranked(spark, sf):
    """Mandatory requirements first, then the strictest; a module with very many is numbered over range slices."""
    texts = commitment_texts(spark, sf)
    found = times.time_requirements(texts, ["document_id"]).join(texts.select("document_id", "module"), "document_id")
    late, minutes = times.requirement_order()
    rows = found.withColumns({"_late": late, "_minutes": minutes}).select("document_id", "module", "slot", "minutes", "_late", "_minutes")
    return skew.number_rows(rows, ["module"], ["_late", "_minutes", "document_id", "slot"], "rank").drop("_late", "_minutes")


@query("turns_exported_and_read", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, md5(text) AS text_hash FROM conversations WHERE text <> ''")
def turns_exported(spark, sf):
    """Whole texts with quotes and line breaks through the CSV export and back."""
    folder = f"{checkpoint_dir(spark)}/export-{uuid4().hex}"
    sinks.write_csv(v.read(spark, sf, "conversations").filter("text <> ''"), folder, {"conv_id": "会话", "turn": "轮次", "text": "正文"})
    back = spark.read.schema("conv_id string, turn string, text string").option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    return back.select("conv_id", "turn", F.md5("text").alias("text_hash"))


@query("counts_reported_and_read", "SELECT event_type AS fact_type, count(*) AS facts FROM events GROUP BY 1")
def counts_reported(spark, sf):
    folder = f"{checkpoint_dir(spark)}/report-{uuid4().hex}"
    sinks.write_report(v.facts(spark, sf).groupBy("fact_type").agg(F.count("*").alias("facts")), folder)
    return spark.read.schema("fact_type string, facts long").json(folder)


@query("extraction_outcomes", f"""WITH {CLEAN_SQL}
SELECT page_id AS document_id, CASE WHEN page_id % 7 <> 0 OR sha256(html) IN (SELECT sha256(html) FROM pages WHERE page_id % 7 <> 0) THEN md5(t) END AS text_hash FROM d""")
def extraction_outcomes(spark, sf):
    """Every page with the text of its artifact; pages without an artifact stay, without a text."""
    pages = v.read(spark, sf, "pages").select(F.col("page_id").alias("document_id"), F.col("html").alias("content"), F.sha2("html", 256).alias("sha256"))
    none = spark.createDataFrame([], "sha256 string, parser_name string, parser_version string")
    return artifacts.outcomes(pages, artifacts.extract_html(pages.filter("document_id % 7 <> 0"), none)).select("document_id", F.md5("text").alias("text_hash"))


@query("material_models_asked", with_views("""
SELECT 'resolved' AS question, event_id FROM facts JOIN fact_documents USING (document_id) WHERE fact_type = 'view' AND (fact_value ILIKE '%2024-01%' OR fact_value ILIKE '%~2024-03%')"""))
def material_models_asked(spark, sf):
    """Several models are an OR; a question that could not be resolved answers nothing, never everything."""
    f, d = v.facts(spark, sf), v.fact_documents(spark, sf)
    asked = {"resolved": material.FactCondition("view", models=("2024-01", "~2024-03")), "unresolved": material.FactCondition("view", unresolved=True)}
    got = [material.material_facts(f, d, c).select(F.lit(n).alias("question"), "event_id") for n, c in asked.items()]
    return got[0].unionByName(got[1])


OUT = """
, ln AS (SELECT doc_id, i AS line_no, trim(l[i]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
h AS (SELECT *, (line_no - 1) % 4 = 0 AND line <> '' AND length(line) <= 40 AND NOT contains(line, '|') AND NOT contains(line, chr(9)) AND NOT regexp_matches(line, '[。；！？!?；]\\s*$') AS is_h FROM ln),
rp AS (SELECT doc_id, line FROM ln WHERE line <> '' AND length(line) <= 40 GROUP BY 1, 2 HAVING count(*) >= 5),
g AS (SELECT *, sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seq FROM h),
s AS (SELECT doc_id, seq, min(line_no) AS line_no, arg_min(line, line_no) AS heading, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_h AND line <> ''), '') AS body FROM g WHERE seq > 0 GROUP BY ALL)
"""


@query("outline_sections", with_views(OUT + """
SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(line_no AS INT) AS line_no, md5(body) AS body_hash, 'word_outline' AS boundary_source FROM s
WHERE length(body) >= 40 AND NOT (length(heading) < 30 AND EXISTS (SELECT 1 FROM rp WHERE rp.doc_id = s.doc_id AND rp.line = s.heading))"""))
def outline_sections(spark, sf):
    d = v.read_spread(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    marks = F.filter(F.transform(F.split("text", "\n"), lambda s, i: F.when(i % 4 == 0, F.struct((i + 1).alias("line"), F.lit(1).alias("level"), F.lit("H").alias("style")))),
                     lambda m: m.isNotNull())
    got = sections.cut_sections(d.withColumn("outline", marks), ["document_id"], outline="outline")
    return got.select("document_id", "line_no", F.md5("section_text").alias("body_hash"), "boundary_source")


@query("text_commitments_by_source", """
SELECT source AS module, '响应' AS slot, count(DISTINCT doc_id % 40) AS distinct_values, CAST(min(doc_id % 40 + 1) * 60 AS DOUBLE) AS strictest,
 CAST(max(doc_id % 40 + 1) * 60 AS DOUBLE) AS longest, count(DISTINCT doc_id % 40) > 1 AS conflict FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def text_commitments(spark, sf):
    """Time mentions in the documents themselves, with a unit word appended to their numbers."""
    d = v.read_spread(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("module"), F.concat("text", F.lit("。响应"), (F.col("doc_id") % 40 + 1).cast("string"), F.lit("小时")).alias("text"))
    return kb.commitment_slots(kb.commitment_values(d, ["module"], "document_id", "text"), ["module"])


@query("project_summaries", with_views("SELECT DISTINCT project_folder, c_mktsegment AS summary FROM order_paths"))
def project_summaries(spark, sf):
    return v.order_paths(spark, sf).select("project_folder").distinct().select("project_folder", classify.project_summary("project_folder").alias("summary"))


@query("document_line_counts", """WITH t AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) - CASE WHEN t LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS lines FROM t""")
def line_counts(spark, sf):
    return v.read(spark, sf, "documents").select("doc_id", F.size(tx.lines("text")).alias("lines"))
