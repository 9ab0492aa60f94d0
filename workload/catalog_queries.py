"""Identity, catalog, classification and gates."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from docketlens import rules
from docketlens.functions import text as tx
from docketlens.operators import classify, identity, near_copies, sections
from docketlens.plans import batches
from docketlens.session import checkpoint_dir, cut_lineage
from docketlens.sources import artifacts as art, catalog, compare, sinks
from docketlens.streaming import catalog_stream
from workload import views as v
from workload.registry import query
from workload.sqlviews import with_views

PAGES = """
, pl AS (SELECT page_id, split_part(url, ':', 1) AS source_root_id, CASE WHEN page_id % 4 = 0 THEN './' ELSE '' END
   || replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/en/', CASE WHEN page_id % 3 = 0 THEN '\\' ELSE '/en/' END) AS relative_path,
   length(html) AS file_size, page_id * 10 AS file_mtime, html FROM pages)"""


def page_listing(spark, sf):
    k = F.col("page_id")
    rel = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return v.read(spark, sf, "pages").select(
        "page_id", F.substring_index("url", ":", 1).alias("source_root_id"),
        F.concat(F.when(k % 4 == 0, "./").otherwise(""), F.replace(rel, F.lit("/en/"), F.when(k % 3 == 0, "\\").otherwise("/en/"))).alias("relative_path"),
        F.length("html").alias("file_size"), (k * 10).alias("file_mtime"), "html")


@query("document_ids", with_views(PAGES + """
SELECT page_id, sha256('["' || source_root_id || '", "' || regexp_replace(replace(relative_path, '\\', '/'), '^[./]+', '') || '"]') AS document_id,
  sha256(html) AS content_hash FROM pl"""))
def document_ids(spark, sf):
    return page_listing(spark, sf).select("page_id", identity.document_id("source_root_id", "relative_path").alias("document_id"),
                                          identity.content_hash("html").alias("content_hash"))


@query("canonical_artifacts", """SELECT sha256(text) AS sha256, 'p' AS parser_name, CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '2' END AS parser_version,
 min(doc_id) AS artifact_id, count(*) AS copies FROM documents GROUP BY ALL""")
def canonical_artifacts(spark, sf):
    d = v.read(spark, sf, "documents").select(F.col("doc_id").alias("artifact_id"), F.sha2("text", 256).alias("sha256"),
                                              F.lit("p").alias("parser_name"), F.when(F.col("doc_id") % 2 == 0, "1").otherwise("2").alias("parser_version"))
    return identity.canonical_artifacts(d)


STORED = PAGES + """
, one AS (SELECT source_root_id, relative_path, arg_max(file_size, page_id) AS file_size, max(file_mtime) AS file_mtime, max(page_id) AS page_id FROM pl GROUP BY ALL),
st AS (SELECT source_root_id, relative_path, CASE WHEN page_id % 5 = 0 THEN file_size + 1 ELSE file_size END AS file_size, file_mtime FROM one WHERE page_id % 3 <> 0),
dl AS (SELECT one.*, CASE WHEN st.file_size IS NULL THEN 'insert' WHEN st.file_size <> one.file_size THEN 'update_meta' ELSE 'keep' END AS action
  FROM one LEFT JOIN st USING (source_root_id, relative_path))"""


def deltas(spark, sf):
    one = page_listing(spark, sf).groupBy("source_root_id", "relative_path").agg(
        F.max_by("file_size", "page_id").alias("file_size"), F.max("file_mtime").alias("file_mtime"), F.max("page_id").alias("page_id"))
    stored = one.filter("page_id % 3 <> 0").select(
        "source_root_id", "relative_path", F.when(F.col("page_id") % 5 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"), "file_mtime")
    return catalog.catalog_delta(one, stored), stored


@query("catalog_delta_counts", with_views(STORED + "SELECT action, count(*) AS rows FROM dl GROUP BY 1"))
def catalog_delta_counts(spark, sf):
    return catalog.action_counts(deltas(spark, sf)[0])


@query("catalog_limited_inserts", with_views(STORED + "SELECT source_root_id, relative_path FROM dl WHERE action = 'insert' ORDER BY 1, 2 LIMIT 20"))
def catalog_inserts(spark, sf):
    return catalog.limited_inserts(deltas(spark, sf)[0], 20).select("source_root_id", "relative_path")


@query("catalog_next_snapshot", with_views(STORED + """
SELECT source_root_id, relative_path, file_size, file_mtime FROM one"""))
def catalog_next(spark, sf):
    delta, stored = deltas(spark, sf)
    return catalog.next_catalog(delta, stored).select("source_root_id", "relative_path", "file_size", "file_mtime")


@query("page_images_suppressed", """
SELECT DISTINCT 'x/scan-' || l_orderkey || '-35,00' || l_linenumber || '_0' || l_linenumber || '.jpg' AS relative_path FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM lineitem p JOIN orders ON p.l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND p.l_orderkey = lineitem.l_orderkey AND p.l_linenumber = lineitem.l_linenumber)""")
def page_images(spark, sf):
    li, o = v.read(spark, sf, "lineitem"), v.read(spark, sf, "orders").filter("o_orderstatus = 'F'")
    stem = F.concat(F.lit("x/scan-"), F.col("l_orderkey").cast("string"), F.lit("-35,00"), F.col("l_linenumber").cast("string"))
    images = li.select(F.concat(stem, F.lit("_0"), F.col("l_linenumber").cast("string"), F.lit(".jpg")).alias("relative_path")).distinct()
    done = li.join(o, li.l_orderkey == o.o_orderkey, "left_semi").select(F.concat(F.upper(stem), F.lit(".PDF")).alias("relative_path"))
    return identity.drop_page_images(images, done)


@query("batch_picks", """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY floor(n_chars / 2000) ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS q FROM b WHERE r = 1)
SELECT doc_id, n_chars, source FROM p WHERE q = 1 ORDER BY n_chars DESC, doc_id LIMIT 10""")
def batch_picks(spark, sf):
    return identity.pick_batch(v.read(spark, sf, "documents").select("doc_id", "n_chars", "source"), "n_chars", "source", "doc_id", 2000, 10)


@query("facts_inserted_if_absent", with_views("""
, n AS (SELECT document_id, fact_type, evidence_text, min(event_id) AS event_id FROM facts WHERE event_id % 2 = 0 GROUP BY ALL)
SELECT document_id, fact_type, evidence_text, event_id FROM n WHERE NOT EXISTS (SELECT 1 FROM facts e WHERE e.event_id % 2 = 1
 AND e.document_id = n.document_id AND e.fact_type = n.fact_type AND e.evidence_text = n.evidence_text)"""))
def facts_inserted(spark, sf):
    f = v.facts(spark, sf).select("document_id", "fact_type", "evidence_text", "event_id")
    return identity.insert_if_absent(f.filter("event_id % 2 = 1"), f.filter("event_id % 2 = 0"), ["document_id", "fact_type", "evidence_text"])


@query("stable_row_ids", with_views("""
, x AS (SELECT contract_id, row_number() OVER (PARTITION BY contract_id, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n, l_linenumber FROM contract_items)
SELECT contract_id || '-' || l_linenumber || CASE WHEN n > 1 THEN '-r' || n ELSE '' END AS item_id FROM x"""))
def stable_row_ids(spark, sf):
    # Numbering writes its rows: only what the ids are made of goes there.
    items = v.contract_items(spark, sf).select("contract_id", F.col("row_order.a").alias("seq"), "row_order")
    return identity.row_ids(items, "contract_id", "seq", "row_order").select("item_id")


@query("turn_similarity", """
WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^0-9a-z一-鿿]+', '', 'g') AS s FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 4 THEN [s] ELSE list_distinct(list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4))) END AS g FROM t),
p AS (SELECT a.conv_id, a.turn, a.g AS x, b.g AS y, len(list_intersect(a.g, b.g)) AS i FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE i / (len(x) + len(y) - i) END, 6) AS similarity FROM p""")
def turn_similarity(spark, sf):
    c = v.read(spark, sf, "conversations").select("conv_id", "turn", tx.shingles("text").alias("g"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("h"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


@query("near_duplicate_clusters")
def near_duplicates(spark, sf):
    return near_copies.clusters(v.read_spread(spark, sf, "documents").select("doc_id", "n_chars", "text"))


OURS, RIVAL = "蓝鲸生物", "红杉基因"
VENDORS = rules.Vendors(ours=(OURS,), competitors=(RIVAL,), our_label=OURS)
PATHS = [  # (path inside the project, expected role, expected reason)
    ("Thumbs.db", "system_or_temp", "system_file"), ("资料/a.exe", "system_or_temp", "system_extension"),
    ("合同/YX2024010101-检测-大学-35,000.00.pdf", "contract_evidence", "order_number_and_amount"),
    ("dzfp_1.pdf", "process_material", "electronic_invoice"), ("x/银行回单.pdf", "process_material", "receipt"),
    ("x/招标文件.docx", "tender_requirement", "tender"), ("x/营业执照.pdf", "qualification_evidence", "qualification"),
    ("x/合同盖章.pdf", "contract_evidence", "contract_attachment"), ("x/封面.docx", "process_material", "cover"),
    ("x/发票签章版.pdf", "process_material", "signing_auxiliary"), (f"{RIVAL}/{OURS}.docx", "unknown", "vendor_conflict"),
    (f"{RIVAL}/报价表.docx", "competitor_response", "competitor_folder"), (f"x/{RIVAL}方案.docx", "competitor_response", "competitor_name"),
    ("x/多家公司签章响应文件.pdf", "unknown", "pending_several_vendors"), (f"{OURS}/响应文件最终版.pdf", "final_signed", "final_response"),
    ("x/最终版.pdf", "unknown", "pending_no_response_identity"), ("x/技术部分.docx", "our_response", "response_part"),
    (f"{OURS}/b.docx", "our_response", "our_folder"), (f"x/{OURS}介绍.docx", "our_response", "our_name"),
    ("x/响应文件.docx", "our_response", "response_words"), ("x/保证金.pdf", "process_material", "process"), ("x/其它.docx", "unknown", "undecided"),
]


def sample(column, values):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.pmod(F.col(column), F.lit(len(values))) + 1).cast("int"))


def sql_sample(column, values):
    inner = ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in values)
    return f"([{inner}])[{column} % {len(values)} + 1]"


@query("path_roles", f"""SELECT o_orderkey, {sql_sample('o_orderkey', [p[1] for p in PATHS])} AS role, {sql_sample('o_orderkey', [p[2] for p in PATHS])} AS reason,
 o_orderkey % {len(PATHS)} = 10 AS conflict FROM orders""")
def path_roles(spark, sf):
    path = F.concat(F.lit("2024-proj/"), sample("o_orderkey", [p[0] for p in PATHS]))
    r = classify.classify_path(path, VENDORS)
    return v.read(spark, sf, "orders").select("o_orderkey", r["role"].alias("role"), r["reason"].alias("reason"), r["conflict"].alias("conflict"))


@query("listing_skip_counts", f"""
WITH l AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'loose.pdf' WHEN o_orderkey % 7 = 1 THEN '非标书/a.pdf' ELSE 'proj/' || {sql_sample('o_orderkey', [p[0] for p in PATHS])} END AS p, {sql_sample('o_orderkey', [p[1] for p in PATHS])} AS r FROM orders)
SELECT CASE WHEN NOT contains(p, '/') THEN 'loose' WHEN contains(p, '非标书') THEN 'excluded' WHEN r = 'system_or_temp' THEN 'system' ELSE 'scanned' END AS reason, count(*) AS files FROM l GROUP BY 1""")
def listing_skips(spark, sf):
    k = F.col("o_orderkey")
    p = F.when(k % 7 == 0, "loose.pdf").when(k % 7 == 1, "非标书/a.pdf").otherwise(F.concat(F.lit("proj/"), sample("o_orderkey", [x[0] for x in PATHS])))
    return catalog.skip_counts(catalog.classify_listing(v.read(spark, sf, "orders").select(p.alias("relative_path")), VENDORS))


@query("ownership_confirmed", f"""SELECT doc_id, (contains(lower(text), 'thion') AND doc_id % 2 = 0) AS confirmed FROM documents""")
def ownership(spark, sf):
    text = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n投标人：").otherwise(""))
    return v.read(spark, sf, "documents").select("doc_id", classify.confirmed_by_content(text, ("Thion",)).alias("confirmed"))


@query("parse_eligibility", with_views("""SELECT o_orderkey, parse_status <> 'paused' OR o_orderkey % 2 = 0 AS eligible FROM contract_documents"""))
def parse_eligibility(spark, sf):
    d = v.contract_documents(spark, sf).withColumn("manual_override", F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0))
    return d.select("o_orderkey", classify.parse_eligible().alias("eligible"))


@query("file_purposes", with_views("""SELECT document_id, regexp_replace(project_folder, '^\\d{8}-?', '') AS project_summary,
 CASE document_role WHEN 'final_signed' THEN '我方最终版' WHEN 'our_response' THEN '我方响应' WHEN 'contract_evidence' THEN '合同证据' ELSE '招标要求' END
  || '（' || regexp_replace(regexp_replace(relative_path, '^.*/', ''), '\\.pdf$', '') || '）' AS purpose FROM contract_documents"""))
def file_purposes(spark, sf):
    d = v.contract_documents(spark, sf)
    named = F.regexp_replace("relative_path", r"\.pdf$", f"-{OURS}.pdf")
    return d.select("document_id", classify.project_summary("project_folder").alias("project_summary"),
                    classify.file_purpose(named, "document_role", (OURS,)).alias("purpose"))


CLAUSES = [("具备CNAS认证证书", "资格资质"), ("近三年审计报告", "财务社保"), ("类似项目合同", "业绩案例"), ("项目经理一名", "人员团队"), ("质谱工作站", "仪器设备"),
           ("交货地点", "履约交付"), ("履约保证金：不缴纳", "商务条款"), ("售后培训", "服务要求"), ("其余说明", "其它")]
KINDS = [("a社保.pdf", "", "social_security_month"), ("b.pdf", "审计报告 社保", "social_security_month"), ("审计报告.pdf", "社保", "finance_period"),
         ("仪器照片.jpg", "", "instrument_photo"), ("仪器发票.pdf", "", "invoice"), ("c.pdf", "采购合同", "purchase_contract"), ("d.pdf", "设备", "instrument"), ("e.pdf", "无", None)]
LINE_KINDS = [("社会保险凭证", "social_security_month"), ("（1）代谢类产品仪器照片", "instrument_photo"), ("仪器清单", "instrument"), ("财务报告", "finance_period"),
              ("荣誉证书", "qualification"), ("其它", None)]


@query("rule_classes", f"""SELECT event_id, {sql_sample('event_id', [c[1] for c in CLAUSES])} AS clause, {sql_sample('event_id', [k[2] for k in KINDS])} AS material,
 {sql_sample('event_id', [k[1] for k in LINE_KINDS])} AS line_kind FROM events""")
def rule_classes(spark, sf):
    return v.read(spark, sf, "events").select(
        "event_id", classify.clause_category(sample("event_id", [c[0] for c in CLAUSES])).alias("clause"),
        classify.material_kind(sample("event_id", [k[0] for k in KINDS]), sample("event_id", [k[1] for k in KINDS])).alias("material"),
        classify.classified_line_kind(sample("event_id", [k[0] for k in LINE_KINDS])).alias("line_kind"))


@query("score_sections", """
WITH l AS (SELECT doc_id, substr(text, 1, 20) AS heading, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, contains(heading, 'thion') OR (len(l) > 0 AND len(list_filter(l, lambda x: contains(x, 'thion') OR contains(x, 'eux'))) * 2 >= len(l)) OR contains(heading, 'eux') AS is_score FROM l""")
def score_sections(spark, sf):
    return v.read_spread(spark, sf, "documents").select("doc_id", classify.is_score_section(tx.left("text", 20), "text", ("thion", "eux")).alias("is_score"))


HEADINGS = [("目 录", "toc_entry"), ("（五）培训方案 | 182-194页", "toc_entry"), ("图 2.1 流程", "table_caption"), ("正本", "cover"), ("开标一览表", "unknown"),
            ("2024年3月5日", "unknown"), ("备注：", "unknown"), ("法定代表人签字", "unknown"), ("10.4 产品经理 刘进", "unknown"), ("张三 | 职务 | 电话", "unknown"),
            ("项目负责人简历", "content_section"), ("合同额 43.8万元", "unknown"), ("附件1 清单", "appendix"), ("6.1 服务方案", "content_section")]


@query("structural_roles", f"SELECT o_orderkey, {sql_sample('o_orderkey', [h[1] for h in HEADINGS])} AS role FROM orders")
def structural_roles(spark, sf):
    body = F.array(F.lit("第一行正文"), F.lit("第二行正文"))
    none = F.array().cast("array<string>")
    return v.read(spark, sf, "orders").select("o_orderkey", sections.structural_role(sample("o_orderkey", [h[0] for h in HEADINGS]), body, none).alias("role"))


@query("heading_tests", """
WITH l AS (SELECT doc_id, substr(string_split(text, chr(10))[1], 1, 45) AS h FROM documents)
SELECT doc_id, trim(h) <> '' AND NOT contains(h, '|') AND NOT contains(h, chr(9)) AND length(trim(h)) <= 40 AND NOT regexp_matches(trim(h), '[。；！？!?；]\\s*$') AS plausible,
 length(trim(h)) >= 2 AND NOT regexp_matches(trim(h), '^[\\d.,%()（）\\-–—～~\\s]+$') AND NOT regexp_matches(trim(h), '(?i)^(10\\.\\d{4,}/|doi[:：]|https?://)') AS recall_ok FROM l""")
def heading_tests(spark, sf):
    h = tx.left(F.get(F.split("text", "\n"), F.lit(0)), 45)
    return v.read(spark, sf, "documents").select("doc_id", classify.plausible_heading(h).alias("plausible"), classify.recall_heading_ok(h).alias("recall_ok"))


@query("signature_audit", f"""
WITH p AS (SELECT o_orderkey, 'r' || (o_orderkey % 3) AS root, 'proj' || o_orderkey || '/' || {sql_sample('o_orderkey', [p[0] for p in PATHS])} AS path, {sql_sample('o_orderkey', [p[0] for p in PATHS])} AS inner_path,
   {sql_sample('o_orderkey', [p[1] for p in PATHS])} AS auto_role, CASE WHEN o_orderkey % 5 = 0 THEN 'final_signed' ELSE 'unknown' END AS document_role,
   CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS manual_override, o_orderkey % 31 <> 0 AS inv, o_orderkey % 37 <> 0 AS reg FROM orders),
q AS (SELECT *, regexp_replace(inner_path, '^.*/', '') AS name FROM p WHERE inv OR reg),
c AS (SELECT *, (contains(name,'最终') OR contains(name,'定稿') OR contains(name,'终稿') OR contains(name,'签章') OR contains(name,'盖章') OR contains(name,'正本'))
   OR (reg AND document_role = 'final_signed') OR auto_role = 'final_signed' AS candidate FROM q)
SELECT CASE WHEN NOT inv THEN 'only_catalog' WHEN NOT reg THEN 'only_inventory' ELSE 'both' END AS side, auto_role,
 CASE WHEN candidate THEN CASE WHEN reg AND manual_override = 1 THEN 'manual_override_requires_separate_review' WHEN auto_role = 'final_signed' THEN 'rule_eligible_pending_review'
  WHEN auto_role = 'unknown' THEN 'pending_review' WHEN auto_role = 'our_response' THEN 'response_final_status_unconfirmed' ELSE 'excluded_' || auto_role END ELSE 'not_a_candidate' END AS audit_status,
 regexp_replace(path, '(?i)_\\d+\\.(?:jpg|jpeg|png)$', '.pdf') <> path AND EXISTS (SELECT 1 FROM c d WHERE d.root = c.root AND d.path = regexp_replace(c.path, '(?i)_\\d+\\.(?:jpg|jpeg|png)$', '.pdf')) AS has_sibling_pdf,
 count(*) AS files FROM c GROUP BY ALL""")
def signature_audit(spark, sf):
    k = F.col("o_orderkey")
    files = v.read(spark, sf, "orders").select(
        k, F.concat(F.lit("r"), (k % 3).cast("string")).alias("source_root_id"),
        F.concat(F.lit("proj"), k.cast("string"), F.lit("/"), sample("o_orderkey", [p[0] for p in PATHS])).alias("relative_path"),
        F.when(k % 5 == 0, "final_signed").otherwise("unknown").alias("document_role"), F.when(k % 13 == 0, 1).otherwise(0).alias("manual_override"))
    audit = classify.signature_audit(files.filter("o_orderkey % 31 <> 0"), files.filter("o_orderkey % 37 <> 0"), VENDORS)
    audit = classify.with_sibling_flag(audit)
    return audit.groupBy("side", "auto_role", F.coalesce("audit_status", F.lit("not_a_candidate")).alias("audit_status"), "has_sibling_pdf").agg(F.count("*").alias("files"))


@query("page_texts_extracted", """
WITH p AS (SELECT DISTINCT html FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 7 = 0)),
a AS (SELECT html, regexp_replace(html, '<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'gis') AS t FROM p),
b AS (SELECT html, regexp_replace(regexp_replace(t, '<(?:br|/p|/h[1-6]|/li|/tr|/div)\\b[^>]*>', chr(10), 'gi'), '<[^>]*>', ' ', 'gs') AS t FROM a),
c AS (SELECT html, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b),
d AS (SELECT html, trim(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS t FROM c)
SELECT sha256(html) AS sha256, CAST(length(t) AS INT) AS chars, 'html_text' AS parser_name, contains(t, '<') AS has_markup FROM d""")
def page_texts(spark, sf):
    pages = v.read_spread(spark, sf, "pages").select(F.col("page_id").alias("document_id"), F.col("html").alias("content"), F.sha2("html", 256).alias("sha256"))
    known = pages.filter("document_id % 7 = 0").select("sha256", F.lit(art.PARSER).alias("parser_name"), F.lit(art.VERSION).alias("parser_version"))
    new = art.extract_html(pages, known)
    return new.select("sha256", F.length("text").alias("chars"), "parser_name", F.contains("text", F.lit("<")).alias("has_markup"))


@query("extraction_cache_misses", """
SELECT sha256(html) AS sha256, count(*) AS pages FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 7 = 0) GROUP BY 1""")
def cache_misses(spark, sf):
    pages = v.read(spark, sf, "pages").select(F.col("page_id").alias("document_id"), F.col("html").alias("content"), F.sha2("html", 256).alias("sha256"))
    known = pages.filter("document_id % 7 = 0").select("sha256", F.lit("x").alias("parser_name"), F.lit("1").alias("parser_version"))
    miss = art.cache_misses(pages, known, "x", "1").select("sha256")
    return pages.join(miss, "sha256").groupBy("sha256").agg(F.count("*").alias("pages"))


CLEAN_SQL = """p AS (SELECT page_id, html FROM pages),
a AS (SELECT page_id, html, regexp_replace(html, '<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'gis') AS t FROM p),
b AS (SELECT page_id, html, regexp_replace(regexp_replace(t, '<(?:br|/p|/h[1-6]|/li|/tr|/div)\\b[^>]*>', chr(10), 'gi'), '<[^>]*>', ' ', 'gs') AS t FROM a),
c AS (SELECT page_id, html, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS t FROM c)"""


@query("resumed_extraction", f"""WITH {CLEAN_SQL}, s AS (SELECT *, substr(sha256(html), 1, 1) AS x FROM d)
SELECT CAST(page_id AS VARCHAR) AS document_id, CASE WHEN x = 'f' THEN 3 WHEN x IN ('0', '1', '2') THEN 2 WHEN x IN ('3', '4') THEN 2 ELSE 1 END AS attempts,
 CASE WHEN x = 'f' THEN 3 WHEN x IN ('0', '1', '2') THEN 1 ELSE 0 END AS failures, CASE WHEN x = 'f' THEN 'failed' ELSE 'done' END AS status,
 CASE WHEN x <> 'f' THEN sha256(html) END AS sha256, CASE WHEN x = 'f' THEN 'broken page' END AS error, CASE WHEN x <> 'f' THEN md5(t) END AS text_hash FROM s""")
def resumed_extraction(spark, sf):
    """Every page through an extractor that fails: some pages at the first attempt, some at every one, and a batch that dies before it ends.

    Five batches over the log leave the texts of one clean run; what always fails is given up after three attempts.
    """
    digit = F.substring("sha256", 1, 1)
    docs = v.read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("document_id"), "html", F.sha2("html", 256).alias("sha256"))

    def extract(batch):
        error = F.when(digit == "f", "broken page").when((F.col("attempt") == 1) & digit.isin("0", "1", "2"), "timeout")
        return batch.select("document_id", "attempt", "sha256", F.when(error.isNull(), art.html_text("html")).alias("text"), error.alias("error"))

    # The first batch dies: it had begun with some pages and ended none of them.
    log = cut_lineage(batches.started(batches.due(docs.filter(digit.isin("3", "4")), spark.createDataFrame([], batches.LOG), 0), 10))
    texts = None
    for now in (5, 20, 40, 60):
        log, got = batches.run(docs, log, extract, now, 10, cut_lineage)
        texts = got if texts is None else texts.unionByName(got)
    done = texts.filter("error IS NULL").select("document_id", F.md5("text").alias("text_hash"))
    return batches.standing(log).join(done, "document_id", "left").select("document_id", "attempts", F.col("failures").cast("int").alias("failures"), "status", "sha256", "error", "text_hash")


@query("catalog_tables_compared", with_views("""
SELECT 'equal' AS case_name, 'none' AS side, NULL AS contract_number, 0 AS copies
UNION ALL SELECT 'changed', x.side, contract_number, 1 FROM order_paths, (VALUES ('left'), ('right')) x(side) WHERE c_nationkey = 3
UNION ALL SELECT 'changed', 'left', contract_number, 1 FROM order_paths WHERE c_nationkey = 5"""))
def catalog_tables_compared(spark, sf):
    """The catalog of contract files against the same catalog made another way, unchanged and changed: one nation's amounts differ, one nation is missing."""
    o, c = v.read(spark, sf, "orders"), v.read(spark, sf, "customer")
    left = v.order_paths(spark, sf).select("document_id", "contract_number", "total_amount", "c_nationkey")
    paths = v.order_paths(spark, sf).select("document_id", "o_orderkey")
    right = (o.join(c, o.o_custkey == c.c_custkey).join(paths, "o_orderkey")
             .select("document_id", v.contract_number(F.col("o_orderkey"), F.col("o_orderdate")).alias("contract_number"), "c_nationkey", F.col("o_totalprice").cast(v.MONEY).alias("total_amount")))
    changed = right.filter("c_nationkey <> 5").withColumn("total_amount", F.when(F.col("c_nationkey") == 3, F.col("total_amount") + 1).otherwise(F.col("total_amount")).cast(v.MONEY))
    same = spark.createDataFrame([("equal", "none" if compare.same_tables(left, right, ["document_id"]) else "some", None, 0)], "case_name string, side string, contract_number string, copies int")
    found = compare.differences(left, changed, ["document_id"])
    return same.unionByName(found.select(F.lit("changed").alias("case_name"), "side", "contract_number", F.col("copies").cast("int").alias("copies")))


@query("files_listed_and_streamed", """SELECT 'proj=' || (page_id % 5) AS project_folder, CAST(page_id AS VARCHAR) AS page, strlen(html) + 1 AS file_size, CAST(page_id % 2 AS INT) AS batch_id, 1 AS times
FROM pages""")
def files_listed_and_streamed(spark, sf):
    """One file per page, listed from its folder; listings arrive in two lots (even pages, then all) and a third run finds nothing new."""
    base = f"{checkpoint_dir(spark)}/listing-{uuid4().hex}"
    sinks.write_files(v.read(spark, sf, "pages").select((F.col("page_id") % 5).alias("proj"), F.col("page_id").alias("page"), "html"), f"{base}/files", ["proj", "page"], "html")
    page = F.regexp_extract("relative_path", "page=([0-9]+)", 1)
    found = cut_lineage(catalog.list_files(spark, {"R": f"{base}/files"}))
    for lot in (found.filter(page.cast("long") % 2 == 0), found, None):
        if lot is not None:
            lot.write.mode("append").json(f"{base}/listings")
        catalog_stream.refresh_stream(spark, f"{base}/listings", f"{base}/store", f"{base}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{base}/store")
    return stored.groupBy("project_folder", page.alias("page"), "file_size", F.col("batch_id").cast("int").alias("batch_id")).agg(F.count("*").cast("int").alias("times"))
