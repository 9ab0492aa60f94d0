"""The same input tables as common table expressions for the oracle side."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["order_paths"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority, c_name, c_nationkey, c_mktsegment,
       CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
       'TCN' || strftime(o_orderdate, '%Y%m') || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS contract_number,
       strftime(o_orderdate, '%Y') AS source_root_id,
       strftime(o_orderdate, '%Y%m%d') || '-' || c_mktsegment AS project_folder,
       strftime(o_orderdate, '%Y%m%d') || '-' || c_mktsegment || '/' || 'TCN' || strftime(o_orderdate, '%Y%m')
         || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '-' || c_name || '-'
         || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '.pdf' AS relative_path,
       sha256('["' || strftime(o_orderdate, '%Y') || '", "' || strftime(o_orderdate, '%Y%m%d') || '-' || c_mktsegment
         || '/' || 'TCN' || strftime(o_orderdate, '%Y%m') || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '-' || c_name
         || '-' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '.pdf"]') AS document_id
FROM orders JOIN customer ON o_custkey = c_custkey"""

VIEWS["contract_documents"] = """
SELECT o_orderkey, document_id, source_root_id, project_folder, relative_path, c_nationkey,
       CASE WHEN o_orderkey % 11 = 0 THEN 'tender_requirement' WHEN o_orderstatus = 'F' THEN 'final_signed'
            WHEN o_orderstatus = 'O' THEN 'contract_evidence' ELSE 'our_response' END AS document_role,
       CASE WHEN o_orderkey % 13 = 0 THEN 'paused' ELSE 'done' END AS parse_status,
       CASE WHEN o_orderkey % 17 = 0 THEN 'framework_sample' ELSE '' END AS doc_subtype,
       CASE WHEN o_orderkey % 19 <> 0 THEN sha256('body-' || o_orderkey) END AS canonical_document_id,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'native_text' WHEN o_orderpriority LIKE '2%' THEN 'native_pdf_text'
            WHEN o_orderpriority LIKE '3%' THEN 'mixed' WHEN o_orderpriority LIKE '4%' THEN 'scanned_ocr'
            ELSE 'native_xlsx_text' END AS content_format
FROM order_paths"""

VIEWS["contract_artifacts"] = """
SELECT sha256('body-' || o_orderkey) AS canonical_document_id,
       sha256(CASE WHEN o_orderkey % 23 = 0 THEN 'drift-' ELSE 'body-' END || o_orderkey) AS sha256,
       'v2' AS parser_version
FROM orders WHERE o_orderkey % 19 <> 0"""

VIEWS["contracts"] = """
SELECT 'CTL-' || o_orderkey AS contract_id, document_id, 1 AS ordinal, contract_number, c_name AS party_a,
       (SELECT s_name FROM supplier WHERE s_suppkey = m.l_suppkey) AS party_b,
       CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') END AS contract_date,
       total_amount,
       CASE WHEN o_orderkey % 29 <> 0 THEN sha256('body-' || o_orderkey) END AS source_sha256,
       CASE WHEN o_orderkey % 31 = 0 THEN 'v1' ELSE 'v2' END AS parser_version
FROM order_paths LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_linenumber = 1
                            GROUP BY 1) m ON l_orderkey = o_orderkey"""

VIEWS["contract_items"] = """
SELECT 'CTL-' || l_orderkey AS contract_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
       p_type, p_name, p_type || '/' || p_name AS product_raw, l_quantity AS quantity, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS declared_amount,
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS line_amount,
       CASE WHEN l_linenumber = 7 THEN 'product_subtotal' ELSE 'detail' END AS row_type,
       CASE WHEN l_linenumber = 7 THEN 'explicit_product_subtotal' WHEN l_linestatus = 'O' THEN 'derived_qty_x_price'
            ELSE 'declared' END AS product_amount_source,
       l_linenumber || ' | ' || p_name || ' | ' || CAST(l_quantity AS INT) || ' | '
         || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS evidence_text
FROM lineitem JOIN part ON l_partkey = p_partkey"""

VIEWS["approved_documents"] = "SELECT substr(document_id, 1, 12) AS id_prefix FROM order_paths WHERE c_nationkey < 20"

VIEWS["facts"] = """
SELECT event_id, user_id AS document_id, event_type AS fact_type,
       CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m') WHEN 1 THEN strftime(ts, '%Y-%m') || '~'
            WHEN 2 THEN strftime(ts, '%Y-%m') || '~' || strftime(CAST(ts AS DATE) + INTERVAL 2 MONTH, '%Y-%m') END AS fact_value,
       CASE event_id % 5 WHEN 0 THEN '[our_response] file-' || user_id || '.txt' WHEN 1 THEN ''
            ELSE '[tender_requirement] value ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS evidence_text
FROM events"""

VIEWS["fact_documents"] = """
SELECT DISTINCT user_id AS document_id, 'p' || (user_id % 7) || '/file-' || user_id || '.txt' AS relative_path,
       'p' || (user_id % 7) AS project_folder,
       CASE user_id % 3 WHEN 0 THEN 'our_response' WHEN 1 THEN 'tender_requirement' ELSE 'process_material' END AS document_role
FROM events"""

VIEWS["text_documents"] = """
SELECT doc_id AS document_id, source || '/' || lang || '-' || doc_id || '.txt' AS relative_path, source AS project_folder,
       lang, text,
       CASE doc_id % 5 WHEN 0 THEN 'scanned_ocr' WHEN 1 THEN 'mixed' ELSE 'native_text' END AS content_format,
       CASE doc_id % 4 WHEN 3 THEN 'tender_requirement' WHEN 2 THEN 'final_signed' ELSE 'our_response' END AS document_role
FROM documents"""


VIEWS["claims"] = """
SELECT 'LEDGER-' || document_id || '-' || (o_custkey % 9 + 1) AS contract_id, document_id,
       CAST(o_custkey % 9 + 1 AS INT) AS ordinal, 'Buyer ' || (o_custkey % 40) AS party_a,
       CASE WHEN o_custkey % 6 <> 0 THEN CAST((o_custkey % 40) * 5000 AS DECIMAL(18,2)) END AS total_amount,
       CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE
         '[业绩清单] 类似业绩一览表 | 行' || (o_custkey % 9 + 1) || ': ' || (o_custkey % 40) || ' | 项目:' || c_mktsegment || ' '
         || source_root_id || ' 采购人:Buyer ' || (o_custkey % 40)
         || CASE WHEN o_custkey % 6 = 0 THEN ' 金额说明:本行未取到' ELSE ' 金额:' || CAST((o_custkey % 40) * 5000 AS VARCHAR) || '.00元' END
         || ' | 位置:line3' END AS evidence_text
FROM order_paths"""

VIEWS["vouchers"] = """
SELECT o_orderkey AS record_no, lower(translate(contract_number, '01', 'Ol')) AS contract_number,
       CASE WHEN o_orderkey % 9 = 0 THEN '未到款' ELSE '' END AS payee,
       CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS pay_time
FROM order_paths WHERE o_orderkey % 3 = 0"""

VIEWS["receipts"] = """
SELECT contract_number, '银行回单/' || contract_number || '-1.jpg' AS inner_path FROM order_paths WHERE o_orderkey % 4 = 1"""

VIEWS["text_contracts"] = """
SELECT 'CTL-T' || doc_id AS contract_id, doc_id AS document_id, source AS party_a, lang AS party_b,
       CASE WHEN doc_id % 3 <> 2 THEN '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') END AS contract_date,
       CAST(doc_id * 10 AS DECIMAL(18,2)) AS total_amount FROM documents"""

VIEWS["text_contract_items"] = """
SELECT 'CTL-T' || doc_id AS contract_id, CASE WHEN doc_id % 12 = 0 THEN 'thion/basic' ELSE 'other/basic' END AS product_raw,
       'detail' AS row_type FROM documents WHERE doc_id % 6 = 0"""


def with_views(body: str, **extra: str) -> str:
    """Prefix ``body`` with the views it names; a body starting with ', x AS (' adds its own after them."""
    known = {**VIEWS, **extra}
    used: set[str] = set()

    def need(sql: str) -> None:
        for name in known:
            if name not in used and re.search(rf"\b{name}\b", sql):
                used.add(name)
                need(known[name])

    need(body)
    ctes = ",\n".join(f"{n} AS ({known[n]})" for n in known if n in used)
    body = body.strip()
    if body.startswith(","):
        return "WITH " + (ctes + "\n" + body if ctes else body[1:])
    return f"WITH {ctes}\n{body}" if ctes else body
