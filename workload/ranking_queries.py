"""Section ranking, vectors, evidence packs, module knowledge, tender comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlens.functions import text as tx
from docketlens.operators import times
from docketlens.plans import kb, packs, ranking, tender
from docketlens.sources import sinks
from workload import views as v
from workload.registry import query
from workload.sqlviews import with_views

STOP = "('a','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','s','such','t','that','the','their','then','there','these','they','this','to','was','will','with','www')"
# Fixture modules: names and keywords over the invented vocabulary.
MODULES = {"ering": ("onent", "thand"), "eaux": ("ouan", "quelle"), "zwischen": ("sch", "lich")}


def sections_view(spark, sf):
    d = v.text_documents(spark, sf)
    return d.select(
        F.concat(F.lit("S"), F.col("document_id").cast("string")).alias("section_id"), "document_id",
        F.col("project_folder").alias("project_key"), tx.left(F.regexp_replace("text", "\n", " "), 40).alias("heading"),
        F.col("text").alias("section_text"),
        F.when(F.col("document_id") % 10 == 0, "toc_entry").otherwise("content_section").alias("structural_role"))


def documents_view(spark, sf):
    return v.text_documents(spark, sf).drop("text")


def queries_view(spark, sf):
    words = F.slice(F.split(F.regexp_replace("text", r"[^\p{L} ]", " "), " +"), 1, 4)
    return v.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query_text"))


BM25 = f"""
, s AS (SELECT doc_id, 'S' || doc_id AS section_id, substr(regexp_replace(text, '\\n', ' ', 'g'), 1, 40) AS heading, text, doc_id % 10 <> 0 AS content FROM documents),
fl AS (SELECT section_id, content, 'h' AS field, list_filter(regexp_extract_all(lower(heading), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN {STOP}) AS toks FROM s
  UNION ALL SELECT section_id, content, 't', list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN {STOP}) FROM s),
av AS (SELECT field, count(*) AS n, avg(len(toks)) AS a FROM fl WHERE len(toks) > 0 GROUP BY 1),
po AS (SELECT section_id, content, field, len(toks) AS dl, u.term, count(*) AS tf FROM fl, LATERAL (SELECT unnest(toks) AS term) u GROUP BY ALL),
dfr AS (SELECT field, term, count(*) AS df FROM po GROUP BY ALL),
sc AS (SELECT query_id, section_id,
   sum(wt * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a))) FILTER (field = 'h') AS h,
   sum(wt * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a))) FILTER (field = 't') AS t
  FROM po JOIN dfr USING (field, term) JOIN av USING (field) JOIN q USING (term) WHERE content GROUP BY ALL)"""
BENCH_Q = f"""
, bq AS (SELECT item_id AS query_id, list_slice(string_split_regex(regexp_replace(text, '[^\\p{{L}} ]', ' ', 'g'), ' +'), 1, 4) AS w FROM benchmark),
q AS (SELECT query_id, lower(u.term) AS term, count(*) AS wt FROM bq, LATERAL (SELECT unnest(w) AS term) u WHERE u.term <> '' AND lower(u.term) NOT IN {STOP} GROUP BY ALL)"""
MODULE_Q = ", q AS (SELECT query_id, term, count(*) AS wt FROM (VALUES " + ", ".join(
    f"('{m}', '{w}')" for m, ws in MODULES.items() for w in (m, *ws)) + ") x(query_id, term) GROUP BY ALL)"


@query("section_search_top10", with_views(BENCH_Q + BM25 + """
, r AS (SELECT query_id, section_id, round(greatest(3 * coalesce(h, 0), coalesce(t, 0)), 6) AS score FROM sc),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM r)
SELECT query_id, section_id, score, rank FROM k WHERE rank <= 10"""))
def section_search(spark, sf):
    got = ranking.search_sections(sections_view(spark, sf), queries_view(spark, sf), documents_view(spark, sf))
    return got.select("query_id", "section_id", "score", "rank")


POOL = MODULE_Q + BM25 + """
, r AS (SELECT query_id AS module, section_id, round(6 * coalesce(h, 0) + coalesce(t, 0), 6) AS score FROM sc),
k AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, section_id) AS rank FROM r)"""


@query("module_recall_pool", with_views(POOL + " SELECT module, section_id, score, rank FROM k WHERE rank <= 25"))
def module_pool(spark, sf):
    return ranking.recall_pool(sections_view(spark, sf), packs.module_queries(spark, MODULES)).withColumnRenamed("query_id", "module")


def any_term(expr):
    return "CASE module " + " ".join(f"WHEN '{m}' THEN " + " OR ".join(f"contains({expr}, '{w}')" for w in (m, *ws)) for m, ws in MODULES.items()) + " END"


VERDICT = POOL + f"""
, c AS (SELECT k.module, k.section_id, k.rank, s.heading, s.text, d.document_role, d.project_folder FROM k JOIN s USING (section_id) JOIN text_documents d ON d.document_id = s.doc_id WHERE rank <= 25),
w AS (SELECT *, CASE WHEN document_role = 'tender_requirement' THEN 'role_rejected' WHEN {any_term('heading')} THEN 'heading' WHEN {any_term('text')} THEN 'text' ELSE 'no_match' END AS verdict FROM c)"""


def module_candidates(spark, sf):
    return packs.candidates(sections_view(spark, sf), documents_view(spark, sf), MODULES)


@query("pack_candidate_verdicts", with_views(VERDICT + "SELECT module, section_id, verdict FROM w"))
def pack_verdicts(spark, sf):
    return module_candidates(spark, sf).select("module", "section_id", "verdict")


def selection_sql(pool: int, most: int, least: int, per_project: int, tail: str) -> str:
    """The choice as two recursive steps: leaders in pool order, then representatives against those already taken."""
    short = min(most, least)
    body = VERDICT.replace("rank <= 25", f"rank <= {pool}") + f"""
, pl AS (SELECT w.module, section_id, rank, verdict, coalesce(nullif(w.project_folder, ''), '?') AS project, CASE d.content_format WHEN 'native_text' THEN 0 WHEN 'mixed' THEN 1 WHEN 'scanned_ocr' THEN 2 ELSE 3 END AS fr,
  w.text, length(w.text) AS tl, regexp_replace(lower(w.text), '[^0-9a-z一-鿿]+', '', 'g') AS nt FROM w JOIN text_documents d ON 'S' || d.document_id = section_id WHERE verdict IN ('heading', 'text')),
gr AS (SELECT module, section_id, CASE WHEN length(nt) = 0 THEN [] WHEN length(nt) < 4 THEN [nt] ELSE list_distinct(list_transform(range(1, length(nt) - 2), lambda i: substr(nt, i, 4))) END AS g FROM pl),
ug AS (SELECT module, section_id, len(g) AS n, unnest(g) AS x FROM gr),
nr AS (SELECT a.module, a.section_id AS x, b.section_id AS y FROM ug a JOIN ug b ON a.module = b.module AND a.x = b.x AND a.section_id <> b.section_id
  GROUP BY a.module, a.section_id, b.section_id, a.n, b.n HAVING count(*) >= 0.75 * (a.n + b.n - count(*))),
nb AS (SELECT module, x, list(y) AS ys FROM nr GROUP BY ALL),
o AS (SELECT pl.*, row_number() OVER (PARTITION BY pl.module, verdict ORDER BY rank) AS i, coalesce(ys, []::VARCHAR[]) AS ys FROM pl LEFT JOIN nb ON nb.module = pl.module AND x = section_id),
ld AS (SELECT DISTINCT module, verdict, 0::BIGINT AS i, []::VARCHAR[] AS leaders, NULL::VARCHAR AS section_id, NULL::VARCHAR AS leader FROM o
  UNION ALL SELECT module, verdict, n, CASE WHEN len(h) = 0 THEN list_append(leaders, sid) ELSE leaders END, sid, CASE WHEN len(h) = 0 THEN sid ELSE h[1] END
  FROM (SELECT ld.module, ld.verdict, o.i AS n, leaders, o.section_id AS sid, list_filter(leaders, lambda l: list_contains(o.ys, l)) AS h FROM ld JOIN o ON o.module = ld.module AND o.verdict = ld.verdict AND o.i = ld.i + 1)),
rp AS (SELECT o.module, o.verdict, leader, arg_max(o.section_id, (-fr, tl, o.section_id)) AS section_id, count(*) - 1 AS folded FROM o JOIN ld ON ld.module = o.module AND ld.section_id = o.section_id GROUP BY o.module, o.verdict, leader),
rr AS (SELECT rp.*, o.project, o.ys, row_number() OVER (PARTITION BY rp.module ORDER BY rp.verdict = 'text', fr, -tl, rp.section_id) AS i FROM rp JOIN o ON o.module = rp.module AND o.section_id = rp.section_id),
se AS (SELECT DISTINCT module, 0::BIGINT AS i, []::VARCHAR[] AS ids, []::VARCHAR[] AS projects, 0::BIGINT AS heads, 0::BIGINT AS dropped FROM rr
  UNION ALL SELECT module, n, CASE WHEN op AND fits THEN list_append(ids, sid) ELSE ids END, CASE WHEN op AND fits THEN list_append(projects, project) ELSE projects END,
   heads + CASE WHEN op AND fits AND verdict = 'heading' THEN 1 ELSE 0 END, dropped + CASE WHEN op AND NOT fits THEN 1 ELSE 0 END
  FROM (SELECT se.module, rr.i AS n, ids, projects, heads, dropped, rr.section_id AS sid, rr.project, rr.verdict, len(ids) < CASE WHEN rr.verdict = 'text' THEN {short} ELSE {most} END AS op,
    len(list_filter(projects, lambda p: p = rr.project)) < {per_project} AND NOT list_has_any(ids, rr.ys) AS fits FROM se JOIN rr ON rr.module = se.module AND rr.i = se.i + 1)),
fi AS (SELECT * FROM se QUALIFY row_number() OVER (PARTITION BY module ORDER BY i DESC) = 1),
fo AS (SELECT module, sum(folded) FILTER (verdict = 'heading') AS fh, sum(folded) FILTER (verdict = 'text') AS ft FROM rp GROUP BY 1),
ev AS (SELECT fi.module, sid AS section_id, pick, dropped + coalesce(fh, 0) + CASE WHEN heads < {least} THEN coalesce(ft, 0) ELSE 0 END AS dropped
  FROM (SELECT module, heads, dropped, unnest(ids) AS sid, generate_subscripts(ids, 1) AS pick FROM se JOIN (SELECT module, max(i) AS i FROM se GROUP BY 1) USING (module, i)) fi JOIN fo USING (module)),
e AS (SELECT ev.*, o.verdict, o.project, o.text, o.tl, w.heading, w.project_folder, mp FROM ev JOIN o USING (module, section_id) JOIN w USING (module, section_id)
  JOIN (VALUES {", ".join(f"('{m}', {i})" for i, m in enumerate(MODULES))}) AS m(module, mp) USING (module)),
nu AS (SELECT *, 'E' || row_number() OVER (ORDER BY mp, pick) AS ref, CASE WHEN sum(tl) OVER () > 6000 THEN greatest(300, 6000 // count(*) OVER ()) ELSE 1200 END AS per FROM e),
st AS (SELECT module, mp AS module_pos, coalesce(pool_size, 0) AS pool_size, coalesce(role_rejected, 0) AS role_rejected, coalesce(usable, 0) AS usable, coalesce(deduped, 0) AS deduped,
   coalesce(heading_hits, 0) AS heading_hits, coalesce(dropped, 0) AS dropped_duplicates,
   CASE WHEN coalesce(usable, 0) = 0 THEN 'insufficient' WHEN coalesce(heading_hits, 0) >= 3 THEN 'ok' ELSE 'sparse' END AS status
  FROM (VALUES {", ".join(f"('{m}', {i})" for i, m in enumerate(MODULES))}) AS m(module, mp)
  LEFT JOIN (SELECT module, count(*) AS pool_size, count(*) FILTER (verdict = 'role_rejected') AS role_rejected, count(*) FILTER (verdict IN ('heading', 'text')) AS usable FROM w GROUP BY 1) USING (module)
  LEFT JOIN (SELECT module, count(*) AS deduped, count(*) FILTER (verdict = 'heading') AS heading_hits, max(dropped) AS dropped FROM e GROUP BY 1) USING (module))
{tail}"""
    return with_views(body).replace("WITH ", "WITH RECURSIVE ", 1)


@query("evidence_packs", selection_sql(25, 5, 3, 2, """SELECT module, ref, pick, section_id, project_folder, verdict AS match_basis, least(per, tl) AS excerpt_chars, tl AS text_full_len,
 per < 1200 AS truncated, dropped FROM nu"""))
def evidence_packs(spark, sf):
    c = module_candidates(spark, sf)
    e = packs.select_evidence(c)
    n = packs.fit_budget(packs.number_evidence(e, MODULES, F.lit("r1")), 6000)
    return n.select("module", "ref", "pick", "section_id", "project_folder", F.col("verdict").alias("match_basis"),
                    F.length("excerpt").alias("excerpt_chars"), "text_full_len", "truncated", "dropped")


@query("evidence_pack_status", selection_sql(25, 5, 3, 2, "SELECT * FROM st"))
def evidence_status(spark, sf):
    c = module_candidates(spark, sf)
    return packs.pack_status(c, packs.select_evidence(c), MODULES)


@query("extractive_draft", selection_sql(25, 5, 3, 2, """SELECT module, status, length(m) AS chars, md5(m) AS body_hash FROM (SELECT st.module, status, concat_ws(chr(10), '## ' || st.module,
  CASE status WHEN 'insufficient' THEN '> 历史材料未覆盖本小节。' WHEN 'sparse' THEN '> 历史材料不足。' END, b) AS m FROM st LEFT JOIN (
  SELECT module, string_agg('- ' || trim(substr(text, 1, per), chr(32) || chr(10) || chr(9) || chr(13)) || ' [' || ref || ']', chr(10) ORDER BY pick) AS b FROM nu GROUP BY 1) USING (module))"""))
def extractive_draft(spark, sf):
    c = module_candidates(spark, sf)
    e = packs.select_evidence(c)
    n = packs.fit_budget(packs.number_evidence(e, MODULES, F.lit("r1")), 6000)
    return packs.assemble(n, packs.pack_status(c, e, MODULES)).select("module", "status", F.length("markdown").alias("chars"), F.md5("markdown").alias("body_hash"))


@query("module_headings_and_points", selection_sql(60, 30, 0, 3, """SELECT module, 'heading' AS kind, heading AS item FROM (
  SELECT module, heading, row_number() OVER (PARTITION BY module ORDER BY n DESC, heading) AS r FROM (SELECT module, trim(heading) AS heading, count(*) AS n FROM e GROUP BY 1, 2) WHERE heading <> '') WHERE r <= 20
 UNION ALL SELECT module, 'point', section_id FROM (SELECT module, section_id, row_number() OVER (PARTITION BY module, project_folder ORDER BY pick) AS r FROM e WHERE trim(text) <> '') WHERE r <= 3
 UNION ALL SELECT module, 'coverage', CAST(count(DISTINCT section_id) AS VARCHAR) FROM e GROUP BY 1"""))
def module_headings(spark, sf):
    e = packs.select_evidence(packs.candidates(sections_view(spark, sf), documents_view(spark, sf), MODULES, 60), 30, 0, 3)
    heads = kb.heading_frequency(e).select("module", F.lit("heading").alias("kind"), F.col("heading").alias("item"))
    points = kb.key_points(e).select("module", F.lit("point").alias("kind"), F.col("section_id").alias("item"))
    return heads.unionByName(points).unionByName(kb.coverage(e).select("module", F.lit("coverage").alias("kind"), F.col("files").cast("string").alias("item")))


@query("vector_neighbours", """
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 6) AS score FROM embeddings, q),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM k WHERE rank <= 10""")
def vector_neighbours(spark, sf):
    e = v.read(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")
    return ranking.nearest_vectors(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector"), 10)


@query("embedding_backlog", """SELECT 'S' || doc_id AS section_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def embedding_backlog(spark, sf):
    done = v.read(spark, sf, "embeddings").select(F.concat(F.lit("S"), F.col("vec_id").cast("string")).alias("section_id"))
    return ranking.embedding_backlog(sections_view(spark, sf), done).select("section_id")


@query("sections_to_index", """
WITH f AS (SELECT doc_id, length(text) AS n FROM documents WHERE doc_id % 3 <> 0 ORDER BY n DESC, doc_id LIMIT 50)
SELECT 'S' || doc_id AS section_id, 'pending' AS embedding_state FROM f""")
def sections_to_index(spark, sf):
    s = sections_view(spark, sf)
    return sinks.new_sections(s, s.filter("document_id % 3 = 0"), 50).select("section_id", "embedding_state")


# --- time commitments, rendered one line per order -------------------------------------------
SLOT_TEXTS = [  # (template with {n}, slot or None, minutes per unit of n, value template)
    ("服务响应{n}小时，", "响应", 60), ("我方{n}天内到场处理。", "到场", 1440), ("样本{n}个工作日内交付报告，", "交付", 480),
    ("7×{n}小时响应热线。", None, 60), ("响应文件须在{n}日内递交。", None, 1440), ("牵头响应，{n}小时内提交方案。", None, 60), ("质保{n}周，", "质保", 10080)]


def commitment_texts(spark, sf):
    from docketlens.operators import classify  # noqa: F401

    o = v.read_spread(spark, sf, "orders")
    k = F.col("o_orderkey")
    n = F.pmod(F.col("o_custkey"), F.lit(48)) + 1
    t = None
    for i, (tpl, _, _) in enumerate(SLOT_TEXTS):
        a, b = tpl.split("{n}")
        one = F.concat(F.lit(a), n.cast("string"), F.lit(b))
        t = F.when(k % len(SLOT_TEXTS) == i, one) if t is None else t.when(k % len(SLOT_TEXTS) == i, one)
    prefix = F.when(k % 4 == 0, "★必须：").otherwise("说明：")
    return o.select(k.alias("document_id"), F.concat(F.lit("M"), (F.col("o_custkey") % 8).cast("string")).alias("module"),
                    F.concat(prefix, t).alias("text"))


def slot_sql():
    slot = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, (_, s, _) in enumerate(SLOT_TEXTS) if s) + " END"
    mins = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN {m}" for i, (_, _, m) in enumerate(SLOT_TEXTS)) + " END"
    return f", ct AS (SELECT o_orderkey AS document_id, 'M' || (o_custkey % 8) AS module, {slot} AS slot, CAST((o_custkey % 48 + 1) * {mins} AS BIGINT) AS minutes, (o_orderkey % 4 = 0 OR {slot} = '响应') AS mandatory FROM orders WHERE {slot} IS NOT NULL)"


@query("time_requirements", with_views(slot_sql() + "SELECT document_id, slot, minutes, mandatory FROM ct"))
def time_requirements(spark, sf):
    return times.time_requirements(commitment_texts(spark, sf), ["document_id"]).select("document_id", "slot", "minutes", "mandatory")


@query("module_commitments", with_views(slot_sql() + """
SELECT module, slot, count(DISTINCT minutes) AS distinct_values, CAST(min(minutes) AS DOUBLE) AS strictest, CAST(max(minutes) AS DOUBLE) AS longest, count(DISTINCT minutes) > 1 AS conflict FROM ct GROUP BY ALL"""))
def module_commitments(spark, sf):
    return kb.commitment_slots(kb.commitment_values(commitment_texts(spark, sf), ["module"], "document_id", "text"), ["module"])


@query("commitment_conflicts", with_views(slot_sql() + """
SELECT module, slot, count(DISTINCT minutes) AS distinct_values, count(DISTINCT document_id) AS sources FROM ct GROUP BY ALL
HAVING count(DISTINCT minutes) > 1 AND count(DISTINCT document_id) >= 2"""))
def commitment_conflicts(spark, sf):
    return kb.conflicts(commitment_texts(spark, sf), ["module"], "document_id", "text")


TENDER = slot_sql() + """
, hist AS (SELECT slot, min(minutes) AS strictest FROM ct WHERE document_id % 2 = 1 GROUP BY 1),
cmp AS (SELECT ct.*, CASE WHEN strictest IS NULL THEN 'uncovered' WHEN minutes >= strictest THEN 'covered' ELSE 'stricter' END AS verdict FROM ct LEFT JOIN hist USING (slot) WHERE document_id % 2 = 0)"""


def compared(spark, sf):
    reqs = times.time_requirements(commitment_texts(spark, sf).filter("document_id % 2 = 0"), ["document_id"])
    past = times.time_requirements(commitment_texts(spark, sf).filter("document_id % 2 = 1"), ["document_id"])
    return tender.compare_with_history(reqs, past)


@query("requirements_vs_history", with_views(TENDER + "SELECT document_id, slot, minutes, verdict FROM cmp"))
def requirements_vs_history(spark, sf):
    return compared(spark, sf).select("document_id", "slot", "minutes", "verdict")


@query("requirement_summary", with_views(TENDER + """SELECT slot, count(*) AS total, count(*) FILTER (mandatory) AS mandatory, count(*) FILTER (verdict = 'covered') AS covered,
 count(*) FILTER (verdict = 'stricter') AS stricter, count(*) FILTER (verdict = 'uncovered') AS uncovered FROM cmp GROUP BY 1"""))
def requirement_summary(spark, sf):
    return tender.summary(compared(spark, sf), ["slot"])


def marked_texts(spark, sf):
    o = v.read_spread(spark, sf, "orders", 8)
    n = F.col("o_custkey").cast("string")
    return o.select(F.col("o_orderkey").alias("document_id"), F.concat(
        F.lit("普通行\n1 | ★ | 交货时间"), n, F.lit(" | 签订后"), n, F.lit("日内\n▲1、投标人资质"), n, F.lit("：证书一份\n★售后服务（清单）\n第一行"), n,
        F.lit("\n第二行\n\n不属于\n1 | ★ | 交货时间"), n, F.lit(" | 签订后"), n, F.lit("日内")).alias("text"))


@query("hard_requirements", with_views("""
SELECT o_orderkey AS document_id, '1' AS seq, '交货时间' || o_custkey AS name, '签订后' || o_custkey || '日内' AS clause_text, '履约交付' AS category FROM orders
UNION ALL SELECT o_orderkey, '', '1、投标人资质' || o_custkey, '证书一份', '资格资质' FROM orders
UNION ALL SELECT o_orderkey, '', '售后服务（清单）', '第一行' || o_custkey || ' 第二行', '服务要求' FROM orders"""))
def hard_requirements(spark, sf):
    return times.hard_requirements(marked_texts(spark, sf), ["document_id"]).select("document_id", "seq", "name", "clause_text", "category")


@query("requirement_check_table", with_views("""
, p AS (SELECT count(DISTINCT document_id) AS docs FROM facts WHERE fact_type = 'view')
SELECT '履约交付' AS category, NULL AS pool, NULL AS pool_documents, count(*) AS requirements FROM orders
UNION ALL SELECT '资格资质', 'qualification', (SELECT docs FROM p), count(*) FROM orders
UNION ALL SELECT '服务要求', 'scheme', NULL, count(*) FROM orders"""))
def check_table(spark, sf):
    f = v.facts(spark, sf).withColumn("fact_type", F.when(F.col("fact_type") == "view", "qualification").otherwise("invoice"))
    pools = tender.material_pools(f, v.contracts(spark, sf))
    rows = tender.check_table(times.hard_requirements(marked_texts(spark, sf), ["document_id"]), pools)
    return rows.groupBy("category", "pool", "pool_documents").agg(F.count("*").alias("requirements"))


@query("material_pools", with_views("""
SELECT 'qualification' AS pool, count(*) AS rows, count(DISTINCT document_id) AS documents FROM facts WHERE fact_type = 'view'
UNION ALL SELECT 'instrument', count(*), count(DISTINCT document_id) FROM facts WHERE fact_type <> 'view'
UNION ALL SELECT 'contracts', count(*), count(*) FROM contracts"""))
def material_pools(spark, sf):
    f = v.facts(spark, sf).withColumn("fact_type", F.when(F.col("fact_type") == "view", "qualification").otherwise("invoice"))
    return tender.material_pools(f, v.contracts(spark, sf))


@query("requirements_by_category", "SELECT unnest(['履约交付','资格资质','服务要求']) AS category, count(*) AS requirements FROM orders")
def requirements_by_category(spark, sf):
    return tender.by_category(times.hard_requirements(marked_texts(spark, sf), ["document_id"]))
