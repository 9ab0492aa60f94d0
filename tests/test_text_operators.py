from pyspark.sql import functions as F

from docketlens import rules
from docketlens.functions import periods, text as tx
from docketlens.operators import classify, facts, header, sections, service_table, times
from docketlens.plans import mention


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "text string")
    return df.select(expr.alias("x")).first()["x"]


def test_strip_and_lines(spark):
    assert one(spark, "　 a b\xa0", tx.strip("text")) == "a b"
    assert one(spark, "a\r\nb c\n", tx.lines("text")) == ["a", "b", "c"]
    assert one(spark, "", tx.lines("text")) == []


def test_matches_positions(spark):
    got = one(spark, "12天xx3天", tx.matches("text", r"\d+天"))
    assert [(m["raw"], m["start"], m["end"]) for m in got] == [("12天", 0, 3), ("3天", 5, 7)]


def test_periods(spark):
    cases = {
        "自2025年2月1日至2025年2月28日": "2025-02-01~2025-02-28", "2023年5月至今": "2023-05~", "2021年至今": "2021~",
        "（2024年度）报告": "2024", "2025年连续三个月": "2025", "（填写具体的年度）2024年": None, "自  年  月  日": None}
    for s, want in cases.items():
        assert one(spark, s, periods.extract_period("text")) == want, s
    scan = periods.scan_periods(F.lit("f"), "text")
    assert one(spark, "2024年3月 2024年11月 2046年6月", scan) == ["2024-03", "2024-11"]
    assert one(spark, "有效期限为：2025年3月14日至2026年3月", scan) == []
    near = periods.scan_periods_near("text", rules.SOCIAL_MARKERS_STRONG, month_only=True)
    assert one(spark, "社会保险费缴费记录 2026-04 | 2026-05-14 | 2025年7月", near) == ["2025-07", "2026-04"]
    line = periods.scan_periods_near("text", rules.SOCIAL_MARKERS, same_line=True)
    assert one(spark, "签署 2026年8月\n社保 2025年2月", line) == ["2025-02"]
    kept = periods.not_after_project(F.array(F.lit("2026-10"), F.lit("2026-12")), "text")
    assert one(spark, "20260814-x", kept) == ["2026-10"] and one(spark, "x", kept) == ["2026-10", "2026-12"]


def test_voucher_total(spark):
    v = facts.voucher_total("text")
    assert tuple(one(spark, "税务局 完税\n金额合计\n（大写）人民币\n¥272,310.44", v)) == ("272,310.44", "¥")
    assert tuple(one(spark, "社会保险 金额合计（大写）叁万\n34,420.92", v)) == ("34,420.92", "大写行")
    assert one(spark, "打车 价税合计 ¥100.00", v) is None


def test_declarations_instruments_purchases(spark):
    df = spark.createDataFrame([(1, "现附上自2025年2月1日至2025年2月28日缴纳的社保凭据\n现附上我方（填写年度）财务报告\n现附上（2023年度）财务报告"),
                                (2, "拥有3台96通道自动化建库设\n备，另有5台Orion质谱仪（LC），2台的，1台96通道，3台序列号设备\n"),
                                (3, "附件：拥有9台的 Zeta-7 质谱采购合同，不签订采购合同。")], "document_id int, text string")
    got = [(r[0], r[1]) for r in facts.declaration_facts(df, ["document_id"]).select("fact_type", "fact_value").collect()]
    assert got == [("social_security_month", "2025-02-01~2025-02-28"), ("finance_period", "2023")]
    names = [r["fact_value"] for r in facts.instrument_names(df, ["document_id"]).collect()]
    assert names == ["96通道自动化建库设备", "Orion质谱仪（LC）"]
    bought = [r["fact_value"] for r in facts.purchase_contracts(df, ["document_id"]).collect()]
    assert bought == ["Zeta-7 质谱采购合同"]


def test_sections(spark):
    body = "这一段正文说明服务安排和人员配置情况，长度足够成为一个章节的正文内容，不会被丢弃。再补充一些字数。"
    text = "\n".join(["1.1 服务方案", body, "2.1 目录", "x....... 12", "y....... 13", body, "买方名称 | 合同价格", "甲 | 10",
                      "3.1 附件一览", body] + ["页眉行"] * 5)
    df = spark.createDataFrame([("doc", text)], "document_id string, text string")
    rows = {r["heading"]: r for r in sections.cut_sections(df, ["document_id"], min_chars=5).collect()}
    assert rows["1.1 服务方案"]["structural_role"] == "content_section" and rows["1.1 服务方案"]["section_id"] == "doc-S0001"
    assert rows["2.1 目录"]["structural_role"] == "toc_entry"
    assert rows["买方名称 | 合同价格"]["structural_role"] == "unknown"
    assert rows["3.1 附件一览"]["structural_role"] == "appendix"
    rep = df.select(sections.repeated_lines(tx.lines("text")).alias("x")).first()["x"]
    assert rep == ["页眉行"]


def test_an_address_at_the_start_of_a_line_tells_no_level(spark):
    cases = {"28.68.191.238 Den schüsch": 2, "12.34.56.78 Oring": 2, "36.128.82.53 Ount": 2, "1.2 a": 2, "3.1.4 b": 3, "1.2.3.4 c": 4, "11.2.10.3 d": 4, "1.1.2024.5 e": 3}
    for line, level in cases.items():
        assert one(spark, line, sections.heading_level(F.col("text"))) == level, line


def test_time_slots(spark):
    cases = {
        "1小时内响应，4小时内到场": [("响应", 60.0), ("到场", 240.0)],
        "服务响应时间为 2 小时，重大问题 24 小时到场处理": [("响应", 120.0), ("到场", 1440.0)],
        "7×24小时响应": [], "响应文件递交前六个月内": [], "响应机制：牵头处置，4小时内提交报告": [],
        "问题在一周内解决": [("完成", 10080.0)], "合同自2020年1月1日起交付": [], "60日内交付": [("交付", 86400.0)],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    got = {}
    for r in times.commitments(df, ["id"]).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append((r["slot"], r["minutes"]))
    assert [got.get(i, []) for i in range(len(cases))] == list(cases.values())


def test_requirements(spark):
    text = "1 | ★ | 交货时间 | 自签订之日起60日内交付\n★服务内容（清单）\n第一行内容\n第二行内容\n\n★1、投标人应当具备资质：证书一份\n"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [(r["name"], r["clause_text"], r["category"]) for r in times.hard_requirements(df, ["id"]).orderBy("item_no").collect()]
    assert got[0] == ("交货时间", "自签订之日起60日内交付", "履约交付")
    assert got[1][:2] == ("服务内容（清单）", "第一行内容 第二行内容")
    assert got[2][:2] == ("1、投标人应当具备资质", "证书一份")
    (r,) = times.time_requirements(df, ["id"]).collect()
    assert (r["slot"], r["minutes"], r["mandatory"]) == ("交付", 86400, True)


def test_contract_dates(spark):
    d = header.contract_date("text", F.lit("TCN20240400571.pdf"))
    assert tuple(one(spark, "日 期：2024年4月8日\n日 期：2024.04.03", d)) == ("2024-04-08", "signature_page")
    assert tuple(one(spark, "无日期", d)) == ("2024-04", "contract_id")
    assert tuple(one(spark, "签订日期：2015年4月8日", d)) == ("2024-04", "contract_id")
    assert tuple(one(spark, "甲方：\nx\n2024年5月6日", d)) == ("2024-05-06", "signature_page")
    best = lambda o, n: header.best_date(F.lit(o), F.lit(n), F.lit("2025-10"))
    assert one(spark, "", best("2015-11-25", "2025-10")) == "2025-10"
    assert one(spark, "", best("2025-11-25", "2025-10")) == "2025-11-25"
    assert one(spark, "", best(None, "2025-10")) == "2025-10"


def test_classifier(spark):
    vend = rules.Vendors(ours=("蓝鲸生物",), competitors=("红杉基因",), our_label="蓝鲸生物")
    cases = {
        "Thumbs.db": "system_or_temp", "a/~$x.docx": "system_or_temp", "合同/YX2024010101-检测-大学-35,000.00.pdf": "contract_evidence",
        "dzfp_1.pdf": "process_material", "材料/银行回单.pdf": "process_material", "x/招标文件.docx": "tender_requirement",
        "x/营业执照.pdf": "qualification_evidence", "x/资格证明分册.docx": "our_response", "蓝鲸生物/报价.docx": "our_response",
        "红杉基因/报价表.docx": "competitor_response", "红杉基因/蓝鲸生物.docx": "unknown", "蓝鲸生物/响应文件最终版.pdf": "final_signed",
        "x/最终版.pdf": "unknown", "x/响应文件.docx": "our_response", "x/保证金.pdf": "process_material", "x/封面.docx": "process_material",
        "x/其它.docx": "unknown", "红杉 基因/a.docx": "competitor_response", "红杉基因库/a.docx": "unknown"}
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    bad = df.withColumn("got", classify.classify("p", vend)["role"]).filter("got <> want").collect()
    assert bad == []


def test_mention_context(spark):
    m = mention.mention_line("text", ("代谢",))
    assert one(spark, "题目\n舌苔鞘脂代谢研究，其余文字与此事完全没有关系\n18例冰冻样本进行代谢测序", m) == "18例冰冻样本进行代谢测序"
    assert one(spark, "只有代谢二字", m) is None


def test_file_purpose(spark):
    p = classify.file_purpose("text", F.lit("our_response"), ("蓝鲸生物",))
    assert one(spark, "a/报价单+蓝鲸生物.pdf", p) == "我方响应（报价单）"
    assert one(spark, "a/蓝鲸生物响应文件.pdf", p) == "我方响应（蓝鲸生物响应文件）"
    assert one(spark, "x-蓝鲸生物-响应文件.docx", p) == "我方响应（x-响应文件）"


def test_snippet_and_redaction(spark):
    s = facts.snippet("text", [F.lit("乙"), F.lit("甲")], before=2, after=3)
    assert one(spark, "0\n12甲34567", s) == "12甲345"
    assert one(spark, "电话13812345678", facts.redact("text")).startswith("电话")


def test_amount_cells(spark):
    n = service_table.leading_number("text")
    for s, want in {"44,000.00 元": 44000.0, "3.5万": None, "小写：1": None, "": None, "-2": -2.0}.items():
        assert one(spark, s, n) == want


def test_marked_requirements_bind_their_parts(spark):
    from docketlens.operators import times

    docs = spark.createDataFrame([(1, "★售后服务（清单）\n第一行\n第二行\n\n不属于\n▲1、资质：证书")], "document_id int, text string")
    got = times.hard_requirements(docs, ["document_id"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[^：:，,。；;]+") == 1
    assert [(r["name"], r["clause_text"]) for r in got.orderBy("item_no").collect()] == [("售后服务（清单）", "第一行 第二行"), ("1、资质", "证书")]
