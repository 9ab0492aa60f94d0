"""Spark views that shape the driver tables into the engine's input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketlens.functions import text as tx
from docketlens.operators import identity

MONEY = "decimal(18,2)"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def read_spread(spark: SparkSession, sf: str, name: str, waves: int = 1) -> DataFrame:
    """For text work: a scan with fewer splits than task slots is spread over them first.

    The test files hold one row group each; a real table has many splits and is left alone. Texts are made longer than the rows
    they come from, so a split of rows is too much for one task of theirs: ``waves`` asks for that many tasks a slot.
    """
    scan = read(spark, sf, name)
    slots = spark.sparkContext.defaultParallelism * waves
    return scan.repartition(slots) if scan.rdd.getNumPartitions() < slots else scan


def contract_number(key, date):
    return F.concat(F.lit("TCN"), F.date_format(date, "yyyyMM"), F.lpad(key.cast("string"), 6, "0"))


def order_paths(spark: SparkSession, sf: str, orders: DataFrame | None = None, *more: str) -> DataFrame:
    """One contract file per order, with the file-name pattern number-product-client-amount; ``more`` columns of ``orders`` stay."""
    o, c = read_spread(spark, sf, "orders") if orders is None else orders, read(spark, sf, "customer")
    k = F.col("o_orderkey")
    number = contract_number(k, F.col("o_orderdate"))
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "c_name",
            "c_nationkey", "c_mktsegment", *more,
            F.col("o_totalprice").cast(MONEY).alias("total_amount"),
            number.alias("contract_number"),
            F.date_format("o_orderdate", "yyyy").alias("source_root_id"),
            F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.col("c_mktsegment")).alias("project_folder"),
        )
        .withColumn("relative_path", F.concat(
            "project_folder", F.lit("/"), "contract_number", F.lit("-"), "c_name", F.lit("-"),
            F.col("total_amount").cast("string"), F.lit(".pdf")))
        .withColumn("document_id", identity.document_id("source_root_id", "relative_path"))
    )


def contract_documents(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return order_paths(spark, sf).select(
        "o_orderkey", "document_id", "source_root_id", "project_folder", "relative_path", "c_nationkey",
        F.when(k % 11 == 0, "tender_requirement").when(F.col("o_orderstatus") == "F", "final_signed")
        .when(F.col("o_orderstatus") == "O", "contract_evidence").otherwise("our_response").alias("document_role"),
        F.when(k % 13 == 0, "paused").otherwise("done").alias("parse_status"),
        F.when(k % 17 == 0, "framework_sample").otherwise("").alias("doc_subtype"),
        F.when(k % 19 != 0, F.sha2(F.concat(F.lit("body-"), k.cast("string")), 256)).alias("canonical_document_id"),
        F.when(F.col("o_orderpriority").startswith("1"), "native_text")
        .when(F.col("o_orderpriority").startswith("2"), "native_pdf_text")
        .when(F.col("o_orderpriority").startswith("3"), "mixed")
        .when(F.col("o_orderpriority").startswith("4"), "scanned_ocr").otherwise("native_xlsx_text")
        .alias("content_format"),
    )


def contract_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """One artifact per canonical content; every 23rd has drifted to another hash."""
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").filter(k % 19 != 0).select(
        F.sha2(F.concat(F.lit("body-"), k.cast("string")), 256).alias("canonical_document_id"),
        F.sha2(F.concat(F.when(k % 23 == 0, "drift-").otherwise("body-"), k.cast("string")), 256).alias("sha256"),
        F.lit("v2").alias("parser_version"),
    )


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    li, s = read(spark, sf, "lineitem"), read(spark, sf, "supplier")
    first = li.filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    sellers = first.join(s, first.l_suppkey == s.s_suppkey).select("l_orderkey", F.col("s_name").alias("party_b"))
    k = F.col("o_orderkey")
    # Sellers join before names and ids are made of an order: these are several times as wide as its row.
    o = read_spread(spark, sf, "orders")
    return order_paths(spark, sf, o.join(sellers, o.o_orderkey == sellers.l_orderkey, "left"), "party_b").select(
        F.concat(F.lit("CTL-"), k.cast("string")).alias("contract_id"),
        "document_id", F.lit(1).alias("ordinal"), "contract_number",
        F.col("c_name").alias("party_a"), "party_b",
        F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).alias("contract_date"),
        "total_amount",
        F.when(k % 29 != 0, F.sha2(F.concat(F.lit("body-"), k.cast("string")), 256)).alias("source_sha256"),
        F.when(k % 31 == 0, "v1").otherwise("v2").alias("parser_version"),
    )


def contract_items(spark: SparkSession, sf: str) -> DataFrame:
    li, p = read_spread(spark, sf, "lineitem"), read(spark, sf, "part")
    unknown = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 3)
    subtotal = F.col("l_linenumber") == 7
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.concat(F.lit("CTL-"), F.col("l_orderkey").cast("string")).alias("contract_id"),
        F.struct(F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"),
                 F.col("l_extendedprice").alias("d"), F.col("l_quantity").alias("e")).alias("row_order"),
        F.concat_ws("/", "p_type", "p_name").alias("product_raw"),
        F.col("l_quantity").alias("quantity"), F.col("p_retailprice").cast(MONEY).alias("unit_price"),
        F.col("l_extendedprice").cast(MONEY).alias("declared_amount"),
        F.when(~unknown, F.col("l_extendedprice").cast(MONEY)).alias("line_amount"),
        F.when(subtotal, "product_subtotal").otherwise("detail").alias("row_type"),
        F.when(subtotal, "explicit_product_subtotal")
        .when(F.col("l_linestatus") == "O", "derived_qty_x_price").otherwise("declared")
        .alias("product_amount_source"),
        F.concat_ws(" | ", F.col("l_linenumber").cast("string"), "p_name", F.col("l_quantity").cast("int").cast("string"),
                    F.col("l_extendedprice").cast(MONEY).cast("string")).alias("evidence_text"),
    )


def approved_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Allow-list of 12-character id prefixes: files of customers in the first twenty nations."""
    return order_paths(spark, sf).filter("c_nationkey < 20").select(
        F.substring("document_id", 1, 12).alias("id_prefix"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as dated facts: month, open range, closed range or no period."""
    m = F.date_format("ts", "yyyy-MM")
    r = F.pmod("event_id", F.lit(4))
    d = F.dayofmonth("ts")
    shift = F.date_format(F.add_months("ts", 2), "yyyy-MM")
    return read_spread(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("document_id"),
        F.col("event_type").alias("fact_type"),
        F.when(r == 0, m).when(r == 1, F.concat(m, F.lit("~"))).when(r == 2, F.concat(m, F.lit("~"), shift))
        .alias("fact_value"),
        F.when(F.pmod("event_id", F.lit(5)) == 0, F.concat(F.lit("[our_response] "), F.lit("file-"), F.col("user_id").cast("string"), F.lit(".txt")))
        .when(F.pmod("event_id", F.lit(5)) == 1, F.lit(""))
        .otherwise(F.concat(F.lit("[tender_requirement] value "), F.col("value").cast(MONEY).cast("string")))
        .alias("evidence_text"),
    )


def fact_documents(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("document_id")
    return read(spark, sf, "events").select(F.col("user_id").alias("document_id")).distinct().select(
        "document_id",
        F.concat(F.lit("p"), (u % 7).cast("string"), F.lit("/file-"), u.cast("string"), F.lit(".txt")).alias("relative_path"),
        F.concat(F.lit("p"), (u % 7).cast("string")).alias("project_folder"),
        F.when(u % 3 == 0, "our_response").when(u % 3 == 1, "tender_requirement").otherwise("process_material")
        .alias("document_role"),
    )


def text_documents(spark: SparkSession, sf: str) -> DataFrame:
    """documents as catalog rows with text."""
    return read_spread(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"),
        F.col("source").alias("project_folder"), "lang", "text",
        F.when(F.col("doc_id") % 5 == 0, "scanned_ocr").when(F.col("doc_id") % 5 == 1, "mixed").otherwise("native_text")
        .alias("content_format"),
        F.when(F.col("doc_id") % 4 == 3, "tender_requirement").when(F.col("doc_id") % 4 == 2, "final_signed")
        .otherwise("our_response").alias("document_role"),
    )


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims listed in response files; most are copies of a few texts."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    party = F.concat(F.lit("Buyer "), (c % 40).cast("string"))
    amount = F.when(c % 6 != 0, ((c % 40) * 5000).cast(MONEY))
    ordinal = (c % 9 + 1).cast("int")
    o = order_paths(spark, sf)
    return o.select(
        F.concat(F.lit("LEDGER-"), "document_id", F.lit("-"), ordinal.cast("string")).alias("contract_id"),
        "document_id", ordinal.alias("ordinal"), party.alias("party_a"), amount.alias("total_amount"),
        F.when(k % 10 == 0, "").otherwise(F.concat(
            F.lit("[业绩清单] 类似业绩一览表 | 行"), ordinal.cast("string"), F.lit(": "), (c % 40).cast("string"),
            F.lit(" | 项目:"), "c_mktsegment", F.lit(" "), "source_root_id", F.lit(" 采购人:"), party,
            F.when(amount.isNull(), F.lit(" 金额说明:本行未取到")).otherwise(
                F.concat(F.lit(" 金额:"), amount.cast("string"), F.lit("元"))), F.lit(" | 位置:line3")))
        .alias("evidence_text"))


def vouchers(spark: SparkSession, sf: str) -> DataFrame:
    """Payment ledger rows; the contract number is written with confusable characters."""
    k = F.col("o_orderkey")
    o = order_paths(spark, sf).filter(k % 3 == 0)
    return o.select(
        k.alias("record_no"), F.lower(F.translate("contract_number", "01", "Ol")).alias("contract_number"),
        F.when(k % 9 == 0, "未到款").otherwise("").alias("payee"),
        F.when(k % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("pay_time"))


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return order_paths(spark, sf).filter(k % 4 == 1).select(
        "contract_number", F.concat(F.lit("银行回单/"), "contract_number", F.lit("-1.jpg")).alias("inner_path"))


def text_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """One contract per text document."""
    d = F.col("doc_id")
    return read(spark, sf, "documents").select(
        F.concat(F.lit("CTL-T"), d.cast("string")).alias("contract_id"), d.alias("document_id"),
        F.col("source").alias("party_a"), F.col("lang").alias("party_b"),
        F.when(d % 3 != 2, F.concat(F.lit("2024-"), F.lpad((d % 12 + 1).cast("string"), 2, "0"))).alias("contract_date"),
        (d * 10).cast(MONEY).alias("total_amount"))


def text_contract_items(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf, "documents").filter(d % 6 == 0).select(
        F.concat(F.lit("CTL-T"), d.cast("string")).alias("contract_id"),
        F.when(d % 12 == 0, "thion/basic").otherwise("other/basic").alias("product_raw"),
        F.lit("detail").alias("row_type"))


def contract_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One contract text per line item, in three table layouts (by line number)."""
    li, p, o = read_spread(spark, sf, "lineitem"), read(spark, sf, "part"), read(spark, sf, "orders")
    layout = F.pmod("l_linenumber", F.lit(3))
    s = lambda c: F.col(c).cast("string")
    price, total, n, qty = (F.col(c) for c in ("_price", "_total", "_n", "_qty"))
    retail = F.col("p_retailprice").cast(MONEY).cast("string")
    blank_when_returned = F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(price, F.lit(" 元")))
    with_cat = F.concat(
        F.lit("服务类别 | 序号 | 服务名称 | 单位 | 数量 | 单价（元） | 金额（元）\n"),
        F.concat_ws(" | ", "p_type", F.lit("1"), "p_name", F.lit("样"), qty, retail, blank_when_returned), F.lit("\n\n"),
        F.concat_ws(" | ", "p_type", F.lit(""), F.concat("p_name", F.lit("-补")), F.lit("样"), F.lit("2"), F.lit("10.50"), F.lit("21.00")), F.lit("\n"),
        F.lit("服务类别 | 序号 | 服务名称 | 单位 | 数量 | 单价（元） | 金额（元）\n"),
        F.concat_ws(" | ", "p_type", F.lit(""), F.lit("小计"), F.lit(""), F.lit(""), F.lit(""), price), F.lit("\n"),
        F.concat_ws(" | ", "p_type", F.lit("9"), F.lit(""), F.lit("样"), F.lit("3")), F.lit("\n"))
    no_cat = F.concat(
        F.lit("序号 | 检测项目 | 计量单位 | 数量 | 合计金额（元/年）\n"),
        F.lit(" | "), F.concat_ws(" | ", "p_name", F.lit("样"), qty, blank_when_returned), F.lit("\n"),
        F.lit("单位说明 | x\n"))
    unnamed = F.concat(
        F.lit("服务类别（服务名称）| 编 | 数量 | 总价\n"),
        F.concat_ws(" | ", F.lit("甲"), F.lit("1"), "p_name", retail, price), F.lit("\n"),
        F.concat_ws(" | ", F.lit("甲"), F.lit("2"), "p_name", F.lit("样"), qty, retail), F.lit("\n"))
    d = F.col("o_orderdate")
    signed = (F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("签订日期："), F.date_format(d, "yyyy年M月d日")))
              .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("甲方代表签名：\n日 期："), F.date_format(d, "yyyy.M.d")))
              .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("（公章）\n\n"), F.date_format(d, "yyyy年M月")))
              .otherwise("联系电话 12345"))
    # Values used more than once are columns of their own. A lambda keeps the long projection out of the method of the joins, which the JVM would not compile.
    rows = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey).withColumns({
        "_price": F.format_number(F.col("l_extendedprice").cast(MONEY), 2), "_total": F.format_number(F.col("o_totalprice").cast(MONEY), 2),
        "_n": F.pmod(F.col("o_custkey"), F.lit(50)).cast("string"), "_qty": F.col("l_quantity").cast("int").cast("string")})
    return rows.select(
        F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey"), qty, price).alias("document_id"),
        "l_orderkey", "l_linenumber", "l_returnflag", "o_orderdate", "o_orderkey",
        F.concat("o_orderkey", F.lit("/"), contract_number(F.col("o_orderkey"), d), F.lit("-"),
                 F.when(layout == 0, F.concat(F.col("p_type"), F.lit("检测"))).when(layout == 1, F.lit("LC-MS-检测服务")).otherwise("张三"),
                 F.lit("-第"), n, F.lit("大学"),
                 F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("-"), total)).otherwise(""),
                 F.lit(".pdf")).alias("relative_path"),
        F.concat(
            F.lit("技术服务合同\n甲方（使用部门）：第"), n, F.lit("大学\n"),
            F.when(F.col("o_orderkey") % 5 == 0, "需方（甲方） | 供方（乙方）\n").otherwise(tx.let(n, lambda x: F.concat(F.lit("乙方： | 第"), x, F.lit("检测公司　\n")))),
            F.lit("合同总金额为：人民币"), total, F.lit("元整\n"),
            F.when(layout == 0, with_cat).when(layout == 1, no_cat).otherwise(unnamed),
            F.lit("合计（元）： | 大写：贰拾柒万元 | 小写："), F.lit("| "), price, F.lit("\n"), signed,
            F.lit("\n序号 | 技术参数 | 要求\n1 | 参数 | 5 | 6 | 7 | 8 | 9\n")).alias("text"))


def claim_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One response text per order with a claim ledger in one of four layouts."""
    o = read_spread(spark, sf, "orders", 8)
    k, n = F.col("o_orderkey"), F.pmod(F.col("o_custkey"), F.lit(60)).cast("string")
    m = F.pmod(k, F.lit(5))
    wan = F.floor(F.col("o_totalprice") / 10000).cast("string")
    yuan = F.col("o_totalprice").cast(MONEY).cast("string")
    y = F.date_format("o_orderdate", "yyyy")
    party = F.concat(F.lit("东湖大学第"), n, F.lit("医院"))
    table = F.concat(
        F.lit("六、类似业绩一览表\n序 号 | 采购人 | 项目名称 | 合同金额（万元）\n1 | "), party, F.lit(" | 土壤成分检测项目"), n, F.lit(" | "), wan,
        F.lit("\n2 | 北山医院\n| 血清分析服务项目 | 8万元\n\n序 号 | 采购人 | 项目名称 | 合同金额（万元）\n3 | 西溪研究院 | 水质检测项目 | \n注：完\n4 | 不读 | 不读 | 5"))
    blocks = F.concat(
        F.lit("十二、近三年项目业绩清单\n1、业绩1\n项目名称 | 河道水样检测\n服务合同\n采购人名称 | "), party, F.lit("\n合同价格 | "), wan,
        F.lit("万\n签订日期 | "), y, F.lit("年3月\n2、业绩2\n采购人 | 西岸中心\n合同金额 | "), yuan, F.lit("元"))
    cross = F.concat(
        F.lit("五、类似项目一览表\n序号 | 年份 | 项目名称 | 采购单位\n1 | 2023 | 大气颗粒分析测试项目"), n, F.lit(" | "), party,
        F.lit("\n四、后续章节\n附：大气颗粒分析测试项目"), n, F.lit("合同（"), party, F.lit("，"), wan, F.lit("万）\n"))
    no_seq = F.concat(F.lit("类似项目业绩情况表\n项目名称 | 买方名称 | 合同价格（元）\n稻米成分检测服务 | "), party, F.lit(" | "), yuan, F.lit("元\n说明文字\n4.下一节"))
    empty = F.concat(F.lit("业绩清单\n序号 | 采购人 | 项目名称 | 合同金额\n本次无业绩"), F.when(k % 2 == 0, F.lit("\n注：无")).otherwise(F.lit("")))
    return o.select(k.alias("document_id"), F.when(m == 0, table).when(m == 1, blocks).when(m == 2, cross).when(m == 3, no_seq).otherwise(empty).alias("text"))


def numbered_texts(spark: SparkSession, sf: str) -> DataFrame:
    """documents with every third line turned into a numbered heading of 24 characters."""
    d = read_spread(spark, sf, "documents").select("doc_id", "source", F.split("text", "\n").alias("l"))
    head = lambda s, i: F.concat(((i / 3).cast("int") % 20 + 1).cast("string"), F.lit("."), (i % 7 + 1).cast("string"), F.lit(" "),
                                 F.trim(F.substring(F.regexp_replace(s, "[^a-zA-Z ]", ""), 1, 24)))
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("project_key"),
                    F.array_join(F.transform("l", lambda s, i: F.when(i % 3 == 0, head(s, i)).otherwise(s)), "\n").alias("text"))


def material_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Response texts with declarations, vouchers, instruments and purchase contracts, one per event."""
    e = read_spread(spark, sf, "events", 8)
    k, t = F.col("event_id"), F.col("event_type")
    ym = F.date_format("ts", "yyyy年M月")
    ymd = F.date_format("ts", "yyyy年M月d日")
    amount = F.format_number((F.col("value") * 1000).cast(MONEY), 2)
    n = F.pmod(F.col("user_id"), F.lit(30)).cast("string")
    m = F.pmod(k, F.lit(5))
    return e.select(
        k.alias("document_id"), F.when(k % 3 == 0, "our_response").otherwise("tender_requirement").alias("document_role"),
        F.concat(F.lit("20240115-客户"), n, F.lit("/材料"), k.cast("string"), F.when(m == 0, "社保").when(m == 1, "审计报告").when(m == 2, "仪器").otherwise("说明"), F.lit(".pdf")).alias("relative_path"),
        F.when(m == 0, F.concat(F.lit("现附上自"), ymd, F.lit("至2024年12月31日我方缴纳的社会保险凭据\n社会保险费缴费记录 "), F.date_format("ts", "yyyy-MM"), F.lit(" | 入库 "), F.date_format("ts", "yyyy-MM-dd"), F.lit("\n授权有效期至2026年3月")))
        .when(m == 1, F.concat(F.lit("税务局完税证明\n金额合计\n（大写）人民币\n¥"), amount, F.lit("\n现附上（2023年度）财务报告，"), t))
        .when(m == 2, F.concat(F.lit("拥有"), n, F.lit("台Model"), n, F.lit("分析仪，另有2台Model"), n, F.lit("分析仪PLUS。附件：拥有9台的 Zeta-"), n, F.lit(" 质谱采购合同，不签订采购合同")))
        .when(m == 3, F.concat(F.lit("1、资质证书\n现附上（填写年度）财务报告\n"), ym, F.lit("社保缴纳情况\n其它")))
        .otherwise(F.concat(F.lit("说明 "), t)).alias("text"))
