"""Word lists, patterns, thresholds and labels the results depend on.

Everything here is data. Company names and product lists are not part of the package;
callers pass them in (see :class:`Vendors` and the dictionary sources).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: roles, statuses, formats -------------------------------------------------
UNKNOWN = "unknown"
OUR_RESPONSE = "our_response"
FINAL_SIGNED = "final_signed"
COMPETITOR_RESPONSE = "competitor_response"
TENDER_REQUIREMENT = "tender_requirement"
CONTRACT_EVIDENCE = "contract_evidence"
QUALIFICATION_EVIDENCE = "qualification_evidence"
PROCESS_MATERIAL = "process_material"
SYSTEM_TEMP = "system_or_temp"

EVIDENCE_ROLES = (OUR_RESPONSE, FINAL_SIGNED)
VALID_ROLES = (OUR_RESPONSE, FINAL_SIGNED, CONTRACT_EVIDENCE)
BLOCKED_STATUSES = ("holding_review", "paused", "blocked", "skipped")
BLOCKED_SUBTYPES = ("framework_sample",)
PARSE_ROLES = (OUR_RESPONSE, FINAL_SIGNED, CONTRACT_EVIDENCE, PROCESS_MATERIAL,
               QUALIFICATION_EVIDENCE, TENDER_REQUIREMENT, UNKNOWN)

ROLE_RANK = {OUR_RESPONSE: 0, FINAL_SIGNED: 0}
LOCATE_FORMAT_RANK = {"native_text": 0, "native_pdf_text": 0, "native_xlsx_text": 0,
                      "mixed": 1, "scanned_ocr": 2}
EVIDENCE_FORMAT_RANK = {"native_text": 0, "mixed": 1, "scanned_ocr": 2}

ROLE_LABELS = {
    OUR_RESPONSE: "我方响应", FINAL_SIGNED: "我方最终版", CONTRACT_EVIDENCE: "合同证据",
    COMPETITOR_RESPONSE: "竞品响应", TENDER_REQUIREMENT: "招标要求",
    QUALIFICATION_EVIDENCE: "资质证明", PROCESS_MATERIAL: "过程材料",
    SYSTEM_TEMP: "系统/临时", UNKNOWN: "待定", "ambiguous": "未判定",
}
ROLE_SCOPE_LABELS = {"our": "我方响应/最终版", "tender": "招标要求（采购人要求，非我方已附）",
                     "other": "其它来源文件"}

# --- fixed values: amount provenance ----------------------------------------------------------
DECLARED = "declared"
EXPLICIT_SUBTOTAL = "explicit_product_subtotal"
DERIVED = "derived_qty_x_price"
FILENAME_TOTAL = "filename_product_total"
CONFLICT_TOLERANCE = 0.01

# --- fixed values: path classification ------------------------------------------------------
TENDER_HINTS = ("招标文件", "采购文件", "谈判文件", "磋商文件", "比选文件", "询比函", "需求书",
                "评分标准", "采购公告", "招标公告")
QUALIFICATION_HINTS = ("资格证明", "资质", "营业执照", "许可证", "社保证明", "社保凭证", "纳税",
                       "完税", "审计报告", "中小企业声明", "信用中国")
RECEIPT_HINTS = ("银行回单", "回单", "进账", "到账", "电子回单")
PROCESS_HINTS = ("付款", "缴费", "支付凭证", "发票", "报销", "报名", "保证金", "履约", "密封",
                 "封条", "封面", "签到", "保函", "回执")
RESPONSE_HINTS = ("响应文件", "投标文件", "商务技术文件", "商务文件", "技术文件", "报价文件",
                  "报价单", "报价表", "响应表", "技术参数配置清单", "投标报价", "分项报价")
PARTITION_HINTS = ("商务技术部分", "商务技术分册", "商务部分", "技术部分", "资格文件部分",
                   "资格证明部分", "资格证明分册", "报价部分")
FINAL_FLAGS = ("最终版", "定稿版", "定稿", "终稿", "签章版", "盖章版", "正本", "盖章扫描版",
               "盖章扫描件", "扫描盖章")
NON_FINAL_HINTS = ("待定稿", "未定稿", "待盖章", "未盖章", "待签章", "未签章", "作废", "不需要提供")
SIGNED_HINTS = ("最终", "定稿", "终稿", "签章", "盖章", "正本")
SIGNED_AUXILIARY_HINTS = ("发票", "封皮", "封面", "封条", "外包装", "盖章要求", "签章要求",
                          "盖章说明", "签章说明", "提前盖章", "现场填写")
COVER_HINTS = ("封皮", "信封", "外包装", "封条", "封面")
CONTRACT_NAME_HINTS = ("合同", "业绩证明", "业绩材料")
CONTRACT_FOLDERS = ("合同", "合同附件", "项目业绩")
MULTI_VENDOR_HINTS = ("多家公司", "多家供应商", "多供应商")
BIDDER_WORDS = ("投标人", "投标单位", "供应商", "响应人", "响应方", "乙方", "受托方")
PATH_AMOUNT = r"(?<!\d)(?:\d{1,3}(?:,\d{3})+(?:\.\d{2})?|\d+\.\d{2}|[5-9]\d{4}|\d{6,})(?!\d)"
ORDER_NUMBER = r"[A-Z]{2,4}\d{6,}"
EXCLUDED_FOLDER_WORD = "非标书"
SYSTEM_NAMES = ("thumbs.db",)

# --- fixed values: contract detail tables ---------------------------------------------------
DETAIL_NAME_COLUMNS = ("服务名称", "服务类别", "服务内容", "服务项目", "测试项目", "检测项目", "项目名称")
DETAIL_PRICE_COLUMNS = ("单价", "金额", "总价", "价格", "费用")
DETAIL_AMOUNT_COLUMNS = ("金额", "总价", "价格", "费用")
QUANTITY_COLUMN = "数量"
SUBTOTAL_WORDS = ("合计", "总计", "小计", "总计：")
CONTRACT_TOTAL_WORDS = ("合同总金额", "合同金额", "本合同总价", "总计（元）")
CONTRACT_TOTAL_LABEL = "合同总金额"
OTHER_TABLE_SEQ = ("序号", "编号")
OTHER_TABLE_WORDS = ("名称", "项目", "参数", "要求", "规格")

# --- fixed values: contract header and dates ------------------------------------------------
FILE_EXTENSIONS = r"(?i)\.(pdf|jpg|jpeg|png)$"
CONTRACT_NUMBER = r"^[^0-9A-Za-z]{0,6}([A-Z]{2,4}\d{6,})"
PARTY_PATTERN = (r"{label}\s*方(?:[（(]\s*[^）)]{{0,12}}?\s*[）)])?"
                 r"[^一-龥]{{0,4}}[:：|]\s*\|?\s*([一-龥A-Za-z0-9（）()· 　]{{4,40}})")
FILE_AMOUNT = r"(?i)([\d,，]{3,}(?:\.\d{1,2})?)\s*(?:\(\d\))?\.(?:pdf|jpg|jpeg|png)$"
TEXT_TOTAL = (r"(?:合同总金额|合同总额|合同金额|总金额|价税合计)[^\d\n]{0,14}"
              r"([\d,，]{3,}(?:\.\d{1,2})?)\s*元")
TEXT_TOTAL_ROW = r"合同总(?:金额|额)\s*[（(]\s*元\s*[）)]\s*\|\s*([\d,，]+(?:\.\d+)?)"
ORG_WORDS = ("公司", "大学", "医院", "研究院", "研究所", "学院", "中心", "集团", "部队", "学校", "局",
             "委员会", "保健院", "卫生院", "科学院", "实验室", "基金会", "协会", "学会", "红十字会",
             "事务所", "公益", "分院", "分校")
ORG_TAIL = r"[（(](供货|服务方|盖章|签字)[^）)]*[）)]$"
PARTY_LABEL_CELL = r"[（(](甲方|乙方|需方|供方|采购人|供应商|委托方|受托方)[）)]"
ID_CENTURY = "20"
CONTRACT_ID_DATE = r"^([A-Z]{{2,4}})((?:{century})\d{{2}})(\d{{2}})(\d{{2,4}})"
DATE_BY_SIGNING = r"于\s*(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日\s*[（(]\s*[“\"]?\s*签署日"
DATE_LABELLED = (r"(?:签订|签署|签约|签字)\s*(?:日期|时间)\s*[:：]?\s*"
                 r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})?\s*日?")
DATE_BARE = r"日\s*期\s*[:：]\s*(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})?\s*日?"
DATE_LABELLED_DOT = (r"(?:签订|签署|签约|签字)\s*(?:日期|时间)\s*[:：]?\s*"
                     r"(20\d{2})\s*[.\-/．]\s*(\d{1,2})\s*[.\-/．]\s*(\d{1,2})")
DATE_BARE_DOT = r"日\s*期\s*[:：]\s*(20\d{2})\s*[.\-/．]\s*(\d{1,2})\s*[.\-/．]\s*(\d{1,2})"
DATE_LINE = r"^\s*[（(]?\s*(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})?\s*日?\s*[)）]?\s*$"
DATE_LINE_DOT = (r"^\s*[（(]?\s*(20\d{2})\s*[.\-/．]\s*(\d{1,2})\s*[.\-/．]\s*(\d{1,2})"
                 r"\s*[)）]?\s*$")
DATED_LINE = r"20\d{2}\s*[年.\-/．]"
SIGNATURE_WORDS = ("公章", "签名", "盖章", "甲方", "乙方", "委托方", "受托方", "采购人", "供应商")
YEAR_MIN, YEAR_MAX = 2015, 2030
CLIENT_LIKE = r"(公司|大学|医院|研究院|研究所|学院|中心|实验室|疾控|部队|集团|学校|保健院|卫生院|科学院|测试中心)"
AMOUNT_LIKE = r"^[\d,，.\s()（）万元个样次例]+$"
PRODUCT_WORDS = r"(测序|检测|分析|鉴定|定量|标记|服务|质谱|芯片|空间|细胞|[Pp]anel)"
PRODUCT_NOISE = r"^(?:\d+|\d+\s*个样本|/\s*样本|---|—+)$"

# --- fixed values: claim ledgers ------------------------------------------------------------
LEDGER_TITLE = r"(业绩|类似项目|合同).{0,10}(清单|一览|汇总|情况表|列表)"
LEDGER_TITLE_WORD = "合作单位证明"
LEDGER_PARTY_KEYS = ("采购人", "买方", "使用单位", "客户", "甲方", "委托方", "项目单位", "采购单位",
                     "单位名称", "用户情况", "客户名称", "业主单位", "业主情况", "用户单位", "委托单位")
LEDGER_AMOUNT_COLUMN = r"金额|总价|价格|合同额"
LEDGER_PROJECT_COLUMN = r"项目名称|项目内容|服务名称|业绩名称|工作主要内容|合同主要内容|采购内容"
LEDGER_CONTENT_COLUMN = r"项目|服务内容|服务名称|业绩|标的|采购内容|工作内容|主要内容"
LEDGER_ORG_WORDS = ("公司", "大学", "医院", "研究院", "研究所", "学院", "中心", "学校", "科学院", "实验室",
                    "集团", "疾控", "检测", "检验", "设计院", "事务所", "委员会", "管理局", "部队",
                    "保健院", "防治", "总院", "分院", "附属")
LEDGER_ROW_START = r"^\d{1,3}(?:\s*\||\s)"
LEDGER_SECTION_HEAD = r"^[一二三四五六七八九十百]{1,3}\s*[、.．]"
LEDGER_CLOSERS_START = ("注：", "4.", "4)", "6-2", "附表", "项目经理", "项目负责人")
LEDGER_CLOSER_WORD = "投标人可按上述"
LEDGER_EMPTY_WORDS = ("无相关业绩", "无业绩", "本次无业绩", "未附业绩清单", "不适用业绩", "无",
                      "无类似业绩", "无符合条件的业绩", "空")
LEDGER_BLOCK = r"^\s*\d{1,3}\s*[、.．]\s*业绩\s*\d*\s*$"
LEDGER_KEY = (r"^(项目名称|采购人名称|采购人|买方名称|买方|使用单位|客户名称|甲方|委托方|项目单位|采购单位|"
              r"合同价格|合同金额|合同总价|合同总额|合同签订日期|合同签订时间|签订日期|签订时间|"
              r"交付日期|项目所在地|项目描述|服务期|备注)\s*\|\s*(.*)$")
LEDGER_KEY_PARTY = ("采购人名称", "采购人", "买方名称", "买方", "使用单位", "客户名称", "甲方", "委托方",
                    "项目单位", "采购单位")
LEDGER_KEY_AMOUNT = ("合同价格", "合同金额", "合同总价", "合同总额")
LEDGER_KEY_DATE = ("合同签订日期", "合同签订时间", "签订日期", "签订时间", "交付日期")
LEDGER_KEY_PARTY_WRAP = ("采购人名称", "买方名称", "客户名称")
LEDGER_PURE_NUMBER = r"^\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?$"
LEDGER_DATE_CELL = (r"^(?:20\d{2}\s*年?)(?:\s*[-~—至到]\s*20\d{2}\s*年?)?"
                    r"(?:\s*\d{1,2}\s*月)?(?:\s*\d{1,2}\s*日)?\s*$|^20\d{2}\.\d{1,2}$")
LEDGER_CONTACT_CELL = r"\d{7,}|@|\d{3,4}[-－]\d{7,}"
LEDGER_NOTE_CELL = r"^[（(].*[）)]$|为准|公告日期|签字日期|详见|略$|^备注"
LEDGER_PARTY_CELL = r"^[一-龥·（）()A-Za-z0-9]{2,40}$"
LEDGER_CHINESE_CELL = r"^[一-龥·（）()]{2,40}$"
LEDGER_TAIL_AMOUNT = r"[（(]?[^（()）]*?[，,\s]\s*(\d+(?:\.\d+)?)\s*(万元|万|元)[）)]?\s*$"
LEDGER_CAP_YUAN = 100_000_000.0
LEDGER_CAP_WAN = 1_000_000_000.0
NO_AMOUNT_COLUMN, NO_AMOUNT_IN_ROW = "表未设金额列", "本行未取到"
CROSS_REFERENCE_SOURCE = "同文档合同清单"
CLAIM_PROJECT = r"项目:(.*?)(?:\s+采购人:|\s+金额:|\s*\|)"
CLAIM_ABSENT = r"金额说明:(表未设金额列|本行未取到)"

# --- fixed values: material facts -----------------------------------------------------------
DECLARATION_WORD = "现附上"
DECLARATION = r"现附上.{0,140}"
PLACEHOLDER = r"填写|＿|_{2,}|年\s{2,}月|月\s{2,}日|具体的年度"
DECLARATION_KINDS = (("social_security_month", ("社会保险", "社会保障", "社保")),
                     ("finance_period", ("税收", "纳税", "财务报告", "财务审计", "资信证明")))
PERIOD_RANGE = (r"自\s*(20\d{2})\s*年\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*日)?\s*"
                r"(?:至|-|—)\s*(20\d{2})\s*年\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*日)?")
PERIOD_OPEN_MONTH = r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(?:至今|起)"
PERIOD_OPEN_YEAR = r"(20\d{2})\s*年\s*(?:至今|起)"
PERIOD_YEAR = r"[（(]\s*(20\d{2})\s*年度?\s*[）)]"
PERIOD_YEAR_LOOSE = r"(20\d{2})\s*年度?"
SCAN_YEAR = r"(20\d{2})\s*年度?"
SCAN_YEAR_MONTH = r"(20\d{2})\s*年\s*(\d{1,2})\s*月"
SCAN_YEAR_RANGE = r"(20\d{2})\s*[-~至]\s*(20\d{2})"
SCAN_MASK = r"(?:有效期限|有效期|授权期限|委托期限|证书有效|投标有效|认证有效)[^\n。；]{0,80}"
SCAN_DASH = r"(20\d{2})[-/.](\d{1,2})(?![\d])"
SCAN_DASH_MONTH = r"(20\d{2})[-/.](\d{1,2})(?![-/.\d])"
SCAN_CN_MONTH = r"(20\d{2})\s*年\s*(\d{1,2})\s*月(?!\s*\d)"
SOCIAL_MARKERS_STRONG = ("社会保险费缴费记录", "社会保障记录")
SOCIAL_MARKERS = SOCIAL_MARKERS_STRONG + ("社会保险事业管理中心", "社保经办机构", "社会保险", "社保")
FINANCE_MARKERS_STRONG = ("财务报告", "审计报告", "资产负债表", "利润表", "资信证明")
FINANCE_MARKERS = FINANCE_MARKERS_STRONG + ("纳税", "完税", "税收凭据", "税收业务专用章")
VOUCHER_ANCHORS = ("金额合计", "价税合计", "合计金额", "总金额")
VOUCHER_MARKS = ("税务机关", "税务局", "社会保险", "社会保障", "社会保障局", "完税证明", "税收完税",
                 "纳税证明", "电子税务局")
VOUCHER_YEN = r"[¥￥]\s*([\d,]{3,}(?:\.\d{1,2})?)"
VOUCHER_CAPITAL = r"[（(]\s*大写\s*[）)]?[^\n]{0,60}\n\s*([\d,]{3,}(?:\.\d{1,2})?)"
VOUCHER_WINDOW = 120
MATERIAL_KINDS = (
    ("social_security_month", ("完税证明", "社保", "社会保险", "养老", "医疗", "失业", "工伤")),
    ("finance_period", ("财务社保数据统计表", "审计报告", "财务报告", "资产负债表", "利润表", "资信证明", "纳税")),
    ("instrument_photo", ("仪器照片", "设备照片", "实拍")),
    ("invoice", ("购置发票", "发票")),
    ("purchase_contract", ("采购合同", "购销合同")),
    ("instrument", ("仪器", "设备", "测序仪")),
)
CLASSIFIED_LINE_KINDS = (
    ("social_security_month", ("社会保险", "社会保障", "社保")),
    ("invoice", ("发票",)), ("purchase_contract", ("采购合同",)),
    ("instrument_photo", ("仪器照片", "设备照片", "仪器实拍", "设备实拍")),
    ("instrument", ("仪器", "设备", "测序仪")),
    ("finance_period", ("财务", "审计", "纳税", "税收", "资信")),
    ("qualification", ("资质", "证书", "执照", "认证", "许可", "著作权", "体系", "荣誉")),
)
CANDIDATE_WORDS = ("财务", "审计", "纳税", "税收", "税务", "社保", "社会保障", "社会保险", "公积金", "资信",
                   "资质", "证书", "执照", "许可", "认证", "仪器", "设备", "发票", "保证金", "学历", "学位",
                   "职称", "缴纳", "缴费", "保险", "报告")
NUMBER_PREFIX = (r"^\s*(?:[（(]\s*[一二三四五六七八九十\d]{1,3}\s*[)）]|[一二三四五六七八九十]{1,3}\s*[、.．]"
                 r"|\d{1,2}\s*[、.．]|\d{1,2}\s*[-－]\s*\d{1,2}|\d{1,2}(?:\.\d{1,2}){1,3})\s*")
LINE_WITH_YEAR = r"20\d{2}\s*年"
PHONE = r"\b1[3-9]\d{9}\b"
ID_CARD = r"\b\d{17}[\dXx]\b"
PHONE_MASK, ID_CARD_MASK = "[手机号已打码]", "[身份证号已打码]"
SOFT_BREAK = r"(?<![。；！？：\n])\n(?=\S)"
UNITS_OF = r"(?:共有|拥有|配备|现有|计)?\s*(\d+)\s*台\s*([^，,。；;、\n|]{2,40})"
UNIT_NAME_STOP = ("的", "和", "同", "与", "及", "则", "后", "上")
UNIT_NAME_NOISE = r"^\s*(?:仪器|设备|如下|序列号|台|套)$"
UNIT_NAME_BAD = ("序号", "清单", "合同", "备注", "合计", "名称", "型号", "目录", "页码", "一览表", "配置",
                 "承诺", "声明", "要求", "正文", "附件", "以上", "如下", "平台", "本公司", "我方")
UNIT_NAME_REJECT = (r"[≤＜≥＞<>]", r"序列号", r"得\s*\d+\s*分|套得|以下得|得\s*[123]\s*分",
                    r"[①②③④⑤⑥⑦⑧⑨⑩]", r"的$", r"^预备$|^备用$|^计\d+$", r"^[（(]*(?:预备|备用)[）)]*$",
                    r"^1\s*分析|^1\s*织|^1\s*13%", r"完成文库的测序|空载待命|UPS不间断电源|驻外办事处",
                    r"\d{6,}")
PURCHASE_PHRASE = r"([A-Za-z一-鿿][^，,。；;\n|]{1,30}?)采购合同"
PURCHASE_DELIMITERS = r"[（(《【:：、）)》】]"
PURCHASE_COUNT = r"^\s*\d+\s*台\s*"
PURCHASE_LEAD = r"^(?:拥有|共有|现有|配备|附|见|和|及|的|方案|设备配置)*\s*"
PURCHASE_WORDS = ("测序仪", "荧光细胞分析仪", "生物分析仪", "液相色谱", "质谱", "PCR仪", "离心机",
                  "超低温冰箱", "生物安全柜", "流式细胞仪", "设备", "仪器", "色谱", "测序", "分析仪")
PURCHASE_BAD_START = ("不", "未", "无", "以", "第", "页", "见")
PATH_CANDIDATE_WORDS = ("完税", "社保", "纳税", "财务", "审计", "资信", "仪器", "设备", "发票", "采购",
                        "照片", "实拍", "凭证", "应收账款", "付款", "收款")
TEXT_CANDIDATE_WORDS = ("社会保障", "社会保险", "社保", "完税", "纳税", "财务报告", "审计报告",
                        "资产负债表", "利润表", "资信证明", "仪器", "设备清单", "发票", "采购合同",
                        "仪器照片", "设备照片", "实拍", "付款凭证", "收款凭证")
OWN_FACT_TYPES = ("social_security_month", "finance_period", "instrument", "instrument_name",
                  "purchase_contract", "instrument_purchase_contract", "invoice", "instrument_photo")
FINANCE_FACT_TYPES = ("finance_period", "social_security_month", "finance_amount")
INSTRUMENT_FACT_TYPES = ("instrument_name", "instrument", "purchase_contract",
                         "instrument_purchase_contract", "invoice", "instrument_photo")
PERIOD_FACT_TYPES = ("social_security_month", "finance_period")
SNIPPET_ANCHORS = {
    "social_security_month": ("社会保险费缴费记录", "社会保障记录", "社会保险费缴费", "单位参保证明",
                              "社会保险参保", "社保缴费明细", "社会保险", "社保"),
    "finance_period": ("完税证明", "税收完税证明", "纳税证明", "审计报告", "财务报告", "资产负债表",
                       "利润表", "资信证明", "完税", "纳税"),
    "finance_amount": ("金额合计", "合计金额", "价税合计", "准予扣除", "缴纳", "金额"),
    "instrument": ("仪器设备清单", "主要仪器设备", "检测设备仪器", "仪器清单", "设备清单", "实验设备",
                   "仪器型号", "仪器", "设备"),
    "instrument_name": ("仪器型号", "设备型号", "型号"),
    "invoice": ("发票号码", "增值税专用发票", "增值税普通发票", "发票代码", "发票"),
    "purchase_contract": ("仪器采购合同", "设备采购合同", "购销合同", "采购合同"),
    "instrument_photo": ("仪器实拍", "设备实拍", "仪器照片", "设备照片", "实拍图", "实拍"),
    "qualification": ("资质证书", "认证证书", "营业执照", "证书"),
}

# --- fixed values: sections -----------------------------------------------------------------
TEXT_HEADINGS = (r"^\s*(\d{1,2}(?:\.\d{1,2}){1,3})\s*[、.．]?\s*(\S.{0,60})$",
                 r"^\s*(\d{1,2}-\d{1,2}(?:-\d{1,2})?)\s+(\S.{0,60})$",
                 r"^\s*第\s*([一二三四五六七八九十百\d]{1,3})\s*[章节]\s*[、.．]?\s*(\S.{0,60})$")
# An address of the net: four numbers, one of them 40 or more. Its line is a boundary, but its parts are no levels.
NET_ADDRESS = r"^\s*(?=[\d.]*(?:[4-9]\d|\d{3}))\d{1,3}(?:\.\d{1,3}){3}(?![.\d])"
TOC_LINE = r"[.·…]{4,}\s*\d{1,3}\s*$"
TOC_PAGE = r"[|\s]\s*\d{1,4}(?:\s*[-–~]\s*\d{1,4})?\s*页\s*$"
CAPTION = r"^\s*(表|图)\s*\d"
APPENDIX = r"^\s*(附件|附录|附表|附\s*\d)"
TOC_TITLE = r"(?i)^\s*(目\s*录|contents)\s*$"
TOC_TITLE_LOOSE = r"(目\s*录|页码索引|页码对照|索引表)\s*$"
MAX_HEADING = 40
SENTENCE_TAIL = r"[。；！？!?；]\s*$"
SENTENCE_MIDDLE = r"[。；]"
CERTIFICATE_ROW = r"(学位证书|身份证|职称|执业资格|毕业证|联系方式\s*\|)"
PURE_DATE = r"^\s*[（(]?\s*(?:20)?\d{2}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?\s*[)）]?\s*$"
FORM_RESIDUE = r"^\s*(备注|说明|序号|注|填写说明|注意事项|无|有|是|否)\s*[：:]?\s*$"
SIGN_LINE = r"(签字|签名|盖章|（盖|\(盖|法定代表人（单位负责人）或其委托代理人|日\s*期\s*[:：])"
NAME_TITLE_ROW = (r"^(?:[一-龥]{2,4}\s*[|｜]"
                  r"|[一-龥]{2,6}(?:主管|经理|负责人|专员|签字人)[-—\s]*[一-龥]{2,4}\s*$)")
SECTION_WORD_GUARD = r"(简历|职责|配置|方案|一览|情况|团队|人员|制度|流程|说明)"
RECORD_AMOUNT = r"\d+(?:\.\d+)?\s*万元"
RECORD_BUYER = r"(大学|学院|研究院|研究所|医院|中心|公司|部队|疾控|预防控制)"
COVER_HEADING = r"(正本|副本|封面|标段号|投标日期)"
HEADING_NUMBER = (r"^\s*(?:\d{1,2}(?:[.\-]\d{1,2}){0,4}\s*[、.．]?\s*"
                  r"|[（(]\s*[一二三四五六七八九十\d]{1,3}\s*[)）]\s*"
                  r"|[一二三四五六七八九十]{1,3}\s*[、.．]\s*"
                  r"|第\s*[一二三四五六七八九十百\d]{1,3}\s*[章节步部分]+\s*[:：]?\s*)")
NOISE_TABLE_HEADER = (r"(买方名称|合同价格|合同签订日期|合同金额|申报人名称|控股股东|管理关系|"
                      r"总报价|投标声明|身份证号|法定代表人\s*/\s*单位负责人|被管理关系|"
                      r"采购人名称.*项目名称.*金额|申报清单)")
NOISE_HEADING = (r"(开标.{0,4}一览表|报价一览表|首轮报价|投标一览表|项目编号\s*[:：∶]|采购编号\s*[:：]|"
                 r"招标编号\s*[:：]|相关文章|署名.{0,4}文章|发表.{0,4}(论文|文章)|文章清单|"
                 r"^一种.{0,40}(方法|系统|设备|试剂盒|介质)\s*$|专利清单|软著|著作权清单)")
REPEAT_MIN, REPEAT_MAX_LEN = 5, 40
MIN_SECTION_CHARS = 40

# --- fixed values: evidence packs -----------------------------------------------------------
SCORE_WORDS = ("得2分", "得1分", "评分项目", "评分标准", "评审标准", "打分", "得分标准")
DUPLICATE_THRESHOLD = 0.75
SHINGLE_LENGTH = 4
NUMERIC_HEADING = r"^[\d.,%()（）\-–—～~\s]+$"
LINK_HEADING = r"(?i)^(10\.\d{4,}/|doi[:：]|https?://)"
FILE_SEPARATORS = "+·-｜_（(/ "
BM25_K1, BM25_B = 1.2, 0.75
ENGLISH_STOP_WORDS = ("a", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is",
                      "it", "no", "not", "of", "on", "or", "s", "such", "t", "that", "the", "their",
                      "then", "there", "these", "they", "this", "to", "was", "will", "with", "www")

# --- fixed values: time commitments ---------------------------------------------------------
NUMBER_UNIT = r"(\d+(?:\.\d+)?)\s*(分钟|个小时|小时|个工作日|工作日|天|日|周|[hH](?![A-Za-z]))"
CHINESE_TIME = r"([一两二三四五六七八九十半])\s*个?\s*(小时|工作日|天|日|周|个月|月|年)"
CHINESE_DIGITS = {"一": 1.0, "两": 2.0, "二": 2.0, "三": 3.0, "四": 4.0, "五": 5.0, "六": 6.0,
                  "七": 7.0, "八": 8.0, "九": 9.0, "十": 10.0, "半": 0.5}
UNIT_MINUTES = {"分钟": 1, "个小时": 60, "小时": 60, "个工作日": 480, "工作日": 480, "天": 1440,
                "h": 60, "H": 60, "年": 525600, "日": 1440, "周": 10080, "个月": 43200, "月": 43200}
ROUND_THE_CLOCK = "×*xX✕╳"
TIME_SLOTS = ("响应", "回复", "反馈", "到场", "上门", "交付", "完成", "解决", "服务周期", "质保", "保修",
              "供货周期")
SLOT_ALIAS = {"解决": "完成"}
SLOT_BLOCK_AFTER = {"响应": ("文件", "截止", "供应", "人", "函", "表", "无效", "性", "偏离"),
                    "回复": ("函",), "交付": ("物",)}
NON_SLOT_ACTIONS = ("提交", "出具", "上报", "备案", "启动", "发出", "安排", "报送", "汇总")
AFTER_LOOKAHEAD, SLOT_WINDOW, CONTEXT_WIDTH = 8, 14, 22

# --- fixed values: tender requirements ------------------------------------------------------
MANDATORY_WORDS = ("必须", "须", "应当", "应", "不得", "▲", "★", "实质性")
CLAUSE_WIDTH = 70
MARKED_TABLE_ROW = r"^\s*(\d{1,3})\s*\|\s*[★▲]\s*\|\s*([^|\n]{1,40})\s*\|\s*(.{1,200})"
MARKED_SECTION = r"^\s*[★▲]\s*([^\n|]{2,60})"
CLAUSE_CATEGORIES = (
    ("资格资质", ("营业执照", "资质", "资格", "证书", "认证", "许可", "CNAS", "ISO", "高新技术", "体系",
                  "执照", "信用", "失信", "声明函", "授权")),
    ("财务社保", ("审计报告", "财务报告", "财务报表", "纳税", "税收", "完税", "社保", "社会保障", "社会保险",
                  "资信证明", "缴纳证明", "依法缴纳")),
    ("业绩案例", ("业绩", "类似项目", "成功案例", "同类项目", "案例一览", "中标通知书", "履约经历")),
    ("人员团队", ("项目负责人", "项目经理", "职称", "人员", "团队", "学历", "驻场", "配备")),
    ("仪器设备", ("仪器", "设备", "型号", "工作站", "测序仪", "质谱")),
    ("履约交付", ("交货", "交付", "期限", "工期", "周期", "地点", "验收", "进度", "完成时间")),
    ("商务条款", ("保证金", "支付", "报价", "价格", "密封", "签章", "份数", "履约", "合同", "发票", "税",
                  "预算", "控制价", "计费", "结算", "金额", "付款")),
    ("服务要求", ("服务内容", "售后", "培训", "质保", "响应", "维护", "技术支持", "应急", "保密", "质量")),
)
CLAUSE_OTHER = "其它"
CATEGORY_POOL = {"资格资质": "qualification", "财务社保": "finance_period", "仪器设备": "instrument",
                 "业绩案例": "contracts", "服务要求": "scheme"}
POOL_FACT_TYPES = {"qualification": ("qualification",),
                   "finance_period": ("finance_period", "social_security_month"),
                   "instrument": INSTRUMENT_FACT_TYPES}

# --- fixed values: query log ----------------------------------------------------------------
QUERY_AMOUNT = r"(\d+(?:\.\d+)?)\s*(万元|万|元)"
AT_MOST_WORDS = ("以下", "以内", "不超过", "最多")
QUERY_DATE = r"(20\d{2})\s*年\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*日)?"
AFTER_WORDS = ("以后", "之后", "以来", "起", "后")
BEFORE_WORDS = ("以前", "之前", "前")
UNSUPPORTED_CONDITIONS = (
    ("财务／社保条件", r"财务|社保|纳税|审计报告|社保月"),
    ("仪器／设备条件", r"仪器|质谱仪|流式|冰箱|离心机|设备|型号"),
    ("排除／负向过滤条件", r"排除|不要|不含|去掉|除了|以外|剔除"),
    ("发票／照片材料条件", r"发票|照片|凭证|回单|截图"),
    ("供应商／竞品范围条件", r"供应商|乙方|甲方|竞品|分包"),
    ("方案主题检索条件", r"方案|售后|培训|应急|保密|质量控制|风险识别|项目理解|样本接收"),
    ("时间／日期条件", r"近\s*[一二三四五六七八九十\d]+\s*年|截止|不早于|签约时间|签订日期"),
)
SCOPE_LABELS = ("排除／负向过滤条件", "供应商／竞品范围条件")
PARTY_ASK = r"(?:乙方|供应商|承接方|服务方|受托方|中标人)\s*(?:是|为)\s*([^\s，,。；;、]*?)(?=\s|$|，|,|。|；|;)"
EXCLUDE_ASK = r"(?:排除|不要|去掉|剔除)\s*([^。；;]{0,40})"
EXCLUDE_TRIGGER = r"排除|不要|去掉|剔除"
OTHER_NEGATION = r"(?:不含|除了|以外)\s*([^\s，,。；;]{0,12})"
NEGATION_NEAR = r"不要|不是|不为|并非|排除|去掉|剔除|不含|除了|以外|之外|除开"
TERM_SEPARATOR = r"[或和与及、，,\s]+"
MAIN_CLAUSE_HINT = r"合同|万元|元|采购|响应文件|资料|材料|方案|发票|照片|凭证|年|月|日"
FACT_QUESTION_KINDS = (
    ("finance_amount", ("纳税社保总金额", "社保总金额", "纳税总额", "完税总额", "缴税总额", "社保金额",
                        "纳税金额", "完税金额", "社保缴费金额")),
    ("social_security_month", ("社保", "社会保障", "社会保险")),
    ("finance_period", ("财务", "审计报告", "资信")),
    ("finance_period", ("纳税", "税收", "完税")),
    ("instrument_photo", ("仪器照片", "设备照片", "照片", "实拍")),
    ("instrument", ("仪器", "设备", "测序仪")),
    ("invoice", ("发票",)), ("purchase_contract", ("采购合同",)),
    ("qualification", ("资质", "证书", "执照", "认证", "许可", "著作权")),
)
FACT_QUESTION_PERIOD = r"(?<!\d)(20\d{2}|2\d)\s*年(?:\s*(\d{1,2})\s*月)?"
SCHEME_QUESTION_WORDS = ("方案", "预案", "措施", "保密", "培训", "质量控制", "质控", "物流", "风险", "团队",
                         "服务周期", "售后", "项目管理", "对项目的理解", "需求分析", "样本接收")
MENTION_CONTEXT_WORDS = ("测序", "检测", "分析", "服务", "组学", "样本", "项目", "实验", "建库", "上机",
                         "合同", "委托")
MENTION_WINDOW = 12

# --- fixed values: draft checks -------------------------------------------------------------
CITATION = r"[(（\[【［「](E\d+)[)）\]】］」]"
BARE_CITATION = r"[`']?E\d+[`']?"
NUMBER = r"\d+(?:\.\d+)?"
REQUIREMENT_CLAUSE = (r"(?:必须|需要|要有|要|请|务必|一定)\s*(?:包含|包括|含|有|写|提供)\s*"
                      r"([^，,。；;\n]{2,20})")
REQUIREMENT_VERB = r"^(?:必须|需要|要有|要|请|务必|一定)?(?:包含|包括|含|有|写|提供)?"
REQUIREMENT_SPLIT = r"[、,，;；/]|和|与|及"
CITATION_AT_HEAD = (r"(?:^|[。；;！？\n])\s*(?:根据|依据|按照|据)\s*[(（\[【［「]E\d+[)）\]】］」]"
                    r"(?:和|与|、|及)?\s*[(（\[【［「]?E?\d*[)）\]】］」]?[，,、]?")
DOUBLED_CITATION = r"([(（\[【［「]E\d+[)）\]】］」])\s*\1"
HEADING_MARK = r"(?m)^(#{1,6})\s*(.+?)\s*$"
HEADING_SEQ = r"^[（(]?[\d一二三四五六七八九十]+[）)、.．\s]*"


@dataclass(frozen=True)
class Vendors:
    """Company names used by the path rules; always supplied by the caller."""

    ours: tuple[str, ...] = ()
    competitors: tuple[str, ...] = ()
    our_label: str | None = None
    order_prefixes: tuple[str, ...] = field(default=())

    @property
    def order_number(self) -> str:
        return rf"(?:{'|'.join(self.order_prefixes)})\d{{6,}}" if self.order_prefixes else ORDER_NUMBER
