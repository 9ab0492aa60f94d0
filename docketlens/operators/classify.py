"""Role of a file from its path, as one ordered CASE expression; gates and rule classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlens import rules
from docketlens.functions import text as tx


def _folder_hits(rel: Column, names: tuple[str, ...]) -> Column:
    """Company names that equal a whole folder of the path, white space ignored, in path order."""
    folders = F.transform(F.filter(F.split(tx.parent_path(rel), "/"), lambda p: p != ""), tx.drop_space)
    if not names:
        return F.array().cast("array<string>")
    table = F.create_map(*[F.lit(x) for n in names for x in ("".join(n.split()), n)])
    return F.filter(F.transform(folders, lambda p: F.element_at(table, p)), lambda n: n.isNotNull())


def _name_hits(text: Column, names: tuple[str, ...]) -> Column:
    if not names:
        return F.array().cast("array<string>")
    low = F.lower(text)
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in names]),
                    lambda n: n.isNotNull())


def contract_by_order_number(name: Column, vendors: rules.Vendors) -> Column:
    """An order number and, in the rest of the name, an amount."""
    rest = F.regexp_replace(name, "^(.*?)" + vendors.order_number, "$1")
    return name.rlike(vendors.order_number) & rest.rlike(tx.rx(rules.PATH_AMOUNT))


def classify(rel_path: Column | str, vendors: rules.Vendors = rules.Vendors(),
             manual_override: Column | None = None) -> Column:
    """struct(role, vendor, confidence, reason, conflict) from the path inside the project."""
    clean = F.regexp_replace(F.replace(tx.text_or_empty(rel_path), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    parts = tx.let(clean, lambda r: F.struct(r.alias("rel"), tx.base_name(r).alias("name"), tx.parent_path(r).alias("parent")))
    return tx.let(parts, lambda p: _role(p, vendors, manual_override))


def _role(path: Column, vendors: rules.Vendors, manual_override: Column | None) -> Column:
    rel, name, parent = path["rel"], path["name"], path["parent"]
    low = F.lower(name)
    has = tx.contains_any_nocase
    response_name = has(name, rules.RESPONSE_HINTS + rules.PARTITION_HINTS)
    signed = has(name, rules.SIGNED_HINTS)
    partition = has(name, rules.PARTITION_HINTS)
    dir_ours, dir_comp = _folder_hits(rel, vendors.ours), _folder_hits(rel, vendors.competitors)
    name_ours, name_comp = _name_hits(name, vendors.ours), _name_hits(name, vendors.competitors)
    some = lambda a: F.size(a) > 0
    clash = (some(name_ours) & some(name_comp)) | (some(dir_comp) & (some(dir_ours) | some(name_ours))) | (some(dir_ours) & some(name_comp))
    has_response = some(dir_ours) | response_name | has(parent, rules.RESPONSE_HINTS + rules.PARTITION_HINTS)
    contract_folder = F.arrays_overlap(F.split(parent, "/"), F.array(*[F.lit(f) for f in rules.CONTRACT_FOLDERS]))
    none = F.lit(None).cast("string")
    ours = F.lit(vendors.our_label).cast("string")

    def result(role: str, confidence: float, reason: str, vendor: Column = none, conflict: bool = False) -> Column:
        return F.struct(F.lit(role).alias("role"), vendor.alias("vendor"), F.lit(confidence).alias("confidence"),
                        F.lit(reason).alias("reason"), F.lit(conflict).alias("conflict"))

    R = rules
    chain = F.when(F.coalesce(manual_override, F.lit(False)), result(R.UNKNOWN, 1.0, "manual_override")) \
        if manual_override is not None else F.when(F.lit(False), result(R.UNKNOWN, 1.0, "manual_override"))
    steps = [
        (rel == "", result(R.UNKNOWN, 0.0, "empty_path")),
        (low.isin(*R.SYSTEM_NAMES) | name.startswith("~$") | name.startswith(".~"), result(R.SYSTEM_TEMP, 1.0, "system_file")),
        (low.endswith(".db") | low.endswith(".exe"), result(R.SYSTEM_TEMP, 1.0, "system_extension")),
        (contract_by_order_number(name, vendors), result(R.CONTRACT_EVIDENCE, 0.9, "order_number_and_amount")),
        (low.startswith("dzfp"), result(R.PROCESS_MATERIAL, 0.9, "electronic_invoice")),
        (has(rel, R.RECEIPT_HINTS), result(R.PROCESS_MATERIAL, 0.9, "receipt")),
        (has(rel, R.TENDER_HINTS), result(R.TENDER_REQUIREMENT, 0.9, "tender")),
        (has(rel, R.QUALIFICATION_HINTS) & ~partition, result(R.QUALIFICATION_EVIDENCE, 0.85, "qualification")),
        (signed & ~response_name & (has(name, R.CONTRACT_NAME_HINTS) | contract_folder),
         result(R.CONTRACT_EVIDENCE, 0.9, "contract_attachment")),
        (tx.contains_any(name, R.COVER_HINTS), result(R.PROCESS_MATERIAL, 0.9, "cover")),
        (signed & has(name, R.SIGNED_AUXILIARY_HINTS), result(R.PROCESS_MATERIAL, 0.9, "signing_auxiliary")),
        (clash, result(R.UNKNOWN, 0.5, "vendor_conflict", conflict=True)),
        (some(dir_comp), result(R.COMPETITOR_RESPONSE, 0.95, "competitor_folder", F.get(dir_comp, F.lit(0)))),
        (some(name_comp), result(R.COMPETITOR_RESPONSE, 0.9, "competitor_name", F.get(name_comp, F.lit(0)))),
        (signed & has(name, R.MULTI_VENDOR_HINTS), result(R.UNKNOWN, 0.4, "pending_several_vendors")),
        (signed & (some(dir_ours) | some(name_ours)) & has_response & has(name, R.FINAL_FLAGS) & ~has(rel, R.NON_FINAL_HINTS),
         result(R.FINAL_SIGNED, 0.9, "final_response", ours)),
        (signed & ~has_response, result(R.UNKNOWN, 0.4, "pending_no_response_identity")),
        (partition, result(R.OUR_RESPONSE, 0.85, "response_part")),
        (some(dir_ours), result(R.OUR_RESPONSE, 0.9, "our_folder", ours)),
        (some(name_ours), result(R.OUR_RESPONSE, 0.85, "our_name", ours)),
        (has(name, R.RESPONSE_HINTS), result(R.OUR_RESPONSE, 0.7, "response_words")),
        (has(name, R.PROCESS_HINTS), result(R.PROCESS_MATERIAL, 0.7, "process")),
    ]
    for cond, value in steps:
        chain = chain.when(cond, value)
    return chain.otherwise(result(R.UNKNOWN, 0.0, "undecided"))


def classify_path(path: Column | str, vendors: rules.Vendors = rules.Vendors()) -> Column:
    """First segment is the project, the rest is classified; a bare name is classified as is."""
    p = F.regexp_replace(F.replace(tx.text_or_empty(path), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    inner = F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "^[^/]*/", "")).otherwise(p)
    return classify(inner, vendors)


def confirmed_by_content(content: Column | str, our_names: tuple[str, ...]) -> Column:
    """The text names one of our companies and a bidder word."""
    return tx.contains_any_nocase(content, our_names) & tx.contains_any_nocase(content, rules.BIDDER_WORDS)


def parse_eligible(role: str = "document_role", status: str = "parse_status", override: str = "manual_override") -> Column:
    """Roles whose text is extracted; a blocked status waits unless a person has decided."""
    return F.coalesce(F.col(role).isin(*rules.PARSE_ROLES), F.lit(False)) & (
        ~F.coalesce(F.col(status).isin(*rules.BLOCKED_STATUSES), F.lit(False)) | F.coalesce(F.col(override) == 1, F.lit(False)))


def clause_category(text: Column | str) -> Column:
    return tx.first_rule(text, rules.CLAUSE_CATEGORIES, rules.CLAUSE_OTHER)


def material_kind(name: Column | str, text: Column | str) -> Column:
    """File name first, body second; rule order is priority."""
    return F.coalesce(tx.first_rule(name, rules.MATERIAL_KINDS), tx.first_rule(text, rules.MATERIAL_KINDS))


def classified_line_kind(text: Column | str) -> Column:
    return tx.first_rule(text, rules.CLASSIFIED_LINE_KINDS)


def is_score_section(heading: Column | str, text: Column | str, words: tuple[str, ...] = rules.SCORE_WORDS) -> Column:
    """The heading, or at least half of the non-blank lines, state scoring rules."""
    rows = F.filter(tx.stripped_lines(text), lambda x: x != "")
    scored = F.size(F.filter(rows, lambda x: tx.contains_any(x, words)))
    return tx.contains_any(heading, words) | ((F.size(rows) > 0) & (scored * 2 >= F.size(rows)))


def recall_heading_ok(heading: Column | str) -> Column:
    """A real heading: two characters or more, not only digits and marks, not a DOI or a link."""
    h = tx.strip(tx.text_or_empty(heading))
    return (F.length(h) >= 2) & ~h.rlike(tx.rx(rules.NUMERIC_HEADING)) & ~h.rlike(rules.LINK_HEADING)


def plausible_heading(line: Column | str) -> Column:
    """Not a table row, a sentence, a long line or a certificate row."""
    s = tx.strip(tx.text_or_empty(line))
    return ((s != "") & ~s.rlike(r"[|\t]") & (F.length(s) <= rules.MAX_HEADING)
            & ~s.rlike(tx.rx(rules.SENTENCE_TAIL)) & ~(s.rlike(rules.SENTENCE_MIDDLE) & (F.length(s) > 20))
            & ~s.rlike(tx.rx(rules.CERTIFICATE_ROW)))


def project_summary(folder: Column | str) -> Column:
    return F.regexp_replace(tx.strip(tx.text_or_empty(folder)), r"^\d{8}-?", "")


def file_stem(path: Column | str, companies: tuple[str, ...] = ()) -> Column:
    """File name without extension and without company names that stand as a separate part."""
    name = F.regexp_replace(tx.base_name(tx.text_or_empty(path)), r"\.[^.]+$", "")
    sep = "+·\\-｜_（(/ "
    if companies:
        names = "|".join(f"\\Q{c}\\E" for c in sorted(companies, key=len, reverse=True))
        name = F.regexp_replace(name, f"(?:[{sep}]*(?:{names}))+$", "")
        name = F.regexp_replace(name, f"^(?:(?:{names})[{sep}]+)+", "")
        name = F.regexp_replace(name, f"[{sep}]+(?:{names})(?=[{sep}])", "")
    name = F.regexp_replace(name, f"[{sep}]+$", "")
    return tx.strip_chars(tx.strip(name), "\\-_（）()\\[\\]【】 ")


def file_purpose(path: Column | str, role: Column | str, companies: tuple[str, ...] = ()) -> Column:
    """Role label with the file stem in brackets."""
    labels = F.create_map(*[F.lit(x) for kv in rules.ROLE_LABELS.items() for x in kv])
    label = F.coalesce(F.element_at(labels, tx.text_or_empty(role)), tx.non_empty(tx.text_or_empty(role)), F.lit("待定"))
    stem = file_stem(path, companies)
    return F.when(stem == "", label).otherwise(F.concat(label, F.lit("（"), stem, F.lit("）")))


def batch_candidates(docs: DataFrame, roles: tuple[str, ...] = (), extensions: tuple[str, ...] = (), formats: tuple[str, ...] = (),
                     statuses: tuple[str, ...] = (), max_size: int | None = None, size: str = "file_size") -> DataFrame:
    """Catalog filters of a batch run: role, extension, content format, status, size. Empty means any."""
    keep = F.lit(True)
    for column, allowed in (("document_role", roles), ("content_format", formats), ("parse_status", statuses)):
        if allowed:
            keep = keep & F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    if extensions:
        tests = F.lit(False)
        for e in extensions:
            tests = tests | F.lower("relative_path").endswith(e)
        keep = keep & tests
    if max_size is not None:
        keep = keep & F.coalesce(F.col(size) < max_size, F.lit(False))
    return docs.filter(keep)


AUDIT_HINTS = rules.SIGNED_HINTS


def signature_audit(inventory: DataFrame, catalog: DataFrame, vendors: rules.Vendors = rules.Vendors()) -> DataFrame:
    """Every signature candidate with its status; ``side`` shows paths missing on either side.

    Candidates: a trigger word in the name, registered as final, or classified as final now.
    """
    keys = ["source_root_id", "relative_path"]
    inv = inventory.select(*keys).distinct().withColumn("_inv", F.lit(True))
    reg = catalog.select(*keys, "document_role", "manual_override").withColumn("_reg", F.lit(True))
    both = inv.join(reg, keys, "full_outer")
    got = classify_path("relative_path", vendors)
    trigger = tx.contains_any(tx.base_name("relative_path"), AUDIT_HINTS)
    was_final = F.coalesce(F.col("document_role") == rules.FINAL_SIGNED, F.lit(False))
    status = (F.when(F.coalesce(F.col("manual_override") == 1, F.lit(False)), "manual_override_requires_separate_review")
              .when(F.col("auto_role") == rules.FINAL_SIGNED, "rule_eligible_pending_review")
              .when(F.col("auto_role") == rules.UNKNOWN, "pending_review")
              .when(F.col("auto_role") == rules.OUR_RESPONSE, "response_final_status_unconfirmed")
              .otherwise(F.concat(F.lit("excluded_"), "auto_role")))
    side = F.when(F.col("_inv").isNull(), "only_catalog").when(F.col("_reg").isNull(), "only_inventory").otherwise("both")
    return (both.withColumn("auto_role", got["role"]).withColumn("side", side)
            .withColumn("candidate", trigger | was_final | (F.col("auto_role") == rules.FINAL_SIGNED))
            .withColumn("audit_status", F.when(F.col("candidate"), status))
            .withColumn("sibling_pdf", F.regexp_replace("relative_path", r"(?i)_\d+\.(?:jpg|jpeg|png)$", ".pdf"))
            .drop("_inv", "_reg"))


def with_sibling_flag(audit: DataFrame) -> DataFrame:
    """Marks page images whose whole PDF is in the same inventory."""
    pdfs = audit.select(F.col("source_root_id"), F.col("relative_path").alias("sibling_pdf"), F.lit(True).alias("_has"))
    own = F.col("sibling_pdf") != F.col("relative_path")
    return (audit.join(pdfs, ["source_root_id", "sibling_pdf"], "left")
            .withColumn("has_sibling_pdf", own & F.coalesce("_has", F.lit(False))).drop("_has"))
