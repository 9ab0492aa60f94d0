"""Questions about material facts: which file holds which kind of material, for which period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docketlens import rules
from docketlens.functions import text as tx
from docketlens.operators import intervals
from docketlens.session import cut_lineage


@dataclass(frozen=True)
class FactCondition:
    fact_type: str = ""
    fact_value: str = ""
    models: tuple[str, ...] = ()
    unresolved: bool = False     # an unresolved question answers nothing, never everything


def like_any(c: Column | str, words: tuple[str, ...]) -> Column:
    """Substring test that ignores ASCII case and honours % and _ inside the value."""
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(tx.col(c).ilike(f"%{w}%"), F.lit(False))
    return out


def asks_period(cond: FactCondition) -> bool:
    return bool(cond.fact_value) and cond.fact_type in rules.PERIOD_FACT_TYPES


def fact_filter(cond: FactCondition, period_types: tuple[str, ...] = rules.PERIOD_FACT_TYPES) -> Column:
    keep = F.lit(not cond.unresolved)
    if cond.fact_type:
        keep = keep & (F.col("fact_type") == cond.fact_type)
    if cond.fact_value:
        keep = keep & like_any("fact_value", (cond.fact_value,))
    if cond.models:
        keep = keep & like_any("fact_value", cond.models)
    if cond.fact_value and cond.fact_type in period_types:
        keep = keep & (F.trim(F.coalesce("fact_value", F.lit(""))) != "")
    return keep


def period_covers(query: Column | str, value: Column | str) -> Column:
    """Open and closed ranges that cover the query value; point values never do."""
    q, v = tx.strip(tx.text_or_empty(query)), tx.strip(tx.text_or_empty(value))
    low = F.substring_index(v, "~", 1)
    high = F.regexp_replace(v, r"^[^~]*~", "")
    is_range = (q != "") & F.contains(v, F.lit("~")) & (low != "")
    return F.when(is_range & v.endswith("~"), F.substring(v, F.lit(1), F.length(v) - 1) <= q).when(
        is_range, (high != "") & (low <= q) & (q <= high)).otherwise(F.lit(False))


def evidence_body(evidence: Column | str) -> Column:
    """Evidence without its ``[role]`` prefix."""
    ev = tx.text_or_empty(evidence)
    pattern = r"^\[[a-z_]+\]\s*"
    return F.when(ev.rlike(tx.rx(pattern)), tx.strip(F.regexp_replace(ev, tx.rx(pattern), ""))).otherwise(ev)


def role_scope(role: Column | str) -> Column:
    r = tx.col(role)
    return (F.when(r.isin(*rules.EVIDENCE_ROLES), "our").when(r == rules.TENDER_REQUIREMENT, "tender")
            .otherwise("other"))


def annotate_role(facts: DataFrame) -> DataFrame:
    """Role scope and label, prefix-free evidence, and the 'evidence is only the file name' flag."""
    labels = F.create_map(*[F.lit(x) for kv in rules.ROLE_SCOPE_LABELS.items() for x in kv])
    body = evidence_body("evidence_text")
    name = tx.base_name("relative_path")
    only_name = (tx.strip(body) != "") & (tx.strip(body) == tx.strip(name))
    return (facts.withColumn("file_name", name).withColumn("role_scope", role_scope("document_role"))
            .withColumn("role_label", F.element_at(labels, F.col("role_scope")))
            .withColumn("evidence_is_filename", only_name)
            .withColumn("evidence_text", F.when(only_name, "").otherwise(body)))


def is_shell(evidence: Column | str = "evidence_text", path: Column | str = "relative_path") -> Column:
    """1 when the row holds no evidence beyond its own file name."""
    ev, p = tx.text_or_empty(evidence), tx.col(path)
    marked = F.contains(ev, F.lit("] "))
    rest = F.trim(F.regexp_replace(ev, r"^(?s).*?\] ", ""))
    plain = F.trim(ev)
    return (F.when(marked & (rest != "") & p.endswith(rest), 1)
            .when(~marked & ((plain == "") | p.endswith(plain)), 1).otherwise(0))


def has_no_value() -> Column:
    return F.when(F.trim(F.coalesce("fact_value", F.lit(""))) == "", 1).otherwise(0)


def fact_order(by_type: bool = False) -> list[Column]:
    tail = (["fact_type", F.asc_nulls_first("fact_value")] if by_type else []) + ["relative_path"]
    return [is_shell(), has_no_value(), *[F.col(c) if isinstance(c, str) else c for c in tail]]


def material_facts(facts: DataFrame, documents: DataFrame, cond: FactCondition,
                   period_types: tuple[str, ...] = rules.PERIOD_FACT_TYPES) -> DataFrame:
    return facts.filter(fact_filter(cond, period_types)).join(documents, "document_id")


def first_page(rows: DataFrame, cap: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(first ``cap`` rows in order, one row with the total and the truncation flag)."""
    totals = rows.agg(F.count("*").alias("total_available")).withColumn("truncated", F.col("total_available") > cap)
    return rows.orderBy(*order).limit(cap), totals


def related_facts(facts: DataFrame, documents: DataFrame, cond: FactCondition, exact: DataFrame) -> DataFrame:
    """Range facts covering the asked month or year, minus those already answered exactly."""
    keep = F.lit(bool(cond.fact_value)) & F.contains(tx.text_or_empty("fact_value"), F.lit("~"))
    if cond.fact_type:
        keep = keep & (F.col("fact_type") == cond.fact_type)
    covering = facts.filter(keep & period_covers(F.lit(cond.fact_value), "fact_value")).join(documents, "document_id")
    seen = exact.select("relative_path", F.coalesce("evidence_text", F.lit("")).alias("_ev")).distinct()
    return (covering.withColumn("_ev", F.coalesce("evidence_text", F.lit("")))
            .join(seen, ["relative_path", "_ev"], "left_anti").drop("_ev"))


def fact_ranges(facts: DataFrame) -> DataFrame:
    """Facts with a range as value, with its bounds ``low`` and ``high`` (NULL: open); the test is that of ``period_covers``."""
    v = tx.strip(tx.text_or_empty("fact_value"))
    open_end = v.endswith("~")
    low = F.when(open_end, F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(F.substring_index(v, "~", 1))
    high = F.when(~open_end, F.regexp_replace(v, r"^[^~]*~", ""))
    return (facts.filter(F.contains(v, F.lit("~")) & (F.substring_index(v, "~", 1) != ""))
            .withColumns({"low": low, "high": high}))


def asked_periods(questions: DataFrame) -> DataFrame:
    value = tx.strip(tx.text_or_empty("period"))
    return questions.withColumn("value", value).filter("value <> ''")


def covering_facts(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """Many period questions (question_id, fact_type, period) against range facts: one row per question and fact.

    Any year and precision; the interval join runs on distinct periods and ranges.
    """
    asked, ranges = asked_periods(questions), fact_ranges(facts)
    met = intervals.stab(asked, ranges, ["fact_type"]).withColumnsRenamed({"low": "_low", "high": "_high"})
    pairs = met.join(asked.select("question_id", "fact_type", "value"), ["fact_type", "value"]).drop("value")
    same = (F.col("fact_type") == F.col("_type")) & (F.col("low") == F.col("_low")) & F.col("high").eqNullSafe(F.col("_high"))
    return ranges.join(pairs.withColumnRenamed("fact_type", "_type"), same).drop("_type", "_low", "_high", "low", "high")


def covering_counts(facts: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """(question_id, facts, first): how many range facts cover each question, and the smallest ``key`` among them.

    Facts are counted per type and value, then per type and range first, so no fact meets a question.
    """
    asked = asked_periods(questions)
    values = facts.groupBy("fact_type", "fact_value").agg(F.count("*").alias("facts"), F.min(key).alias("first"))
    # Read several times below: made once.
    ranges = cut_lineage(fact_ranges(values).groupBy("fact_type", "low", "high").agg(F.sum("facts").alias("facts"), F.min("first").alias("first")))
    sums = intervals.stab_sums(asked, ranges, ["fact_type"], "facts", "first")
    return asked.join(sums, ["fact_type", "value"]).select("question_id", F.col("n").alias("facts"), F.col("least").alias("first"))


def fold_by_file(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(one row per file: first fact, record and period counts; flat distinct periods per file)."""
    other = [c for c in rows.columns if c not in ("relative_path", order)]
    files = rows.groupBy("relative_path").agg(
        F.min_by(F.struct(*other), order).alias("first"), F.count("*").alias("record_count"))
    periods = (rows.groupBy("relative_path", "fact_value").agg(F.count("*").alias("facts"))
               .withColumn("has_period", F.coalesce(F.col("fact_value") != "", F.lit(False))))
    counts = periods.groupBy("relative_path").agg(F.count("*").alias("period_values"),
                                                  F.min("fact_value").alias("first_period"),
                                                  F.max("fact_value").alias("last_period"))
    return files.select("relative_path", "first.*", "record_count").join(counts, "relative_path"), periods


def type_counts(facts: DataFrame, documents: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Rows per fact type and role scope: overview cards and detail lists read the same table."""
    return (facts.filter(F.col("fact_type").isin(*types)).join(documents, "document_id")
            .groupBy("fact_type").agg(
                F.count("*").alias("facts"), F.count_if(role_scope("document_role") == "our").alias("our"),
                F.count_if(role_scope("document_role") == "tender").alias("tender"),
                F.count_if(role_scope("document_role") == "other").alias("other")))
