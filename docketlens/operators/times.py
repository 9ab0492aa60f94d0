"""Time commitments in text and marked tender requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlens import rules
from docketlens.functions import text as tx

DELIMITERS = r"。；;\n"


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def time_mentions(text: Column | str) -> Column:
    """array<struct<raw, start, end, minutes>>; round-the-clock and calendar dates are left out."""
    body = tx.text_or_empty(text)

    def valid(m: Column, unit: Column, date_units: tuple[str, ...]) -> Column:
        before = tx.sub(body, F.greatest(m["start"] - 6, F.lit(0)), m["start"])
        clock = (m["start"] > 0) & F.coalesce(F.right(before, F.lit(1)).isin(*rules.ROUND_THE_CLOCK), F.lit(False))
        date = unit.isin(*date_units) & before.rlike(tx.rx(r"\d{1,2}\s*月\s*$"))
        return ~clock & ~date

    def found(pattern: str, value, date_units: tuple[str, ...]) -> Column:
        part = lambda m, i: F.regexp_extract(m["raw"], tx.rx(pattern), i)
        kept = F.filter(tx.matches(body, pattern), lambda m: valid(m, part(m, 2), date_units))
        return F.transform(kept, lambda m: F.struct(
            m["raw"].alias("raw"), m["start"].alias("start"), m["end"].alias("end"),
            (value(part(m, 1)) * _lookup({k: float(v) for k, v in rules.UNIT_MINUTES.items()}, part(m, 2))).alias("minutes")))

    # The look-ahead behind h/H cannot be seen once a match stands alone, so re-extraction drops it.
    number = rules.NUMBER_UNIT.replace("(?![A-Za-z])", "")
    digits = F.filter(tx.matches(body, rules.NUMBER_UNIT), lambda m: valid(m, F.regexp_extract(m["raw"], tx.rx(number), 2), ("日",)))
    arabic = F.transform(digits, lambda m: F.struct(
        m["raw"].alias("raw"), m["start"].alias("start"), m["end"].alias("end"),
        (F.regexp_extract(m["raw"], tx.rx(number), 1).try_cast("double")
         * _lookup({k: float(v) for k, v in rules.UNIT_MINUTES.items()}, F.regexp_extract(m["raw"], tx.rx(number), 2))).alias("minutes")))
    return F.concat(arabic, found(rules.CHINESE_TIME, lambda d: _lookup(rules.CHINESE_DIGITS, d), ("日", "月")))


def _slot_pattern(slots: list[str], first_only: bool) -> str:
    """Slot words that are not followed by a word that makes them something else.

    ``first_only`` accepts just the first occurrence of each word in the searched piece.
    """
    parts = []
    for s in slots:
        block = rules.SLOT_BLOCK_AFTER.get(s)
        behind = f"(?<!{s}[\\s\\S]{{0,{rules.AFTER_LOOKAHEAD}}})" if first_only else ""
        parts.append(f"{behind}{s}" + (f"(?!{'|'.join(block)})" if block else ""))
    return "|".join(parts)


def slot_of(text: Column, start: Column, end: Column) -> Column:
    """What a time mention governs: the action right after it, else the nearest slot word.

    Distances tie in favour of the word behind the mention; a following action that is no slot
    ends the search; words such as "response document" are not services.
    """
    ahead = tx.sub(text, end, end + rules.AFTER_LOOKAHEAD)
    next_slot = tx.rx_group(ahead, _slot_pattern(list(rules.TIME_SLOTS), True), 0)

    order = {s: i for i, s in enumerate(rules.TIME_SLOTS)}
    lo = F.greatest(start - rules.SLOT_WINDOW, F.lit(0))
    # The two characters behind a word decide whether it is blocked, so the window carries two more.
    window = tx.sub(text, lo, end + rules.SLOT_WINDOW + 2)
    # Two passes, because the last word of one slot may begin another.
    late = "保修"
    early = _slot_pattern([s for s in rules.TIME_SLOTS if s != late], False)
    spots = F.filter(F.concat(tx.matches(window, early), tx.matches(window, late)),
                     lambda m: lo + m["end"] <= end + rules.SLOT_WINDOW)

    def scored(m: Column) -> Column:
        a, b = lo + m["start"], lo + m["end"]
        d = F.when(b <= start, (start - b).cast("double")).when(a >= end, (a - end) - F.lit(0.5)).otherwise(F.lit(-0.5))
        return F.struct(d.alias("d"), _lookup(order, m["raw"]).alias("o"), m["start"].alias("at"), m["raw"].alias("slot"))

    nearest = F.array_min(F.transform(spots, scored))["slot"]
    action = ahead.rlike("|".join(rules.NON_SLOT_ACTIONS))
    chosen = tx.let(next_slot, lambda s: F.when(s.isNotNull(), s).when(~action, nearest))
    return tx.let(chosen, lambda s: F.coalesce(_lookup(rules.SLOT_ALIAS, s), s))


def clause_of(text: Column, start: Column, end: Column, width: int = rules.CLAUSE_WIDTH) -> Column:
    """The clause around a mention: to the nearest delimiter on either side, within ``width``."""
    before = F.regexp_extract(tx.sub(text, F.greatest(start - width, F.lit(0)), start), f"[^{DELIMITERS}]*$", 0)
    behind = F.regexp_extract(tx.sub(text, end, end + width), f"^[^{DELIMITERS}]*", 0)
    return tx.squeeze_space(F.concat(before, tx.sub(text, start, end), behind))


def context_of(text: Column, start: Column, end: Column, width: int = rules.CONTEXT_WIDTH) -> Column:
    return tx.squeeze_space(tx.sub(text, F.greatest(start - width, F.lit(0)), end + width))


def commitments(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per time mention that has a slot: (slot, minutes, value, clause, context, position)."""
    hint = "[0-9０-９一两二三四五六七八九十半]"
    df = docs.filter(F.col(text).rlike(hint)).select(*keys, F.col(text).alias("_t")).withColumn("_m", time_mentions("_t"))
    # Rows carry the surroundings of a mention, never the text.
    df = df.withColumn("_m", F.transform("_m", lambda m: F.struct(
        m["raw"].alias("raw"), m["minutes"].alias("minutes"), m["start"].alias("start"),
        tx.sub("_t", F.greatest(m["start"] - rules.CLAUSE_WIDTH, F.lit(0)), m["start"]).alias("_before"),
        tx.sub("_t", m["end"], m["end"] + rules.CLAUSE_WIDTH).alias("_behind"))))
    rows = tx.unfold(df, "_m", keys).withColumn("_near", F.concat("_before", "raw", "_behind"))
    rows = rows.withColumn("_a", F.length("_before")).withColumn("_b", F.col("_a") + F.length("raw"))
    t, a, b = F.col("_near"), F.col("_a"), F.col("_b")
    return (rows.withColumn("slot", slot_of(t, a, b))
            .withColumn("value", F.replace("raw", F.lit(" "), F.lit(""))).withColumn("clause", clause_of(t, a, b))
            .withColumn("context", context_of(t, a, b)).filter("slot IS NOT NULL AND minutes IS NOT NULL")
            .select(*keys, "slot", "minutes", "value", "clause", "context", F.col("start").alias("position")))


def time_requirements(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Distinct (slot, minutes) per document, first mention kept, with clause and mandatory flag.

    All are returned, numbered per document; ``total`` carries the count for lists that show only the first.
    """
    from pyspark.sql import Window

    found = commitments(docs, keys, text).withColumn("whole_minutes", F.floor("minutes").cast("long"))
    one = found.groupBy(*keys, "slot", "whole_minutes").agg(
        F.min_by(F.struct("value", "clause"), "position").alias("m"), F.min("position").alias("position"))
    w = Window.partitionBy(*keys)
    ranked = (one.withColumn("found_no", F.row_number().over(w.orderBy("position")))
              .withColumn("total", F.count("*").over(w)))
    return ranked.select(*keys, "slot", F.col("whole_minutes").alias("minutes"), "m.value", "m.clause",
                         tx.contains_any("m.clause", rules.MANDATORY_WORDS).alias("mandatory"), "found_no", "total")


def requirement_order() -> list[Column]:
    return [F.when(F.col("mandatory"), 0).otherwise(1), F.col("minutes")]


def hard_requirements(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Clauses marked as mandatory: table form, or section form with the text from the next lines."""
    from docketlens.operators import classify

    marked = lambda s: s.rlike("[★▲]")

    def parse(s: Column, i: Column) -> Column:
        in_table = s.rlike(tx.rx(rules.MARKED_TABLE_ROW))
        cell = lambda g: tx.strip(F.regexp_extract(s, tx.rx(rules.MARKED_TABLE_ROW), g))
        raw = tx.strip(F.regexp_extract(s, tx.rx(rules.MARKED_SECTION), 1))

        def body() -> Column:
            def before_stop(following: Column) -> Column:
                stop = F.array_position(F.transform(following, lambda n: (n == "") | marked(n)), True).cast("int")
                return tx.let(stop, lambda at: F.when(at > 0, F.slice(following, F.lit(1), at - 1)).otherwise(following))

            return tx.left(F.array_join(tx.let(F.slice("_l", i + 2, 5), before_stop), " "), 160)

        # Values used more than once are bound: inside a lambda nothing is shared.
        section = lambda x: F.when(x["name"] != "", F.struct(F.lit("").alias("seq"), tx.strip(x["name"]).alias("name"), tx.strip(
            F.substring(x["raw"], F.length(x["name"]) + 2, F.length(x["raw"]))).alias("value"))).otherwise(
            F.struct(F.lit("").alias("seq"), x["raw"].alias("name"), body().alias("value")))
        cut = tx.let(tx.let(raw, lambda r: F.struct(r.alias("raw"), F.regexp_extract(r, r"^([^：:，,。；;]+)[：:，,。；;]", 1).alias("name"))), section)
        return F.when(marked(s), F.when(in_table, F.struct(cell(1).alias("seq"), cell(2).alias("name"), cell(3).alias("value"))).when(
            s.rlike(tx.rx(rules.MARKED_SECTION)), cut))

    df = docs.filter(marked(F.col(text))).select(*keys, F.transform(tx.lines(text), tx.squeeze_space).alias("_l"))
    df = df.withColumn("_r", F.filter(F.transform("_l", parse), lambda r: r.isNotNull() & (F.length(r["name"]) >= 2)))
    df = df.withColumn("_r", tx.keep_first(F.col("_r"), lambda r: tx.left(tx.drop_space(F.concat(r["name"], r["value"])), 40)))
    df = df.withColumn("total", F.size("_r")).withColumn("_r", F.transform("_r", lambda r, i: F.struct(
        (i + 1).alias("item_no"), r["seq"].alias("seq"), tx.left(r["name"], 40).alias("name"),
        tx.left(F.coalesce(tx.non_empty(r["value"]), r["name"]), 160).alias("clause_text"), F.concat(r["name"], F.lit(" "), r["value"]).alias("_all"))))
    return (tx.unfold(df, "_r", [*keys, "total"]).withColumn("category", classify.clause_category("_all"))
            .withColumn("severity", F.lit("hard")).drop("_all"))
