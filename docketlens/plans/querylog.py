"""A table of questions turned into a table of conditions; what cannot be read is refused, not dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlens import rules
from docketlens.functions import text as tx
from docketlens.operators import matching

Products = dict[str, tuple[str, ...]]


def product_tag(text: Column | str, products: Products) -> Column:
    """First dictionary entry with an alias in the part before any exclusion (narrow before broad)."""
    return tx.first_rule(wanted_part(text), products.items(), nocase=True)


def wanted_part(text: Column | str) -> Column:
    """The part of a question before any exclusion."""
    return F.get(F.split(tx.text_or_empty(text), rules.EXCLUDE_TRIGGER, 2), F.lit(0))


def tagged(questions: DataFrame, dictionary: DataFrame, text: str = "question", out: str = "product") -> DataFrame:
    """Questions with the product of the first dictionary row (product, alias, priority) whose alias the wanted part contains.

    Case is ignored. The dictionary is a table of any size; distinct questions meet its aliases by their rarest piece.
    """
    wanted = F.lower(wanted_part(text))
    aliases = dictionary.select("product", "priority", F.lower("alias").alias("keyword"))
    hits = matching.keyword_hits(questions.select(wanted.alias("text")), aliases.select("keyword"))
    first = hits.join(aliases, "keyword").groupBy("text").agg(F.min(F.struct("priority", "product")).alias("p"))
    first = first.select(F.col("text").alias("_wanted"), F.col("p.product").alias(out))
    return questions.drop(out).withColumn("_w", wanted).join(first, F.col("_w") == F.col("_wanted"), "left").drop("_w", "_wanted")


def saved_conditions(read: DataFrame, dictionary: DataFrame, key: str = "question_id") -> DataFrame:
    """The condition rows (as ``saved.CONDITION``) of the questions that were read: a product's aliases are its keywords."""
    words = dictionary.groupBy("product").agg(F.collect_set("alias").alias("keywords"))
    none = F.array().cast("array<string>")
    return read.filter("reject_reason IS NULL").join(words, "product").select(
        F.col(key).cast("string").alias("query_id"), "keywords", "min_amount", "date_from", "date_to", "party_include", "party_exclude", "product_exclude",
        none.alias("match_exclude"))


def min_amount(text: Column | str) -> Column:
    """Amount in yuan; NULL when none is written."""
    t = tx.text_or_empty(text)
    value = F.regexp_extract(t, tx.rx(rules.QUERY_AMOUNT), 1).try_cast("double")
    return value * F.when(F.regexp_extract(t, tx.rx(rules.QUERY_AMOUNT), 2).isin("万", "万元"), 10000.0).otherwise(1.0)


def asks_at_most(text: Column | str) -> Column:
    return tx.contains_any(text, rules.AT_MOST_WORDS)


def date_bounds(text: Column | str, low: int = rules.YEAR_MIN, high: int = rules.YEAR_MAX) -> Column:
    """struct(date_from, date_to): the first date, bounded by the word within six characters after it."""
    t = tx.text_or_empty(text)
    y, m, d = (F.regexp_extract(t, tx.rx(rules.QUERY_DATE), i) for i in (1, 2, 3))
    month = F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))
    stamp = F.when(d != "", F.concat(month, F.lit("-"), F.lpad(d, 2, "0"))).otherwise(month)
    valid = y.try_cast("int").between(low, high) & m.try_cast("int").between(1, 12)
    tail = F.substring(F.regexp_extract(t, tx.rx(rules.QUERY_DATE) + r"([\s\S]{0,6})", 4), 1, 6)
    after, before = tx.contains_any(tail, rules.AFTER_WORDS), tx.contains_any(tail, rules.BEFORE_WORDS)
    return F.struct(F.when(valid & after, stamp).alias("date_from"), F.when(valid & ~after & before, stamp).alias("date_to"))


def fact_question(text: Column | str) -> Column:
    """struct(fact_type, period); two-digit years belong to this century."""
    t = tx.strip(tx.text_or_empty(text))
    y, m = (F.regexp_extract(t, tx.rx(rules.FACT_QUESTION_PERIOD), i) for i in (1, 2))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    period = F.when(y == "", "").when(m == "", year).otherwise(F.concat(year, F.lit("-"), F.lpad(m, 2, "0")))
    return F.struct(tx.first_rule(t, rules.FACT_QUESTION_KINDS, "").alias("fact_type"), period.alias("period"))


def unsupported_label(text: Column | str, labels=rules.UNSUPPORTED_CONDITIONS) -> Column:
    t, out = tx.text_or_empty(text), None
    for label, pattern in labels:
        hit = t.rlike(tx.rx(pattern))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def org_key(term: Column, orgs: tuple[str, ...]) -> Column:
    """Shortest known company contained in the term."""
    out = None
    for o in sorted(orgs, key=len):
        out = F.when(F.contains(term, F.lit(o)), o) if out is None else out.when(F.contains(term, F.lit(o)), o)
    return out if out is not None else F.lit(None).cast("string")


def product_term(term: Column, products: Products) -> Column:
    """Product a single term stands for: its name, an alias, or an alias with at most six more characters."""
    out = None
    for name, aliases in products.items():
        hit = term.isin(name, *aliases)
        for a in aliases:
            hit = hit | (F.contains(term, F.lit(a)) & (F.length(term) - len(a) <= 6))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out if out is not None else F.lit(None).cast("string")


def _starts_known(term: Column, products: Products, orgs: tuple[str, ...]) -> Column:
    hit = tx.contains_any(term, orgs)
    for name, aliases in products.items():
        hit = hit | term.startswith(name)
        for a in aliases:
            hit = hit | tx.find(term, a).between(0, 6)
    return hit


def _terms(clause: Column) -> Column:
    return F.filter(F.transform(F.split(clause, tx.rx(rules.TERM_SEPARATOR)), tx.strip), lambda t: t != "")


def scope_conditions(text: Column | str, products: Products, orgs: tuple[str, ...]) -> Column:
    """struct(include, exclude_orgs, exclude_products, unresolved) of company and product limits."""
    t = tx.text_or_empty(text)
    every = lambda p: F.regexp_extract_all(t, F.lit(tx.rx(p)), F.lit(1))
    present = lambda a: F.filter(a, lambda x: x.isNotNull())

    asked = F.flatten(F.transform(every(rules.PARTY_ASK), _terms))
    asked_orgs = present(F.transform(asked, lambda x: org_key(x, orgs)))
    asked_bad = F.filter(asked, lambda x: org_key(x, orgs).isNull())

    def judged(x: Column) -> Column:
        o = org_key(x, orgs)
        p = product_term(x, products)
        main = o.isNull() & p.isNull() & x.rlike(tx.rx(rules.MAIN_CLAUSE_HINT)) & ~_starts_known(x, products, orgs)
        return F.struct(x.alias("term"), o.alias("org"), F.when(o.isNull(), p).alias("product"), main.alias("stop"))

    def up_to_main_clause(clause: Column) -> Column:
        rows = F.transform(_terms(clause), judged)
        stop = F.array_position(F.transform(rows, lambda r: r["stop"]), True).cast("int")
        return F.when(stop > 0, F.slice(rows, F.lit(1), stop - 1)).otherwise(rows)

    out = F.flatten(F.transform(every(rules.EXCLUDE_ASK), up_to_main_clause))
    other = F.filter(F.flatten(F.transform(every(rules.OTHER_NEGATION), _terms)),
                     lambda x: org_key(x, orgs).isNotNull() | product_term(x, products).isNotNull())

    spans = tx.matches(t, rules.EXCLUDE_ASK)

    def plain(org: str) -> Column:
        def outside(pos: Column) -> Column:
            near = F.concat(tx.sub(t, F.greatest(pos - 8, F.lit(0)), pos), F.lit("\n"), tx.sub(t, pos + len(org), pos + len(org) + 8))
            return ~near.rlike(tx.rx(rules.NEGATION_NEAR)) & ~F.exists(spans, lambda s: (s["start"] <= pos) & (pos < s["end"]))

        return F.when(F.exists(tx.starts_of(t, org), outside), F.lit(org))

    bare = present(F.array(*[plain(o) for o in sorted(orgs)])) if orgs else F.array().cast("array<string>")
    bare = F.filter(bare, lambda n: ~F.exists(bare, lambda o: (o != n) & F.contains(n, o)))
    return F.struct(
        F.array_distinct(F.concat(asked_orgs, bare)).alias("include"),
        F.array_distinct(present(F.transform(out, lambda r: r["org"]))).alias("exclude_orgs"),
        F.array_distinct(present(F.transform(out, lambda r: r["product"]))).alias("exclude_products"),
        F.array_distinct(F.concat(asked_bad, F.transform(F.filter(out, lambda r: r["org"].isNull() & r["product"].isNull()), lambda r: r["term"]),
                                  other)).alias("unresolved"))


def conditions(questions: DataFrame, products: Products, orgs: tuple[str, ...] = (), text: str = "question", product: Column | None = None,
               low: int = rules.YEAR_MIN, high: int = rules.YEAR_MAX) -> DataFrame:
    """One row per question: product, minimum, dates, scope, or ``reject_reason``.

    ``product``: the product found elsewhere (see ``tagged``); by default it is looked up in ``products``.
    """
    t = tx.strip(tx.text_or_empty(text))
    d = (questions.withColumn("_d", date_bounds(t, low, high)).withColumn("_label", unsupported_label(t))
         .withColumn("_other", unsupported_label(t, [x for x in rules.UNSUPPORTED_CONDITIONS if x[0] not in rules.SCOPE_LABELS]))
         .withColumn("_s", scope_conditions(t, products, orgs)).withColumn("product", product_tag(t, products) if product is None else product)
         .withColumn("_amount", min_amount(t)))
    scoped = F.col("_label").isin(*rules.SCOPE_LABELS)
    some = lambda f: F.size(f"_s.{f}") > 0
    has_date = F.col("_d.date_from").isNotNull() | F.col("_d.date_to").isNotNull()
    narrowed = scoped & (some("include") | some("exclude_orgs"))
    reason = (
        F.when(t == "", "empty")
        .when(t.rlike(tx.rx(rules.QUERY_DATE)) & ~has_date, "date_without_direction")
        .when(scoped & some("unresolved"), F.concat(F.lit("unresolved:"), F.array_join("_s.unresolved", "、")))
        .when(scoped & ~some("include") & ~some("exclude_orgs") & ~some("exclude_products"), F.concat(F.lit("scope_without_object:"), "_label"))
        .when(scoped & F.col("_other").isNotNull(), F.concat(F.lit("unsupported:"), "_other"))
        .when(~scoped & F.col("_label").isNotNull(), F.concat(F.lit("unsupported:"), "_label"))
        .when(asks_at_most(t), "at_most").when(F.col("_amount").isNull() & ~has_date & ~narrowed, "no_minimum")
        .when(F.col("product").isNull(), "no_product"))
    return (d.withColumn("reject_reason", reason).withColumn("min_amount", F.coalesce("_amount", F.lit(0.0)))
            .withColumn("date_from", F.col("_d.date_from")).withColumn("date_to", F.col("_d.date_to"))
            .withColumn("party_include", F.col("_s.include")).withColumn("party_exclude", F.col("_s.exclude_orgs"))
            .withColumn("product_exclude", F.col("_s.exclude_products")).drop("_d", "_label", "_other", "_s", "_amount"))


def intent(rows: DataFrame, text: str = "question", instrument: str = "instrument_hit") -> DataFrame:
    """instrument, material, scheme or contract; a contract question is decided only when it was read."""
    facts = tuple(w for _, words in rules.FACT_QUESTION_KINDS for w in words)
    kind = (F.when(F.col(instrument), "instrument").when(tx.contains_any(text, facts), "material")
            .when(tx.contains_any(text, rules.SCHEME_QUESTION_WORDS), "scheme").otherwise("contract"))
    return rows.withColumn("intent", kind).withColumn("decided", (kind != "contract") | F.col("reject_reason").isNull())


def instrument_models(questions: DataFrame, stored: DataFrame, aliases: Products, text: str = "question") -> DataFrame:
    """(question_id, model): a common name's models, else stored names that contain a query fragment.

    Fragments have four characters or more. A fragment is part of a name only if its first four
    characters are one of the name's four-character pieces, so the containment test runs on an
    equi-join of pieces instead of on all pairs.
    """
    chain = None
    for name, models in aliases.items():
        hit = F.contains(tx.text_or_empty(text), F.lit(name))
        value = F.array(*[F.lit(m) for m in models])
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    q = questions.withColumn("_models", chain if chain is not None else F.lit(None).cast("array<string>"))
    by_alias = q.filter("_models IS NOT NULL").select("question_id", F.explode("_models").alias("model"))
    pieces = F.filter(F.split(tx.strip(tx.text_or_empty(text)), tx.rx(r"[\s \-_]+")), lambda p: F.length(p) >= 4)
    frags = q.filter("_models IS NULL").select("question_id", F.explode(F.array_distinct(pieces)).alias("fragment"))
    vocabulary = frags.select("fragment").distinct().withColumn("gram", tx.left("fragment", 4))
    names = stored.select("model").distinct().withColumn("_norm", tx.drop_space("model"))
    grams = names.filter(F.length("_norm") >= 4).select("model", "_norm", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("_norm") - 3), lambda i: F.substring("_norm", i, F.lit(4))))).alias("gram"))
    found = vocabulary.join(grams, "gram").filter(F.contains("_norm", F.col("fragment"))).select("fragment", "model")
    by_part = frags.join(found, "fragment").select("question_id", "model").distinct()
    return by_alias.unionByName(by_part)
