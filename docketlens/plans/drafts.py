"""Checks over a table of drafts; problems are reported, texts are never rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlens import rules
from docketlens.functions import text as tx


def citations(draft: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(tx.text_or_empty(draft), F.lit(tx.rx(rules.CITATION)), F.lit(1)))


def citation_problems(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft_id, problem, detail): citations that do not exist, and drafts that cite nothing.

    ``evidence`` holds (draft_id, ref). A draft without any available reference is not blamed.
    """
    used = drafts.select("draft_id", F.explode(citations("draft")).alias("ref"))
    fake = used.join(evidence.select("draft_id", "ref").distinct(), ["draft_id", "ref"], "left_anti")
    none = (drafts.filter(F.size(citations("draft")) == 0).select("draft_id")
            .join(evidence.select("draft_id").distinct(), "draft_id", "left_semi"))
    return fake.select("draft_id", F.lit("unknown_citation").alias("problem"), F.col("ref").alias("detail")).unionByName(
        none.select("draft_id", F.lit("no_citation").alias("problem"), F.lit("").alias("detail")))


def prose_numbers(draft: Column | str) -> Column:
    """Numbers of two characters or more, citations left out."""
    t = F.regexp_replace(tx.text_or_empty(draft), tx.rx(rules.CITATION), " ")
    t = F.regexp_replace(t, rules.BARE_CITATION, " ")
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(tx.rx(rules.NUMBER)), F.lit(0)))
    return F.filter(found, lambda n: F.length(n) >= 2)


def untraceable_numbers(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Numbers of a draft found in none of its evidence texts, nor in its constraints.

    ``evidence`` holds (draft_id, evidence_text), the text with its file name and heading.
    """
    every = lambda c: F.regexp_extract_all(tx.text_or_empty(c), F.lit(tx.rx(rules.NUMBER)), F.lit(0))
    known = (evidence.select("draft_id", F.explode(F.array_distinct(every("evidence_text"))).alias("number"))
             .unionByName(drafts.select("draft_id", F.explode(every("constraints")).alias("number"))).distinct())
    said = drafts.select("draft_id", F.explode(prose_numbers("draft")).alias("number"))
    return said.join(known, ["draft_id", "number"], "left_anti")


def missing_modules(drafts: DataFrame, required: DataFrame, labels: dict[str, tuple[str, ...]]) -> DataFrame:
    """Required modules none of whose labels (name, keywords) or of the draft's own terms appears.

    ``required`` holds (draft_id, module). Terms of the constraints count unless they name a module.
    """
    pieces = F.split(tx.text_or_empty("constraints"), tx.rx(r"[、，,和与及\s]+"))
    bare = F.transform(pieces, lambda t: F.regexp_replace(t, rules.REQUIREMENT_VERB, ""))
    own = F.filter(F.concat(pieces, bare), lambda t: (F.length(t) >= 2) & ~t.isin(*labels))
    d = drafts.select("draft_id", "draft", F.exists(own, lambda t: F.contains(F.col("draft"), t)).alias("_own"),
                      F.filter(F.array(*[F.when(tx.contains_any("draft", (m, *words)), F.lit(m)) for m, words in labels.items()]),
                               lambda m: m.isNotNull()).alias("_found"))
    return (required.join(d, "draft_id").filter(~F.col("_own") & ~F.array_contains("_found", F.col("module")))
            .select("draft_id", "module"))


def _bare(c: Column) -> Column:
    return F.regexp_replace(tx.strip(c), tx.rx(rules.HEADING_SEQ), "")


def headings(draft: Column | str, level: int) -> Column:
    body = tx.text_or_empty(draft)
    marks = lambda g: F.regexp_extract_all(body, F.lit(tx.rx(rules.HEADING_MARK)), F.lit(g))
    pairs = F.zip_with(marks(1), marks(2), lambda m, t: F.struct(F.length(m).alias("level"), t.alias("title")))
    return F.transform(F.filter(pairs, lambda p: p["level"] == level), lambda p: p["title"])


def outline_drift(drafts: DataFrame) -> DataFrame:
    """(draft_id, problem, detail) against the outline columns ``title`` and ``sections``.

    Numbering before a title is ignored, and a longer title that contains the asked one counts.
    """
    d = drafts.withColumn("_h1", headings("draft", 1)).withColumn("_h2", headings("draft", 2))
    same = lambda got, want: (_bare(got) == _bare(want)) | F.contains(_bare(got), _bare(want))
    title = tx.strip(tx.text_or_empty("title"))
    wrong = ((title != "") & ~F.exists("_h1", lambda h: same(h, title)))
    title_problem = d.filter(wrong).select("draft_id", F.when(F.size("_h1") == 0, "missing_title").otherwise("wrong_title").alias("problem"),
                                           title.alias("detail"))
    missing = F.filter("sections", lambda s: (s != "") & ~F.exists("_h2", lambda h: same(h, s)))
    extra = F.filter("_h2", lambda h: (F.size("sections") > 0) & ~F.exists("sections", lambda s: same(h, s)))
    rows = lambda arr, p: d.select("draft_id", F.lit(p).alias("problem"), F.explode(arr).alias("detail"))
    return title_problem.unionByName(rows(missing, "missing_section")).unionByName(rows(extra, "extra_section"))


def style_counts(drafts: DataFrame) -> DataFrame:
    """Sentence-head citations and doubled citations per draft, with the report flag."""
    body = tx.text_or_empty("draft")
    head = F.regexp_count(body, F.lit(tx.rx(rules.CITATION_AT_HEAD)))
    return drafts.select("draft_id", head.alias("head_citations"), (head >= 3).alias("reads_like_a_log"),
                         F.regexp_count(body, F.lit(tx.rx(rules.DOUBLED_CITATION))).alias("doubled_citations"))


def required_modules(requests: DataFrame, labels: dict[str, tuple[str, ...]], text: str = "request") -> DataFrame:
    """Modules named by a request, by name or keyword, in dictionary order."""
    found = F.filter(F.array(*[F.when(tx.contains_any(text, (m, *words)), F.struct(F.lit(i).alias("module_pos"), F.lit(m).alias("module")))
                               for i, (m, words) in enumerate(labels.items())]), lambda m: m.isNotNull())
    return requests.select("request_id", F.inline(found))


def requested_parts(text: Column | str) -> Column:
    """Items of the 'must contain ...' clauses, split, without their verbs, each once."""
    clauses = F.regexp_extract_all(tx.text_or_empty(text), F.lit(tx.rx(rules.REQUIREMENT_CLAUSE)), F.lit(1))
    parts = F.flatten(F.transform(clauses, lambda c: F.split(c, rules.REQUIREMENT_SPLIT)))
    clean = F.transform(parts, lambda p: tx.strip_chars(F.regexp_replace(tx.strip(p), rules.REQUIREMENT_VERB, ""), " 　:：,，、。；;"))
    return F.array_distinct(F.filter(clean, lambda p: F.length(p) >= 2))


def plan_outline(requests: DataFrame, labels: dict[str, tuple[str, ...]], max_sections: int = 6, text: str = "request") -> DataFrame:
    """(request_id, title, title_module, sections, dropped) read from each request.

    The title is the module named earliest, in the requester's own longer wording. Items without
    a module of their own belong to the title's module and are marked as inferred.
    """
    body = tx.text_or_empty(text)
    spots = []
    for i, (m, words) in enumerate(labels.items()):
        first = None
        for term in (m, *words):
            at = tx.find(body, term)
            hit = F.when(at >= 0, F.struct(at.alias("at"), F.lit(i).alias("o"), F.lit(m).alias("module"), F.lit(len(term)).alias("n")))
            first = hit if first is None else F.coalesce(first, hit)
        spots.append(first)
    best = F.array_min(F.filter(F.array(*spots), lambda x: x.isNotNull()))
    longer = F.regexp_extract(F.substring(body, best["at"] + best["n"] + 1, F.length(body)),
                              tx.rx(r"^[[\p{L}\p{N}（）()·]&&[^和与及]]*"), 0)
    title = tx.strip(F.concat(F.substring(body, best["at"] + 1, best["n"]), longer))

    def owner(name: Column) -> Column:
        exact = F.coalesce(*[F.when(name.isin(m, *words), m) for m, words in labels.items()])
        return F.coalesce(exact, *[F.when(tx.contains_any(name, (m, *words)), m) for m, words in labels.items()])

    d = requests.withColumn("_best", best).withColumn("title", F.coalesce(title, F.lit(""))).withColumn("title_module", F.col("_best.module"))
    outside = F.filter(F.array(*[F.when(F.contains(body, F.lit(m)) & ~F.coalesce(F.col("title_module") == m, F.lit(False)), F.lit(m)) for m in labels]),
                       lambda m: m.isNotNull())
    names = F.filter(F.array_distinct(F.concat(requested_parts(text), outside)), lambda n: n != F.col("title"))
    sections = F.filter(F.transform(names, lambda n: F.struct(
        n.alias("name"), F.coalesce(owner(n), F.col("title_module")).alias("module"), owner(n).isNull().alias("module_inferred"))),
        lambda s: s["module"].isNotNull())
    d = d.withColumn("sections", F.slice(sections, 1, max_sections))
    got = F.concat(F.transform("sections", lambda s: s["name"]), F.array("title"))
    dropped = F.filter(requested_parts(text), lambda p: ~F.exists(got, lambda g: (g != "") & (F.contains(g, p) | F.contains(p, g))))
    return d.withColumn("dropped", dropped).drop("_best")
