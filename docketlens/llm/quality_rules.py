"""Line-first cleaning, as column expressions only.

Every line of a text is judged on its own by three rules: punctuation, navigation and boilerplate.
Lines that fail are taken out; a document that loses too large a share of its characters, or that
fails one of two base rules (too short, too repetitive), is rejected. Nothing is exploded and nothing
is shuffled: a document is judged inside its row, so the work is one pass over the table.

Defined results:

* NULL and empty texts have no words: all counts 0, ``base_failed`` true, ``kept`` false, cleaned text ''.
* Lines without a word are neither judged nor counted; they are kept where they stand.
* Very long texts: positions are ordinary array positions, windows are sorted (n log n), never compared
  in pairs.
* Repeated rows are judged alike and all returned. Extra columns of the input are never read; the added
  columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from docketlens.functions.text import let
from docketlens.llm.words import SPACE, WORD, apart, words

# Phrases of page furniture and licence lines, in lower case.
BOILERPLATE = ("all rights reserved", "licensed under", "released under", "we use cookies", "cookie policy", "privacy policy",
               "terms of use", "enable javascript", "subscribe to", "newsletter", "click here", "lorem ipsum")


@dataclass(frozen=True)
class Rules:
    """Thresholds. Shares are of words in a line (line rules) or of the document's word characters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    # A line with at least so many separators, and one for every so many words, is a menu.
    min_separators: int = 2
    words_per_separator: int = 6
    # A line is noise when more than this share of its words carries symbols or doubled exclamation marks.
    max_noisy_percent: int = 30
    # A line this short needs an end mark; longer ones count as prose without one.
    min_words_without_end: int = 4
    # A phrase makes a line boilerplate only when the line is not a paragraph that mentions it.
    max_boilerplate_words: int = 30
    max_lost_percent: int = 40


# Up to so many repeated windows are looked up, more are sorted.
FEW = 16
SEPARATOR = "[|»›•·]"
SYMBOL = "[#*$%&|<>]|!!"
MARKS = ("!!", "»", "›", "•", "·")
SEPARATORS = r"(?:^|[\x20\x09])[|»›•·](?=[\x20\x09]|$)"
NOISY_WORD = rf"[^{SPACE}]*(?:[#*$%&|<>]|!!)[^{SPACE}]*"
END = r"[.!?…。！？:;,)\]\"'”’»\-]\s*$"


def line_fails(line: Column, rules: Rules = Rules(), odd: Column | None = None, phrased: Column | None = None) -> Column:
    """Name of the first rule that a line fails, NULL when it passes or has no word.

    ``odd`` and ``phrased`` say whether the whole text holds a separator or symbol, or one of the phrases;
    where it does not, the searches that could not find anything are left out.
    """
    odd, phrased = F.lit(True) if odd is None else odd, F.lit(True) if phrased is None else phrased
    n = F.regexp_count(line, F.lit(WORD))
    seps = F.regexp_count(line, F.lit(SEPARATORS))
    enough = rf"^[{SPACE}]*(?:{WORD}[{SPACE}]+){{{rules.min_words_without_end - 1}}}[^{SPACE}]"
    return (F.when(~line.rlike(f"[^{SPACE}]"), F.lit(None).cast("string"))
            .when(odd & line.rlike(SEPARATOR) & (seps >= rules.min_separators) & (seps * rules.words_per_separator >= n), "navigation")
            .when(phrased & (n <= rules.max_boilerplate_words) & has_phrase(line), "boilerplate")
            .when(odd & line.rlike(SYMBOL) & (F.regexp_count(line, F.lit(NOISY_WORD)) * 100 > n * rules.max_noisy_percent), "punctuation")
            .when(~line.rlike(enough) & ~line.rlike(END), "punctuation"))


def has_phrase(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))


def twins(h: Column) -> Column:
    """0-based positions of all elements that occur twice or more.

    A few repeated values are looked up one by one; with many, positions are sorted by value.
    """

    def repeated(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1) == x)))

    def by_sort(s: Column) -> Column:
        last = F.size(s) - 1
        return F.transform(F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"]))
                                    | ((k < last) & (F.get(s, k + 1)["h"] == e["h"]))), lambda e: e["i"])

    placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return let(let(F.sort_array(h), repeated), lambda few: F.when(
        F.size(few) <= FEW, F.transform(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(few, x), i)), lambda i: i.isNotNull()), lambda i: i))
        .otherwise(let(F.sort_array(placed), by_sort)))


def repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more, the first time included.

    Windows are compared by a 64-bit hash of their words; only texts with a repeated hash are sorted.
    """
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        spots = F.flatten(F.transform(twins(h), lambda i: F.array(i, i + 1, i + 2)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.size(F.array_distinct(spots)))

    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The documents with counts, verdict, failed line counts per rule and ``clean_text``."""
    body = F.coalesce(F.col(text), F.lit(""))
    counts = let(words(body), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))

    def count_of(tagged: Column, kind: str) -> Column:
        return F.size(F.filter(tagged, lambda e: e["fails"] == kind)).cast("long")

    def of_lines(b: Column) -> Column:
        ls = b["lines"]
        tagged = F.transform(ls, lambda x: F.struct(x.alias("line"), line_fails(x, rules, (b["n_symbols"] > 0) | b["marked"], b["phrased"]).alias("fails")))
        worded = F.filter(ls, lambda x: x.rlike(f"[^{SPACE}]"))

        def summary(t: Column) -> Column:
            bad = F.filter(t, lambda e: e["fails"].isNotNull())
            good = F.when(F.size(bad) == 0, ls).otherwise(F.transform(F.filter(t, lambda e: e["fails"].isNull()), lambda e: e["line"]))
            return F.struct(
                b["n_symbols"].alias("n_symbols"), let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.array_join(good, "\n").alias("clean_text"),
                F.length(F.regexp_replace(F.array_join(F.transform(bad, lambda e: e["line"]), ""), f"[{SPACE}]+", "")).cast("long").alias("lost_chars"),
                *[count_of(bad, kind).alias(f"n_{kind}_lines") for kind in ("punctuation", "navigation", "boilerplate")])

        return let(tagged, summary)

    gates = F.struct(F.split(body, "\n").alias("lines"), F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                     reduce(or_, [F.contains(body, F.lit(m)) for m in MARKS]).alias("marked"), has_phrase(body).alias("phrased"))
    out = docs.withColumns({"_counts": counts, "_lines": let(gates, of_lines)})
    out = out.withColumns({f: F.col(f"_counts.{f}") for f in ("n_words", "word_chars", "n_repeat_words")}
                          | {f: F.col(f"_lines.{f}") for f in ("n_symbols", "n_dup_lines", "clean_text", "n_punctuation_lines",
                                                               "n_navigation_lines", "n_boilerplate_lines", "lost_chars")})
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    lost = F.col("lost_chars") * 100 > F.col("word_chars") * rules.max_lost_percent
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost).drop("_counts", "_lines")


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Documents that pass, without their failed lines; the columns of the input, ``n_chars`` brought up to date."""
    return apart(docs, ["text", "n_chars"], lambda d: _clean(d, rules))


def _clean(docs: DataFrame, rules: Rules) -> DataFrame:
    cols = docs.columns
    src = docs.select(F.struct(*cols).alias("_row"), F.col("text"))
    out = judge(src, rules).filter("kept").select("_row.*", "clean_text").withColumn("text", F.col("clean_text"))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in cols])
