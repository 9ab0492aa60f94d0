"""Column helpers for text: Unicode-aware trimming, line splitting, keyword tests.

Every regular expression goes through :func:`rx`, which turns on Unicode classes so that
``\\s`` removes full-width and no-break spaces and ``\\d`` follows the Unicode digits.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


# Every character that Unicode counts as white space.
WHITE = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                          0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def rx(pattern: str) -> str:
    return "(?U)" + pattern


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (a lambda variable is a binding)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space; a plain trim with a character set, no regular expression."""
    return F.btrim(col(c), F.lit(WHITE))


def strip_chars(c: Column | str, chars: str) -> Column:
    """Strip a set of characters (given as a regex class body) from both ends."""
    return F.regexp_replace(col(c), f"^[{chars}]+|[{chars}]+$", "")


def drop_space(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rx(r"\s+"), "")


def squeeze_space(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), rx(r"\s+"), " "))


def blank(c: Column | str) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.coalesce(strip(c), F.lit("")) == ""


def lines(c: Column | str) -> Column:
    """All lines of a text, any line break; a final line break adds no line."""
    text = text_or_empty(c)
    # The pattern for the end would look at every line break of the text: only a text that ends with one needs it.
    open_end = reduce(lambda a, b: a | b, [F.endswith(text, F.lit(x)) for x in "\n\r\x0b\f\x85\u2028\u2029"])
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.when(open_end, F.regexp_replace(text, r"\R\z", "")).otherwise(text), r"\R")
    )


def stripped_lines(c: Column | str) -> Column:
    return F.transform(lines(c), strip)


def numbered(arr: Column) -> Column:
    """array<string> -> array<struct<no:int, line:string>>, numbers from 1."""
    return F.transform(arr, lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))


def unfold(df: DataFrame, arr: str, keep: list[str]) -> DataFrame:
    """One row per struct of an array column, fields side by side.

    Outer generation plus a test on the generated value: a plain explode would make the optimizer
    infer a size() filter and re-evaluate the whole array expression below the projections.
    """
    return (df.select(*keep, F.explode_outer(arr).alias("_item")).filter("_item IS NOT NULL")
            .select(*keep, "_item.*"))


def contains_any(c: Column | str, words: Iterable[str]) -> Column:
    """False for NULL text; an OR of plain substring tests stays inside codegen."""
    text = text_or_empty(c)
    tests = [F.contains(text, F.lit(w)) for w in words]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def contains_any_nocase(c: Column | str, words: Iterable[str]) -> Column:
    return contains_any(F.lower(text_or_empty(c)), [w.lower() for w in words])


def first_rule(c: Column | str, rules: Iterable[tuple[str, Iterable[str]]], default: str | None = None,
               nocase: bool = False) -> Column:
    """Ordered rules (label, keywords): the first rule with any keyword in the text wins."""
    test = contains_any_nocase if nocase else contains_any
    out = None
    for label, words in rules:
        out = F.when(test(c, words), label) if out is None else out.when(test(c, words), label)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def rx_group(c: Column | str, pattern: str, group: int = 0) -> Column:
    """regexp_extract that yields NULL (not '') where nothing matches."""
    text = col(c)
    return F.when(text.rlike(rx(pattern)), F.regexp_extract(text, rx(pattern), group))


def rx_found(c: Column | str, pattern: str, group: int = 0) -> Column:
    """:func:`rx_group` as one expression that names ``c`` once, for a ``c`` that costs more than a search of the rest of the text."""
    return F.get(F.regexp_extract_all(col(c), F.lit(rx(pattern)), F.lit(group)), 0)


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def find(c: Column | str, needle: Column | str, start: Column | int = 0) -> Column:
    """0-based position of ``needle`` at or after ``start``; -1 where absent."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    s = F.lit(start) if isinstance(start, int) else start
    return F.position(n, col(c), s + 1) - 1


def sub(c: Column | str, start: Column, end: Column) -> Column:
    """text[start:end] with 0-based, already clipped bounds."""
    return F.substring(col(c), start + 1, F.greatest(end - start, F.lit(0)))


def left(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def base_name(c: Column | str) -> Column:
    return F.substring_index(col(c), "/", -1)


def parent_path(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"/?[^/]*$", "")


def char_class_norm(c: Column | str) -> Column:
    """Lower case, only ASCII letters, digits and CJK ideographs kept."""
    return F.regexp_replace(F.lower(text_or_empty(c)), "[^0-9A-Za-z一-鿿]+", "")


def grams_of(c: Column | str, k: int = 4) -> Column:
    """Set of character k-grams of a text; the whole text when it is shorter."""

    def grams(s: Column) -> Column:
        n = F.length(s)
        # Characters as an array: a position in a string is found by counting from its start.
        every = let(F.split(s, ""), lambda c: F.transform(
            F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.concat(*[F.get(c, i + j) for j in range(k)])))
        return (F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(s)).otherwise(F.array_distinct(every)))

    return let(col(c), grams)


def shingles(c: Column | str, k: int = 4) -> Column:
    """Set of character k-grams of the normalised text."""
    return grams_of(char_class_norm(c), k)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct items; 0 when either is empty."""
    share = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def matches(c: Column | str, pattern: str) -> Column:
    """array<struct<raw, start, end>> of all matches, positions 0-based like slices."""
    text = text_or_empty(c)
    hits = F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(0))
    gaps = F.split(text, rx(pattern), -1)
    # One more gap than hits: the last pair has no hit and falls away.
    pairs = F.filter(F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g"))), lambda p: p["h"].isNotNull())
    kind = "struct<raw:string, start:int, end:int>"
    init = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(st: Column, p: Column) -> Column:
        start = st["at"] + p["g"]
        end = start + F.length(p["h"])
        one = F.struct(p["h"].alias("raw"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(st["out"], F.array(one)).alias("out"))

    return F.when(text.rlike(rx(pattern)), F.aggregate(pairs, init, step, lambda st: st["out"])).otherwise(
        F.array().cast(f"array<{kind}>"))


def starts_of(c: Column | str, word: str) -> Column:
    """0-based positions of a literal word, left to right, not overlapping."""
    quoted = "".join(f"\\{ch}" if ch in r"\.[]{}()*+-?^$|" else ch for ch in word)
    return F.when(F.contains(text_or_empty(c), F.lit(word)), F.transform(matches(c, quoted), lambda m: m["start"])).otherwise(
        F.array().cast("array<int>"))


def first_of(arr: Column) -> Column:
    """First element that is not NULL."""
    return F.get(F.filter(arr, lambda x: x.isNotNull()), F.lit(0))


def keep_first(arr: Column, key) -> Column:
    """Elements whose key occurs for the first time, order kept."""
    return let(F.transform(arr, key), lambda keys: F.filter(arr, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1))
