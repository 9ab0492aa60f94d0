"""Mixing sources to target weights with exact budgets.

Every document gets a hash-random key. Within its source the documents stand in key order; the running
total of their sizes is a distributed prefix sum: a source is cut into 2 ** SLICE_BITS key ranges (slices),
so a source with a third of all rows is spread over thousands of groups, and the sums of one source's slices
are a short list. A document is taken as far as the running total stays below the source's
budget, and once more in a second epoch where the budget exceeds the source.

Budgets: sources in code point order, NULL last, weigh 3, 1, 2 in turn and share 150 % of all sizes; none
gets more than twice its size, and what is above goes to the others by weight until none is above. That is the
level at which sum(least(weight * level, 2 * size)) is the amount to share; it is found by a few sums over
the source table.

Defined results:

* The key is an MD5 of the document id and the seed: reruns agree, on any partitioning. Ties (repeated
  ids) are ordered by text; equal rows are interchangeable.
* NULL and empty texts have size 0 and are never taken. A source of empty texts has budget 0.
* The last document of a budget is taken in part, so a source's sum is its budget rounded to whole words.
* An empty table gives an empty result. Extra columns are passed through; added columns replace equal names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docketlens.llm.words import SPACE, WORD, apart, n_words
from docketlens.operators.skew import number_rows
from docketlens.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SLICE_BITS = 12


def source_budgets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, rows, source_size, target) from (source, rows, source_size), one row per source."""
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"]
    ranked = number_rows(sizes.withColumns({"_all": F.lit(1), "_last": F.col("source").isNull()}), ["_all"], ["_last", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = cut_lineage(ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * MAX_EPOCHS))
    level, amount = 0.0, total * SHARE_PERCENT / 100
    while True:
        full = F.col("_cap") <= F.col("_weight") * F.lit(level)
        row = table.agg(F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0)).alias("given"),
                        F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0)).alias("open")).first()
        higher = (amount - row["given"]) / row["open"] if row["open"] else level
        if higher <= level:
            break
        level = higher
    target = F.least(F.col("_cap").cast("double"), F.col("_weight") * F.lit(level))
    return table.select("source", "rows", "source_size", target.alias("target"))


def order_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, seed: str = "mix", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (doc_id and source by default) with size, source_size, target, taken and ``copies``.

    ``copies``: array<long>, the words taken in each epoch that takes any.
    """
    made = ("size", "source_size", "target", "taken", "copies")
    keep = [c for c in (columns or ["doc_id", "source"]) if c not in made]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("source").alias("_source"),
                       order_key(F.col("doc_id"), seed).alias("_key"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_tie"),
                       n_words(F.col("text")).alias("size"))
    if columns is None:  # without texts the rows are narrow: count words once
        rows = cut_lineage(rows)
    # The top bits of the key: slices are ranges of keys.
    sliced = rows.withColumn("_slice", F.shiftright(F.conv(F.substring("_key", 1, 7), 16, 10).cast("long"), 28 - SLICE_BITS))
    sums = cut_lineage(sliced.groupBy("_source", "_slice").agg(F.count("*").alias("rows"), F.sum("size").alias("_sum")))
    budgets = source_budgets(sums.groupBy(F.col("_source").alias("source")).agg(F.sum("rows").alias("rows"), F.sum("_sum").alias("source_size")))
    past = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_source").alias("_s"), F.col("_slice").alias("_l"), F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_offset"))
    starts = starts.join(budgets.drop("rows"), F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    placed = sliced.join(starts, sliced["_source"].eqNullSafe(starts["_s"]) & (sliced["_slice"] == starts["_l"]))
    inside = Window.partitionBy("_source", "_slice").orderBy("_key", "_tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))

    def epoch(e: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - F.col("source_size") * e - F.col("_before")))

    epochs = F.array(*[epoch(e) for e in range(MAX_EPOCHS)])
    return (placed.withColumn("_before", before).withColumn("copies", F.filter(epochs, lambda n: n > 0))
            .withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, n: a + n))
            .select("_row.*", "size", "source_size", "target", "taken", "copies"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{SPACE}]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents of the mix: one row per copy taken, the last of a budget cut after its last word taken."""
    return apart(docs, ["doc_id", "source", "text", "n_chars"], lambda d: _mixed(d, seed))


def _mixed(docs: DataFrame, seed: str) -> DataFrame:
    cols = docs.columns
    taken = mix(docs, seed, cols).withColumn("_copy", F.explode("copies"))
    taken = taken.withColumn("_cut", F.when(F.col("_copy") < n_words(F.col("text")), first_words(F.col("text"), F.col("_copy"))))
    changed = {"text": F.coalesce("_cut", "text")}
    if "n_chars" in cols:
        changed["n_chars"] = F.coalesce(F.length("_cut").cast(docs.schema["n_chars"].dataType), "n_chars")
    out = taken.withColumns(changed)
    return out.select(*[F.col(f"`{c}`") for c in cols])
