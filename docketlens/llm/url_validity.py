"""URL filters by a temporal list join.

A list is a log of dated entries: on a day, a value is added to or removed from a list. A value is a domain
(it covers its subdomains) or a prefix of host and path in whole segments. The log becomes validity intervals
[valid_from, valid_to), and every capture is held against the entries that were active on its fetch day: an
equality join on the values that can cover its URL, with the day inside the interval. A capture meets at
most as many values as its host has labels and its path segments.

Captures of one URL on one day are collapsed before the join and all get the result, so a URL with very many
captures is one row. A host or domain that many URLs share is an ordinary skewed join key, which adaptive
execution splits; verdicts are aggregates with partial combination.

Defined results:

* NULL or unparsable URLs and NULL fetch days match nothing: no hits, verdict ``none``. Every capture row is returned.
* Entries of one value on one day apply in order of ``seq``; the last one holds. Repeated entries change nothing.
  Entries with a NULL in any of the read columns are ignored.
* ``allow`` beats ``block``. Very long URLs are cut at their segments like others. Empty lists and tables give no hits.
* Columns of captures are kept; added columns replace equal names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)?", 1)


def domains(host: Column) -> Column:
    """The host and its parent domains, two labels at least."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(
        F.array().cast("array<string>"))


def prefixes(host: Column, path: Column) -> Column:
    """host, host/a, host/a/b and so on."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.concat(F.array(host), F.slice(parts, F.lit(1), i)), "/"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, action, kind, value, valid_from, valid_to) from (list, action, kind, value, change, day, seq).

    ``action``: block or allow; ``change``: add or remove; an open interval has valid_to NULL.
    """
    one = Window.partitionBy("list", "action", "kind", "value").orderBy("day")
    per_day = (entries.dropna(subset=["list", "action", "kind", "value", "change", "day"])
               .groupBy("list", "action", "kind", "value", "day").agg(F.max_by("change", "seq").alias("change")))
    turns = per_day.withColumn("before", F.lag("change").over(one)).filter((F.col("before").isNull() & (F.col("change") == "add")) | (F.col("before") != F.col("change")))
    spans = turns.withColumn("valid_to", F.lead("day").over(one)).filter("change = 'add'")
    return spans.select("list", "action", "kind", "value", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched_on") -> DataFrame:
    """The captures with n_hits, blocked, allowed, verdict and first_list (the smallest name of a list that hits)."""
    added = ("n_hits", "blocked", "allowed", "verdict", "first_list")
    rows = captures.drop(*added)
    keys = rows.select(F.col(url).alias("_url"), F.col(day).alias("_day")).dropna().distinct()
    host = host_of(F.col("_url"))
    covers = F.concat(F.transform(domains(host), lambda v: F.struct(F.lit("domain").alias("kind"), v.alias("value"))),
                      F.transform(prefixes(host, path_of(F.col("_url"))), lambda v: F.struct(F.lit("prefix").alias("kind"), v.alias("value"))))
    asked = keys.filter(host != "").select("_url", "_day", F.explode(covers).alias("_c")).select("_url", "_day", "_c.kind", "_c.value")
    active = (F.col("_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to")))
    hits = asked.join(intervals(entries), ["kind", "value"]).filter(active)
    found = hits.groupBy("_url", "_day").agg(F.count("*").alias("n_hits"), F.bool_or(F.col("action") == BLOCK).alias("blocked"),
                                             F.bool_or(F.col("action") == ALLOW).alias("allowed"), F.min("list").alias("first_list"))
    out = rows.join(found, (rows[url] == found["_url"]) & (rows[day] == found["_day"]), "left").drop("_url", "_day")
    out = out.withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "blocked": F.coalesce("blocked", F.lit(False)), "allowed": F.coalesce("allowed", F.lit(False))})
    return out.withColumn("verdict", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("none"))
