"""Resumable extraction batches: a log of attempts, folded to what is due next.

The log only grows: an attempt is one row when it starts (``running``, with the end of its lease) and one when it ends (``done`` or ``failed``).
What a document is at is the fold of its rows, so a batch that died half-way and is started again, or is
recorded twice, changes nothing: unfinished attempts are due again when their lease is over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

LOG = "document_id string, attempt int, status string, lease_until long, sha256 string, error string"
MAX_ATTEMPTS = 3


def standing(log: DataFrame) -> DataFrame:
    """(document_id, attempts, failures, status, lease_until, sha256, error): the last attempt; of one attempt the end counts, not the start."""
    ended = F.col("status") != "running"
    last = F.max(F.struct("attempt", ended.alias("ended"), "status", "lease_until", "sha256", "error")).alias("l")
    return log.groupBy("document_id").agg(F.max("attempt").alias("attempts"), F.count_distinct(F.when(F.col("status") == "failed", F.col("attempt"))).alias("failures"), last).select(
        "document_id", "attempts", "failures", "l.status", "l.lease_until", "l.sha256", "l.error")


def due(docs: DataFrame, log: DataFrame, now: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The documents to take now, with the number of their next ``attempt``: not done, not under a lease, not failed too often."""
    s = standing(log).select("document_id", "attempts", "failures", "status", "lease_until")
    taken = docs.join(s, "document_id", "left")
    busy = (F.col("status") == "running") & (F.col("lease_until") > now)
    open_ = F.col("status").isNull() | ((F.col("status") != "done") & ~busy & (F.col("failures") < max_attempts))
    return taken.filter(open_).withColumn("attempt", F.coalesce("attempts", F.lit(0)) + 1).drop("attempts", "failures", "status", "lease_until")


def started(batch: DataFrame, until: int) -> DataFrame:
    none = F.lit(None).cast("string")
    return batch.select("document_id", "attempt", F.lit("running").alias("status"), F.lit(until).cast("long").alias("lease_until"), none.alias("sha256"), none.alias("error"))


def ended(results: DataFrame) -> DataFrame:
    """Log rows of finished attempts from (document_id, attempt, sha256, error)."""
    failed = F.col("error").isNotNull()
    return results.select("document_id", "attempt", F.when(failed, "failed").otherwise("done").alias("status"), F.lit(None).cast("long").alias("lease_until"),
                          F.when(~failed, F.col("sha256")).alias("sha256"), "error")


def run(docs: DataFrame, log: DataFrame, extract: Callable[[DataFrame], DataFrame], now: int, lease: int,
        keep: Callable[[DataFrame], DataFrame], max_attempts: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """One batch: (log, results). ``extract`` gives document_id, attempt, sha256, text and error; ``keep`` stores a table and returns it."""
    batch = due(docs, log, now, max_attempts)
    begun = keep(log.unionByName(started(batch, now + lease)))
    results = keep(extract(batch))
    return keep(begun.unionByName(ended(results))), results
