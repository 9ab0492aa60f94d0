"""Table comparison and the attempt log."""

from collections import Counter

from docketlens.plans import batches
from docketlens.sources import compare


def test_differences_are_those_of_the_multisets(spark):
    left = [(1, "a", None), (1, "a", None), (2, None, 3.5), (3, "c", 0.0), (None, "d", 1.0)]
    right = [(1, "a", None), (2, None, 3.5), (3, "c", 0.5), (None, "d", 1.0), (9, "new", 2.0)]
    ddl = "k int, `a.b` string, x double"
    a, b = spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl)
    got = Counter()
    for r in compare.differences(a, b.select("x", "k", "`a.b`"), ["k"], 4).collect():
        got[r.side, r.k, r["a.b"], r.x] += r.copies
    want = {("left", *r): n for r, n in (Counter(left) - Counter(right)).items()} | {("right", *r): n for r, n in (Counter(right) - Counter(left)).items()}
    assert got == want
    assert compare.same_tables(a, a.repartition(5), ["k"]) and not compare.same_tables(a, b, ["k"]) and not compare.same_tables(a, b.drop("x"), ["k"])
    assert compare.same_tables(a.limit(0), b.limit(0), ["k"]) and not compare.same_tables(a, a.limit(0), ["k"])


def test_attempt_log(spark):
    docs = spark.createDataFrame([(d,) for d in "abcdef"], "document_id string")
    rows = [("a", 1, "running", 10, None, None), ("a", 1, "done", None, "s", None), ("b", 1, "running", 10, None, None), ("c", 1, "running", 99, None, None),
            ("d", 1, "failed", None, None, "x"), ("d", 2, "failed", None, None, "x"), ("d", 3, "failed", None, None, "x"), ("e", 1, "failed", None, None, "y"), ("e", 1, "failed", None, None, "y")]
    log = spark.createDataFrame(rows, batches.LOG)
    assert {(r.document_id, r.attempt) for r in batches.due(docs, log, 50).collect()} == {("b", 2), ("e", 2), ("f", 1)}
    assert {(r.document_id, r.attempt) for r in batches.due(docs, log.union(log), 50).collect()} == {("b", 2), ("e", 2), ("f", 1)}
    assert {r.document_id for r in batches.due(docs, log, 5).collect()} == {"e", "f"} and batches.due(docs.limit(0), log, 5).count() == 0
    s = {r.document_id: (r.status, r.failures) for r in batches.standing(log).collect()}
    assert s == {"a": ("done", 0), "b": ("running", 0), "c": ("running", 0), "d": ("failed", 3), "e": ("failed", 1)}
