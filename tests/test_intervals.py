"""Interval joins against all pairs, and vector search against a full product."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docketlens.operators import intervals
from docketlens.plans import material, ranking


def brute(points, ranges):
    return Counter((k, v, lo, hi) for k, v in points for q, lo, hi in ranges
                   if k is not None and k == q and v is not None and lo is not None and lo <= v and (hi is None or v <= hi))


def test_stab_equals_all_pairs(spark):
    rng = random.Random(1)
    value = lambda: rng.choice(["", "2012", "2024-03", "2024-03-05"]) or f"{rng.randrange(1990, 2050)}-{rng.randrange(1, 13):02d}"[:rng.choice([4, 7])]
    points = [(rng.choice(["a", "b", None]), rng.choice([value(), value(), None])) for _ in range(150)]
    ranges = [(rng.choice(["a", "b", None]), rng.choice([value(), value(), value(), None]), rng.choice([value(), value(), None])) for _ in range(150)]
    p = spark.createDataFrame(points, "k string, value string")
    r = spark.createDataFrame([(*x, i, i % 3 + 1) for i, x in enumerate(ranges)], "k string, low string, high string, id int, w int")
    got = Counter(tuple(x) for x in intervals.stab(p, r, ["k"]).select("k", "value", "low", "high").collect())
    want = brute(set(points), set(ranges))
    assert got == want
    sums = {(x.k, x.value): (x.n, x.least) for x in intervals.stab_sums(p, r, ["k"], "w", "id").collect()}
    full = {}
    for i, (k, lo, hi) in enumerate(ranges):
        for q, v in set(points):
            if brute([(q, v)], [(k, lo, hi)]):
                n, least = full.get((q, v), (0, 10**9))
                full[q, v] = n + i % 3 + 1, min(least, i)
    assert sums == full
    assert intervals.stab(p.limit(0), r, ["k"]).count() == 0 and intervals.stab_sums(p, r.limit(0), ["k"], "w", "id").count() == 0


def test_covering_facts_any_year_and_precision(spark):
    facts = spark.createDataFrame([(1, "t", "2024-01~2024-06"), (2, "t", "2012-01~2013-06"), (3, "t", "2023-05~"), (4, "t", "2024-03"), (5, "u", "2024-01~"), (6, "t", None),
                                   (7, "t", " 2024-03~ "), (8, "t", "~2024")], "event_id int, fact_type string, fact_value string")
    asked = [(1, "t", "2024-03-05"), (2, "t", "2012-05"), (3, "t", "2099"), (4, "u", "2023"), (5, "t", ""), (6, "t", None), (7, "t", "2024-03-05")]
    q = spark.createDataFrame(asked, "question_id int, fact_type string, period string")
    pairs = facts.alias("f").join(q.alias("q"), F.col("f.fact_type") == F.col("q.fact_type")).filter(material.period_covers("q.period", "f.fact_value"))
    want = Counter((r.question_id, r.event_id) for r in pairs.collect())
    assert (1, 1) in want and (2, 2) in want and (3, 3) in want
    assert Counter((r.question_id, r.event_id) for r in material.covering_facts(facts, q).collect()) == want
    assert material.covering_facts(facts, q).columns[:3] == facts.columns or set(facts.columns) <= set(material.covering_facts(facts, q).columns)
    counts = {r.question_id: (r.facts, r["first"]) for r in material.covering_counts(facts, q, "event_id").collect()}
    assert counts == {i: (sum(n for (a, _), n in want.items() if a == i), min(e for a, e in want if a == i)) for i in {a for a, _ in want}}


def test_covering_counts_makes_the_facts_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def value(i):
        made.add(1)
        return ["2024-01~2024-06", "2023-05~", " 2024-01~2024-06"][i % 3]

    # A value of its own for the optimizer: it would be made again for a filter.
    facts = spark.range(60).select(F.col("id").alias("event_id"), F.lit("t").alias("fact_type"), value.asNondeterministic()("id").alias("fact_value"))
    q = spark.createDataFrame([(1, "t", "2024-03"), (2, "t", "2030")], "question_id int, fact_type string, period string")
    assert {r.question_id: (r.facts, r["first"]) for r in material.covering_counts(facts, q, "event_id").collect()} == {1: (60, 0), 2: (20, 1)}
    assert made.value == 60


def test_vectors_by_blocks(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (90, 4)).astype(float)
    vectors[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5, vectors[5].tolist()), (None, [1.0] * 4), (200, None)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    q = df.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    ids = np.array([i for i, v in rows if i is not None and v is not None])
    m = np.array([v for i, v in rows if i is not None and v is not None])
    unit = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    want = {}
    for i in range(0, 90, 10):
        s = np.round(unit @ unit[i], 6)
        want[i] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:6]]
    for blocks in ((4, 7), (1000, 1000)):
        got = {}
        for r in ranking.nearest_vectors(df, q, 6, *blocks).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == want
    assert ranking.nearest_vectors(df, q.limit(0)).count() == 0 and ranking.nearest_vectors(df.limit(0), q).count() == 0


def test_a_block_of_vectors_is_scored_in_small_slices():
    import tracemalloc

    import pyarrow as pa

    vectors = pa.array(np.random.default_rng(3).normal(size=(ranking.VECTOR_BLOCK, 4)).tolist(), pa.list_(pa.float32()))
    ids = pa.array(range(len(vectors)), pa.int64())
    tracemalloc.start()
    got = ranking._best_of_block(3)(pa.table({"query_id": ids[:256], "vector": vectors[:256]}), pa.table({"vec_id": ids, "vector": vectors}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 256 * 3 and got["vec_id"].to_pylist()[::3] == list(range(256))
    assert peak < 40 << 20
