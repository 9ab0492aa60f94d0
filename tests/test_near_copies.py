"""Near-duplicate clusters of whole tables against all pairs by brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from docketlens.operators import identity, near_copies
from workload import load
from workload.registry import QUERIES


def shingles(t):
    s = re.sub(r"[^0-9a-z一-鿿]+", "", (t or "").lower())
    return frozenset(s[i:i + 4] for i in range(max(1, len(s) - 3))) if s else frozenset()


def brute(rows):
    sets = [shingles(t) for _, _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n >= 0.75 * (len(sets[i]) + len(sets[j]) - n) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    by = {}
    for r, row in zip(root, rows):
        by.setdefault(r, []).append(row)
    return Counter((min((r[0] for r in v if r[0] is not None), default=None), len(v), max((r[1], r[0] or -1) for r in v)[1]) for v in by.values())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefghij 0") for _ in range(400)) for _ in range(8)]
    texts = [b for b in base for _ in range(2)] + [None, "", "?!", "ab", "AB", "一二三四五"]
    texts += [base[0].upper()] * 70  # more copies than a pool of 60 holds
    texts += [base[1][:i] + "zz" + base[1][i:] for i in range(0, 400, 8)]  # near copies
    texts += [base[2] + base[3][:40 * k] for k in range(3)]  # other lengths
    rnd.shuffle(texts)
    return [(i, len(t or ""), t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [4, 2048])
def test_clusters_cover_the_whole_table(spark, rows, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "HOT_LINKS", 3 * block)
    df = spark.createDataFrame(rows, "doc_id long, n_chars long, text string").repartition(5)
    got = Counter(map(tuple, near_copies.clusters(df).collect()))
    assert got == brute(rows)
    assert near_copies.clusters(df.limit(0)).count() == 0


def test_odd_sketches_drop_no_link():
    rnd = random.Random(3)
    sets = []
    for size in (1, 3, 30, 900, 1100, 4000, 9000, 20000):
        base = [rnd.getrandbits(62) for _ in range(size)]
        sets += [np.unique(np.array(base[:k] + [rnd.getrandbits(62) for _ in range(m)], "u8")) for k, m in ((size, 0), (size - size // 10, 0), (size, size // 6), (size, size // 4), (size, size))]
    block = near_copies._OddBlock(np.arange(len(sets))[::-1] - 5, np.array([len(x) for x in sets]), [near_copies.odd_sketch(x) for x in sets])
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    a, b = np.array(pairs).T
    may = block.may_link(len(sets) - 6 - a, len(sets) - 6 - b, 0.75)
    for (x, y), kept in zip(pairs, may):
        n = len(np.intersect1d(sets[x], sets[y]))
        assert kept or n < 0.75 * (len(sets[x]) + len(sets[y]) - n)
    assert may.sum() < 0.1 * len(pairs)


def test_strangers_near_the_threshold_are_dropped_before_the_exact_check(spark, monkeypatch):
    rnd = random.Random(7)
    made = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    shared = made(800)
    texts = [shared + made(210) for _ in range(60)]  # any two at 0.66
    texts += [texts[0] + "zz", texts[1] + "yy", texts[2][:700] + texts[3][700:]]
    rows = [(i, len(t), t) for i, t in enumerate(texts)]
    checks, cut = [], near_copies.cut_lineage

    def seen(df):
        df = cut(df)
        checks.extend([df.count()] if df.columns == ["a", "b"] else [])
        return df

    monkeypatch.setattr(near_copies, "cut_lineage", seen)
    monkeypatch.setattr(near_copies, "DENSE_LINKS", 8)
    df = spark.createDataFrame(rows, "doc_id long, n_chars long, text string").repartition(3)
    assert Counter(map(tuple, near_copies.clusters(df).collect())) == brute(rows)
    # Candidates, those left for the exact check and links of both steps.
    assert len(checks) == 6 and checks[3] > 500 and checks[4] < 100, checks


@pytest.mark.parametrize("small, blocks", [(32, 8), (2, 1), (2, 3)])
def test_dense_candidates_in_any_blocks(spark, rows, small, blocks, monkeypatch):
    for name, value in (("BLOCK", 8), ("SMALL_BAND", small), ("DENSE_LINKS", 2), ("ODD_BLOCKS", blocks)):
        monkeypatch.setattr(near_copies, name, value)
    df = spark.createDataFrame(rows, "doc_id long, n_chars long, text string").repartition(5)
    assert Counter(map(tuple, near_copies.clusters(df).collect())) == brute(rows)


def test_query_joins_copies_of_all_sources(spark, tmp_path):
    load()
    text = "the same sentence stands in many sources and at every rank of its source " * 3
    rows = [(i, text, "en", [None, "a", "b"][i % 3], len(text)) for i in range(200)] + [(900, "nothing else is like this one", "en", None, 29)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["near_duplicate_clusters"](spark, str(tmp_path)).select("copies", "representative").collect()
    assert sorted(map(tuple, got)) == [(1, 900), (200, 199)]


def test_pool_of_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, 1, "one text of a pool"), (None, 2, "one text of a pool"), ("p", 1, "x")], "pool string, pool_rank int, text string")
    got = identity.cluster_pool(df, ["pool"], "text").select("pool", "pool_rank", "cluster_no").collect()
    assert Counter(map(tuple, got)) == Counter([(None, 1, 0), (None, 2, 0), ("p", 1, 0)])
