"""Rows with equal ids and other texts."""

import random
from collections import Counter

from docketlens.llm import simhash_variants


def test_equal_ids_with_other_texts(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(str(rng.randrange(10**6)) for _ in range(200)) for _ in range(3))
    schema = "doc_id long, text string, lang string"

    def kept(rows):
        return Counter((r.doc_id, r.text) for r in simhash_variants.keep_one(spark.createDataFrame(rows, schema)).collect())

    assert kept([(5, a, "x"), (5, b, "x")]) == Counter([(5, a), (5, b)])
    # One group {5a, 9}, one group {3, 5b}: one document of each.
    for one, two in ((a, b), (b, a)):
        assert kept([(5, one, "x"), (9, one, "x"), (3, two, "x"), (5, two, "x")]) == Counter([(5, one), (3, two)])
    assert kept([(7, c, "x"), (7, c, "x"), (None, c, "y"), (None, a, "y"), (None, a, "y")]) == Counter([(7, c), (None, a)])
