"""Stages return the caller's columns with the caller's values, whatever their names."""

from pyspark.sql import functions as F

from docketlens.llm import mixing, quality_rules, secret_index, words

NAMES = ("clean_text", "a.b", "spans", "redacted_text", "_null", "_row_is_there", "size", "copies", "target", "_copy", "_cut", "source_size", "taken", "_row", "row", "_counts", "_lines",
         "n_words", "kept", "_key", "_tie", "_slice", "_before", "_source", "_apart_0", "key", "ids", "decoded")
TEXT = " ".join(f"Sentence {n} tells of river {n * 7} and stone {n * 3}." for n in range(30)) + "\npassword: hunter2hunter is written here, for all to see and to copy.\n"


def test_values_stay(spark):
    rows = [(i, TEXT if i % 2 else TEXT + f" More words {i}.", "s", 5) + tuple(f"{n}-{i}" for n in NAMES) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    for stage in (quality_rules.clean, secret_index.redact, mixing.mixed):
        out = stage(docs)
        assert out.columns == docs.columns
        got = out.select("doc_id", F.array(*[F.col(f"`{n}`") for n in NAMES]).alias("v")).collect()
        assert got and all(r.v == [f"{n}-{r.doc_id}" for n in NAMES] for r in got), stage
    assert not secret_index.redact(docs).filter("contains(text, 'hunter2hunter')").count()


def test_apart_replaces_equal_names_behind(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out = words.apart(df, ["a"], lambda d: d.withColumn("b", F.col("a") + 10))
    assert out.columns == ["a", "c", "b"] and tuple(out.first()) == (1, 3, 11)


def test_a_mention_of_key_lines_is_no_key(spark):
    head, tail = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    body = "MIIEpAIBAAKCAQEA" * 4
    texts = [f"See {head} in the manual. " + "Plain words follow. " * 50 + f"Then {tail} stands there.", f'"key": "{head}\\n{body}\\n{body}\\nq83v\\n{tail}\\n"']
    got = [r.text for r in secret_index.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0].count("Plain words follow.") == 50 and got[1] == '"key": "[pem]\\n"'


def test_long_runs_of_a_token_start(spark):
    import re
    import time

    rule = next(r for r in secret_index.RULES if r.kind == "jwt")
    start = time.time()
    assert not re.search(rule.pattern, "eyJ" * 350_000, rule.flags) and time.time() - start < 1
    token = "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9
    assert re.search(rule.pattern, "x " + token, rule.flags)
