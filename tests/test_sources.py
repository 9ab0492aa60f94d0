import json

import pytest
from pyspark.sql import functions as F

from docketlens import rules
from docketlens.operators import skew
from docketlens.sources import artifacts, catalog, dictionaries, ledgers, sinks
from docketlens.streaming import catalog_stream


def tree(tmp_path):
    for p in ("proj1/招标文件.docx", "proj1/sub/响应文件.docx", "loose.txt", "非标书/a.txt", "proj2/Thumbs.db"):
        f = tmp_path / "root" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x" * len(p))
    return {"R1": str(tmp_path / "root")}


def test_listing_and_delta(spark, tmp_path):
    got = catalog.classify_listing(catalog.list_files(spark, tree(tmp_path)))
    assert {r["relative_path"]: r["skip_reason"] for r in got.collect()} == {
        "proj1/招标文件.docx": None, "proj1/sub/响应文件.docx": None, "loose.txt": "loose", "非标书/a.txt": "excluded", "proj2/Thumbs.db": "system"}
    kept = got.filter("skip_reason IS NULL")
    assert {r["file_ext"] for r in kept.collect()} == {".docx"}
    stored = kept.filter("relative_path LIKE '%招标%'").withColumn("file_size", F.lit(1).cast("long"))
    delta = catalog.catalog_delta(kept, stored)
    assert {r["relative_path"]: r["action"] for r in delta.collect()} == {"proj1/招标文件.docx": "update_meta", "proj1/sub/响应文件.docx": "insert"}
    nxt = catalog.next_catalog(delta, stored)
    assert nxt.count() == 2 and catalog.duplicate_keys(nxt).isEmpty()
    again = catalog.catalog_delta(kept, nxt)
    assert {r["action"] for r in again.collect()} == {"keep"}
    assert catalog.same_keys(kept, nxt, ["source_root_id", "relative_path"])


def test_missing_root_stops_the_run(spark, tmp_path):
    with pytest.raises(catalog.UnreachableRoot):
        catalog.list_files(spark, {**tree(tmp_path), "R2": str(tmp_path / "nowhere")})


def test_files_are_written_and_listed_in_tasks(spark, tmp_path):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b=/", "é"), (2, None, None)]
    df = spark.createDataFrame(rows, "proj int, page string, html string").repartition(2)
    sinks.write_files(df, f"file:{tmp_path}/files", ["proj", "page"], "html")
    (tmp_path / "files/.hidden").mkdir()
    (tmp_path / "files/.hidden/x.txt").write_text("x")
    (tmp_path / "files/_SUCCESS").write_text("")
    got = catalog.list_files(spark, {"R": f"file:{tmp_path}/files", "S": str(tmp_path / "files/proj=2")})
    assert got.inputFiles() == []  # no index of the files on the driver
    folder = F.regexp_replace("relative_path", "/?part-[^/]*$", "")
    assert sorted(tuple(r) for r in got.select("source_root_id", folder, "file_size").collect()) == [
        ("R", "proj=1/page=a", 2), ("R", "proj=1/page=a", 2), ("R", "proj=1/page=b%3D%2F", 3), ("R", "proj=2/page=__HIVE_DEFAULT_PARTITION__", 1),
        ("S", "page=__HIVE_DEFAULT_PARTITION__", 1)]
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/files")
    name = F.element_at(F.split("path", "/files/"), -1)
    want = sorted(tuple(r) for r in by_spark.select(name, "length", "modificationTime").collect())
    assert sorted(tuple(r) for r in got.filter("source_root_id = 'R'").select("relative_path", "file_size", "file_mtime").collect()) == want


def test_plugin_decoder_keeps_failures(spark):
    docs = spark.createDataFrame([("d1", "h1", "ok"), ("d2", "h2", "bad"), ("d3", "h1", "ok")], "document_id string, sha256 string, content string")
    known = spark.createDataFrame([], "sha256 string, parser_name string, parser_version string")

    def decode(c):
        if c == "bad":
            raise ValueError("broken")
        return c.upper()

    new = artifacts.extract_with(docs, known, decode, "p", "1")
    rows = {r["document_id"]: (r["text"], r["error"]) for r in artifacts.outcomes(docs, new).collect()}
    assert rows == {"d1": ("OK", None), "d2": (None, "ValueError: broken"), "d3": ("OK", None)}


def test_html_text(spark):
    df = spark.createDataFrame([("<p>a&amp;b</p><script>var x='<p>';</script><div>c<br>d</div>",)], "html string")
    assert df.select(artifacts.html_text("html")).first()[0] == "a&b\nc\nd"


def test_json_sources_and_dictionaries(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"note": "n", "records": [{"contract_number": "A1", "has_payment": "yes"}, {"contract_number": "A2"}]}, indent=1))
    got = ledgers.read_records(spark, str(tmp_path / "v.json"), "contract_number string, has_payment string")
    assert sorted(tuple(r) for r in got.collect())[0] == ("A1", "yes") and got.count() == 2
    (tmp_path / "allow.json").write_text(json.dumps([{"document_id": "abcdef0123456789"}], indent=1))
    assert ledgers.read_allow_list(spark, str(tmp_path / "allow.json")).first()[0] == "abcdef012345"
    (tmp_path / "d.json").write_text(json.dumps({"_note": ["x"], "B": ["b1", "b2"], "A": ["a"]}))
    words = dictionaries.load(str(tmp_path / "d.json"))
    assert list(words) == ["B", "A"]
    assert [tuple(r) for r in dictionaries.as_table(spark, words).orderBy("priority", "position").collect()][0] == ("B", "b1", 0, 0)


def test_csv_export_and_guard(spark, tmp_path):
    df = spark.createDataFrame([('a "q"', 1)], "name string, n int")
    sinks.write_csv(df, str(tmp_path / "csv"), {"name": "名称", "n": "数"})
    parts = [f.read_text(encoding="utf-8") for f in (tmp_path / "csv").glob("*.csv")]
    text = "".join(parts)
    assert len(parts) == 1 and text.startswith('"﻿名称","数"') and '"a ""q""","1"' in text
    sinks.write_report(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["n"] == 1
    sinks.assert_own_rows(df, df, "name")
    with pytest.raises(sinks.ForeignRows):
        sinks.assert_own_rows(df, df.filter("n > 1"), "name")
    assert sinks.write_snapshot(df, str(tmp_path / "snap")).first()["n"] == 1


def test_section_sink(spark):
    s = spark.createDataFrame([("s1", "d1", "xx"), ("s1", "d1", "xx"), ("s2", "d2", "x"), ("s3", "d3", "xxx")], "section_id string, document_id string, section_text string")
    new = sinks.new_sections(s, s.filter("document_id = 'd3'"), 1)
    assert [r["section_id"] for r in new.collect()] == ["s1"]
    assert sinks.upsert_sections(s.filter("section_id = 's2'"), new).count() == 2


def test_catalog_stream_is_incremental(spark, tmp_path):
    src, store, chk = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "chk")
    src.mkdir()
    row = lambda p: json.dumps({"source_root_id": "R", "relative_path": p, "file_size": 1, "file_mtime": "2024-01-01T00:00:00Z"})
    (src / "1.json").write_text(row("p/响应文件.docx") + "\n" + row("loose"))
    catalog_stream.refresh_stream(spark, str(src), store, chk).awaitTermination()
    (src / "2.json").write_text(row("p/响应文件.docx") + "\n" + row("p/b.docx"))
    catalog_stream.refresh_stream(spark, str(src), store, chk).awaitTermination()
    got = spark.read.parquet(store)
    assert sorted(r["relative_path"] for r in got.collect()) == ["p/b.docx", "p/响应文件.docx"]


def test_sheet_rows_last_value_wins(spark):
    d = spark.createDataFrame([(1, "a/x.xlsx", "Sheet1!H2=t\nSheet1!H3=N1 | Sheet1!K3=未到款\nSheet1!H4=N2 | Sheet1!H4=N3 | Sheet1!J4=t")], "document_id int, relative_path string, text string")
    got = {r["contract_number"]: r["has_payment"] for r in ledgers.voucher_records(d).collect()}
    assert got == {"N1": "no", "N3": "yes"}


def test_number_rows_matches_a_plain_count(spark):
    rows = [(0 if i % 3 else i % 7, (i * 7919) % 1000) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, o int").withColumn("o", F.col("o") * 1000 + F.monotonically_increasing_id() % 1000)
    got = {}
    for r in skew.number_rows(df, ["k"], ["o"], "n", 6).collect():
        got.setdefault(r["k"], []).append((r["o"], r["n"]))
    for v in got.values():
        v.sort()
        assert [n for _, n in v] == list(range(1, len(v) + 1))


def test_no_company_names_by_default():
    assert rules.Vendors() == rules.Vendors((), (), None, ())
