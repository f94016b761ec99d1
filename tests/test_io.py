import json
import os
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import html, readers, sinks
from corpusloom.streaming import scoring


def test_csv_is_text_as_it_stands(spark, tmp_path):
    p = tmp_path / "s" / "m.csv"
    p.parent.mkdir()
    p.write_text('﻿text,label\n"a ""quoted""\nline",NA\n,1\n', encoding="utf-8")
    rows = [tuple(r) for r in readers.raw_csv(spark, str(tmp_path), "s", "m.csv").collect()]
    assert rows == [('a "quoted"\nline', "NA"), ("", "1")]
    (tmp_path / "l.csv").write_bytes("text\nnão\n".encode("latin-1"))
    assert readers.strings_csv(spark, str(tmp_path / "l.csv"), ["text"], encoding="ISO-8859-1").first().text == "não"
    both = readers.union_members([readers.strings_csv(spark, str(p), ["text", "label"])] * 2)
    assert both.count() == 4


def test_json_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"p1": {"annotators": [{"label": "hate"}, {"label": "normal"}], "post_tokens": ["a", "b"]}, "p2": {"annotators": [], "post_tokens": []}}))
    assert {r.post_id: (r.labels, r.text) for r in readers.json_records(spark, str(tmp_path / "m.json")).collect()} == {"p1": (["hate", "normal"], "a b"), "p2": ([], "")}
    (tmp_path / "d").mkdir()
    for k in (1, 2):
        (tmp_path / "d" / f"{k}.json").write_text(json.dumps({"id": k}, indent=1))
    assert sorted((r.file, r.id) for r in readers.json_documents(spark, str(tmp_path / "d" / "*.json")).collect()) == [("1.json", 1), ("2.json", 2)]
    (tmp_path / "p.jsonl").write_text('{"page_id": 1, "blocks": ["x"]}\n{"page_id": 2}\n')
    assert [r.blocks for r in readers.pages(spark, str(tmp_path / "p.jsonl")).orderBy("page_id").collect()] == [["x"], None]


def test_lists_and_archives(spark, tmp_path):
    (tmp_path / "u.tsv").write_text("# note\nhttp://a\tfirst\n\nhttp://b\n")
    assert [tuple(r) for r in readers.url_list(spark, str(tmp_path / "u.tsv")).collect()] == [("http://a", "first"), ("http://b", None)]
    (tmp_path / "l.tsv").write_text("lemma\tcategory\tlevel\nBad\tps\tinclusive\n")
    assert readers.lexicon_tsv(spark, str(tmp_path / "l.tsv")).first().lemma == "Bad"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.csv", "x\n1\n")
    rows = readers.zip_members(spark, str(tmp_path / "a.zip"), ["in.csv", "absent"])
    assert {r.member: r.content and bytes(r.content) for r in rows.collect()} == {"in.csv": b"x\n1\n", "absent": None}
    assert readers.zip_members(spark, str(tmp_path / "a.zip"), ["in.csv"], rows.select("sha256")).count() == 0
    doc = sinks.provenance(str(tmp_path / "prov.json"), "s", rows, "2020-01-01")
    assert set(doc["s"]["files"]) == {"in.csv", "absent"} and sinks.provenance(str(tmp_path / "prov.json"), "t", rows, "x").keys() == {"s", "t"}
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert readers.config(str(tmp_path / "c.json")) == {"a": 1}


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "test", 1), ("b", "val", 2)], "model_id string, split string, v int")
    sinks.table(df, str(tmp_path / "t"))
    assert readers.table(spark, str(tmp_path), "t").count() == 2 if (tmp_path / "t.parquet").exists() else spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.predictions(df, str(tmp_path / "p"))
    sinks.predictions(df.where("model_id = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "p"))
    assert {(r.model_id, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("a", 9), ("b", 2)}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5), (None, None)], "name string, v double")
    sinks.json_report(df, str(tmp_path / "r" / "x.json"))
    assert json.loads((tmp_path / "r" / "x.json").read_text()) == [{"name": "a|b", "v": 0.5}, {"name": None, "v": None}]
    sinks.csv_report(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert sinks.markdown(df).splitlines()[2] == "| a\\|b | 0.5000 |"
    sinks.multi_table_csv([df, df.select("v")], str(tmp_path / "m.csv"))
    assert (tmp_path / "m.csv").read_text().split() == ["name,v", "a|b,0.5", ",", "v", "0.5"] or "\n\n" in (tmp_path / "m.csv").read_text().replace("\r", "")
    sinks.example_sheet(df, str(tmp_path / "sheet.md"))
    sinks.model_card(str(tmp_path / "card.md"), "m1", {"c": 1.0}, df, "none")
    assert "# m1" in (tmp_path / "card.md").read_text() and "| name | v |" in (tmp_path / "sheet.md").read_text()
    assert sinks.tracker_log(str(tmp_path / "log.jsonl"), "r1", {"c": 1}, {"f1": 0.5}) and not sinks.tracker_log("/proc/no/log", "r", {}, {})
    with pytest.raises(ValueError):
        sinks.report_rows(spark.range(sinks.REPORT_ROWS + 1))


def test_registry(spark):
    old = spark.createDataFrame([("a", "f", 1), ("b", "f", 2), ("c", "g", 3)], "model_id string, family string, v int")
    new = spark.createDataFrame([("a", "f", 9)], "model_id string, family string, v int")
    assert {(r.model_id, r.v) for r in sinks.registry_upsert(old, new).collect()} == {("a", 9), ("b", 2), ("c", 3)}
    assert {(r.model_id, r.v) for r in sinks.registry_upsert(old, new, family="family").collect()} == {("a", 9), ("c", 3)}


def test_manifest_sees_every_change(spark):
    df = spark.createDataFrame([(f"i{k}", "train") for k in range(500)], "id string, split string")
    a, b = sinks.manifest(df).collect(), sinks.manifest(df.withColumn("split", F.when(F.col("id") == "i7", "test").otherwise(F.col("split")))).collect()
    assert sum(r.n for r in a) == 500 and sum(x not in a for x in b) == 1


def test_page_blocks(spark):
    page = "<nav><p>menu menu menu</p></nav><p>First  block here<p>Second block here</p><ul><li>An item of it</li><li><p>inner leaf block</p></li></ul><p>short</p><p>First block here</p>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string").withColumn("position", F.lit(0))
    assert [(r.id, r.position, r.block) for r in html.page_blocks(df).orderBy("position").collect()] == [(1, 0, "First block here"), (1, 1, "Second block here"), (1, 2, "An item of it"), (1, 3, "inner leaf block")]


def test_stream_and_table_score_alike(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": "1", "text": "a bad day"}\n{"id": "2", "text": null}\n')
    score = scoring.lexicon_score(["bad"])
    stream = scoring.requests(spark, str(tmp_path / "in"))
    scoring.score_stream(stream, score, 0.3, "v1", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "2.json").write_text('{"id": "3", "text": "fine"}\n')
    scoring.score_stream(stream, score, 0.3, "v1", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    table = {r.id: r for r in scoring.score_batch(spark.read.schema(scoring.REQUEST).json(str(tmp_path / "in")), score, 0.3, "v1").collect()}
    assert rows == table and rows["1"].label == "hate" and rows["2"].score == 0 and rows["3"].label == "not_hate"


def test_queries_are_readable_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 80; from pyspark.sql import SparkSession; assert SparkSession.getActiveSession() is None"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
