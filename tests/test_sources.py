import zipfile

from packetloom.sources import packets


def test_folder(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("one\ftwo\f\f")
    (tmp_path / "in/sub/b.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "in/c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:p><w:t>Hello</w:t></w:p><w:br w:type="page"/><w:p><w:t>World</w:t></w:p>')
    (tmp_path / "in/d.docx").write_bytes(b"broken")
    got = {r.file_name: r for r in packets.read_folder(spark, str(tmp_path / "in")).collect()}
    assert got["a.txt"].pages == ["one", "two"]
    assert [p.strip() for p in got["c.docx"].pages] == ["Hello", "World"]
    assert got["b.pdf"].pages is None and "reader" in got["b.pdf"].error and got["d.docx"].error


def test_stores_and_sinks(spark, tmp_path):
    runs = spark.createDataFrame([(1, 95, "i1", "a1"), (2, 75, None, "a2"), (3, 10, "i3", None)], "id bigint, score int, va_icn string, authorization_number string")
    packets.append(runs, str(tmp_path / "store"))
    packets.append(runs.withColumn("extra", runs["score"]), str(tmp_path / "store"))
    assert packets.read_store(spark, str(tmp_path / "store")).count() == 6
    packets.write_routed(runs, str(tmp_path / "routed"))
    assert {r.route for r in spark.read.parquet(str(tmp_path / "routed")).select("route").collect()} == {"approved", "needs_review", "rejected"}
    new = spark.createDataFrame([(4, 1, "i1", "zz"), (5, 1, "new", "a2"), (6, 1, None, None), (7, 1, "n", "m")], runs.schema)
    packets.append_new(new, runs, str(tmp_path / "appended"))
    assert {r.id for r in spark.read.parquet(str(tmp_path / "appended")).collect()} == {6, 7}
    packets.write_report(runs, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 3
    assert packets.as_json(runs).first().value.startswith('{"id":1')


def test_code_list(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("m54.5,back pain\n M54.5 ,again\n,none\nA10.1,\"x, y\"\n")
    assert {r.code for r in packets.read_code_list(spark, str(tmp_path / "codes.csv")).collect()} == {"M54.5", "A10.1"}
