import zipfile

from carrel.sources import files
from carrel.streaming import incremental


def test_workbook_round_trip():
    rows = [["a", "b"], ["x & y", 5], [None, "z"]]
    ((name, back),) = files.xlsx_rows(files.xlsx_bytes({"Sheet": rows}))
    assert name == "Sheet" and back == [["a", "b"], ["x & y", "5"], [None, "z"]]


def test_auto_import(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("people.csv", "id,name,born\n# a comment,,\n1,Ann,2001-02-03\n2,Bob,\n")
        z.writestr("book.xlsx", files.xlsx_bytes({"scores": [["k", "v"], ["1", "1.5"], ["2", "2"]]}))
    got = files.auto_import(spark, str(tmp_path / "all.zip"))
    assert dict(got["people"].dtypes) == {"id": "bigint", "name": "string", "born": "date"} and got["people"].count() == 2
    assert dict(got["scores"].dtypes) == {"k": "bigint", "v": "double"}


def test_documents(spark):
    assert files.document_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par W\'f6rld}", "rtf") == "Hello\nWörld"
    assert files.document_text(b"<p>a &amp; b</p>", ".html") == "a & b"
    assert files.document_text(b"x", "exe") is None and files.document_text(b"no zip", "docx") is None
    df = spark.createDataFrame([(bytearray(b"abc"), "txt"), (bytearray(b"x"), "exe")], "content binary, ext string")
    assert [r.text for r in files.document_texts(df, "content", "ext", skip_failed=True).collect()] == ["abc"]


def test_ids_and_delimited(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("1 2\n3\nx\n\n2")
    assert sorted(r.id for r in files.ids(spark, str(tmp_path / "ids.txt"), "bigint").collect()) == [1, 2, 3]
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n#c\td\n\n2\ty\n")
    assert files.delimited(spark, str(tmp_path / "t.tsv")).count() == 2


def test_people_and_exports(spark, tmp_path):
    (tmp_path / "p.csv").write_text("local_id,forenames,surnames,dob,gender,postcodes,perfect_id,other_info\n1,Ann/2000-01-01/;Bea,Low,1990-01-01,F,CB2 3EB,nhs:5,\n")
    d = files.people(spark, str(tmp_path / "p.csv"))
    names = d.select(files.temporal(d["forenames"]).alias("f")).first().f
    assert [(n.name, str(n["from"])) for n in names] == [("Ann", "2000-01-01"), ("Bea", "None")]
    files.tsv_zip({"q": d.select("local_id")}, str(tmp_path / "q.zip"))
    assert zipfile.ZipFile(tmp_path / "q.zip").read("q.tsv") == b"local_id\n1\n"


def test_stream_skips_what_is_done(spark, tmp_path):
    src, dest, ck = (str(tmp_path / x) for x in ("src", "dest", "ck"))
    run = lambda: incremental.process_stream(spark, src, "id long, v string", "id", "k", lambda d: d, dest, ck).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([(2, "b"), (3, "c"), (1, "A")], "id long, v string").coalesce(1).write.mode("append").parquet(src)
    run()
    rows = sorted((r.id, r.v, r.batch) for r in spark.read.parquet(dest).collect())
    assert rows == [(1, "A", 1), (1, "a", 0), (2, "b", 0), (3, "c", 1)]
