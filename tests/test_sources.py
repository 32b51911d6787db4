import datetime as dt

import pytest
from pyspark.sql import functions as F

from wordtide.functions import text
from wordtide.sources import http, readers, sinks
from wordtide.streaming import publish as stream


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_book_ids(spark):
    for raw in ("007", " 7", "+7", "7"):
        assert one(spark, raw, text.book_id) == "gutenberg-7"
    assert one(spark, "gutenberg-42", text.source_id) == 42
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, "gutenberg-x", text.source_id)


def test_text_functions(spark):
    assert one(spark, "Smith, Adam", lambda c: text.label(c, F.lit(1776))) == "Smith (1776)"
    assert one(spark, "Montesquieu", lambda c: text.label(c, F.lit(1748))) == "Montesquieu (1748)"
    assert one(spark, "LABOR-ers, 12!", lambda c: text.respell(text.clean(c))) == "labourers"
    assert one(spark, "elaborate", text.respell) == "elabourate"
    assert one(spark, "12", text.clean) == ""
    assert [one(spark, t, text.content_tag) for t in ("NNS", "VBD", "JJR", "RB", "WRB", "DT", "")] == ["N", "V", "J", "R", "W", None, None]
    assert one(spark, "s3://x/10-2024-01-01_00-00-00-ab.model", text.seed_of_path) == 10
    assert one(spark, " Release No. of-x", text.metadata_key) == "release_no_of_x"
    for event, want in (('{"index": "a"}', "a"), ('{"body": "{\\"index\\": 7}"}', "7"), ("{", None), ("[1]", None), (None, None), ('{"body": "{"}', None)):
        assert one(spark, event, text.event_index) == want


def test_html():
    page = "<html><head><title>t</title></head><body><div id=pg-header>head</div><p>One <b>two</b>\n three<p>é &amp; x<br>y<script>z</script><div id='pg-footer'><p>foot</p></div></body></html>"
    assert text.html_text(page) == "One two three é & x y"
    assert text.html_text("<p> </p>") is None and text.html_text(None) is None and text.html_text("<p>a<b>c</p>") == "a c"
    record = '<table class="bibrec"><tr><th>Author</th><td><a href="/a/1">Smith, Adam</a></td></tr><tr><th>Release No.</th><td>\n 1\n 2 </td></tr><tr><td>no key</td></tr></table><table><tr><th>X</th><td>y</td></tr></table>'
    assert text.html_metadata(record) == {"author": ["Smith, Adam"], "author_link": ["/a/1"], "release_no": ["1", "2"]}
    assert text.html_metadata("") == {}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('one,"t,wo",\nthree\n"q""q"\n', encoding="utf-8")
    rows = readers.sentence_rows(spark, str(tmp_path / "a.csv")).orderBy("sent_ix").collect()
    assert [r.tokens for r in rows] == [["one", "t,wo", ""], ["three"], ['q"q']]
    back = sinks.csv_lines(spark.createDataFrame([(["one", "t,wo", 'q"q', ""],)], "tokens array<string>"), "tokens").first().line
    assert back == 'one,"t,wo","q""q",'
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "3-x.model").write_bytes(b"12")
    assert [r.length for r in readers.files(spark, str(tmp_path), ".model").collect()] == [2]
    assert readers.objects(spark, str(tmp_path / "a.csv")).count() == 1
    pages = spark.createDataFrame([('<a href="/ebooks/12">x</a><a href="/ebooks/7">',), ('<a href="/ebooks/12">',)], "html string")
    assert sorted(r.source_id for r in readers.book_links(pages).collect()) == [7, 12]
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    assert readers.get(df, {"k": None}, ["v"]).collect()[0].v == 3
    assert [r.v for r in readers.get_many(df, spark.createDataFrame([("b",), ("b",)], "k string"), ["v"]).collect()] == [2]
    assert readers.job_arguments(["--platform", "gutenberg", "--id", "007"]).book_id == "gutenberg-7"
    with pytest.raises(SystemExit):
        readers.job_arguments(["--platform", "other", "--id", "1"])


def test_page_source(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.html").write_text(f"<p>page {i}</p>")
    spark.dataSource.register(http.BookPages)
    got = spark.read.format("book_pages").option("base", f"file://{tmp_path}").option("path", "{id}.html").option("ids", "1,2").load()
    assert {(r.source_id, r.html) for r in got.collect()} == {(1, "<p>page 1</p>"), (2, "<p>page 2</p>")}


def test_states_of_a_table(spark, tmp_path):
    schema = "k string, a int, b int, at timestamp"
    day = [dt.datetime(2025, 1, d) for d in (1, 2, 3)]
    old = spark.createDataFrame([("x", 1, 1, day[0]), ("y", 2, 2, day[1])], schema)
    new = spark.createDataFrame([("x", 9, 9, day[2]), ("z", 3, 3, day[0]), ("z", 3, 3, day[0])], schema)
    assert {(r.k, r.a) for r in sinks.insert_new(old, new, ["k"]).collect()} == {("x", 1), ("y", 2), ("z", 3)}
    assert {tuple(r) for r in sinks.inserted(old, new, ["k"]).collect()} == {("x", False), ("z", True)}
    changes = spark.createDataFrame([("x", 7), ("w", 8)], "k string, a int")
    assert {tuple(r)[:3] for r in sinks.update_fields(old, changes, ["k"]).collect()} == {("x", 7, 1), ("y", 2, 2), ("w", 8, None)}
    assert {(r.k, r.a) for r in sinks.put_rows(old, new, ["k"], "at").collect()} == {("x", 9), ("y", 2), ("z", 3)}
    path = str(tmp_path / "t")
    sinks.write_partitions(old, path, ["k"])
    sinks.write_partitions(new.where("k = 'x'"), path, ["k"])
    assert {(r.k, r.a) for r in spark.read.parquet(path).collect()} == {("x", 9), ("y", 2)}


def test_corpus_stream(spark, tmp_path):
    rows = spark.createDataFrame([("rent", "a"), ("rent", "b"), ("wage", "a")], "term string, book_id string")
    rows.write.parquet(str(tmp_path / "in"))

    def run():
        live = spark.readStream.schema("term string, book_id string").parquet(str(tmp_path / "in"))
        stream.corpus_stream(live, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)

    run()
    spark.createDataFrame([("rent", "c"), ("rent", "a")], "term string, book_id string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {r.term: r.book_ids for r in stream.read_corpus(spark, str(tmp_path / "out")).collect()} == {"rent": ["a", "b", "c"], "wage": ["a"]}


def test_paged_listing():
    ids = list(range(100, 160))

    def fetch(start):
        return " ".join(f'<a href="/ebooks/{i}"><a href="/ebooks/{i}">' for i in ids[start - 1 : start + 24])

    assert http.listed_ids(fetch, pause=0) == ids
    ids = ids[:50]
    assert http.listed_ids(fetch, pause=0) == ids and http.listed_ids(lambda start: "", pause=0) == []


def test_csv_round_trip(spark):
    data = [(i, x) for i, x in enumerate([["a", "b"], [""], ["", ""], ['q"q', "x,y"], ["line\nbreak", "cr\r\nlf"], ["one"]])]
    df = spark.createDataFrame(data, "k int, tokens array<string>")
    back = readers.csv_rows(sinks.csv_lines(df, "tokens"), "k", "line").collect()
    assert sorted((r.k, r.tokens) for r in back) == data and {r.sent_ix for r in back} == {0}
    assert readers.csv_rows(spark.createDataFrame([(1, None), (2, "")], "k int, line string"), "k", "line").count() == 0


def test_models_of_other_books_stay(spark, tmp_path):
    rows = spark.createDataFrame([("b1", 0, "x", [1.0]), ("b1", 1, "x", [2.0]), ("b2", 0, "x", [3.0])], "book_id string, seed int, term string, v array<double>")
    centre = spark.createDataFrame([("b1", "x", 1.5), ("b2", "x", 3.0)], "book_id string, term string, x double")
    sinks.write_models(rows, centre, str(tmp_path / "m"))
    sinks.write_models(rows.where("book_id = 'b1' and seed = 1").withColumn("v", F.array(F.lit(9.0))), centre.where("book_id = 'b1'"), str(tmp_path / "m"))
    assert sorted((r.book_id, r.seed, r.v) for r in readers.seed_models(spark, str(tmp_path / "m")).collect()) == [("b1", 0, [1.0]), ("b1", 1, [9.0]), ("b2", 0, [3.0])]
    assert readers.centroid_models(spark, str(tmp_path / "m")).count() == 2
