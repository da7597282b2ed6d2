"""Archives as files: what begins them, and what revisits refer to."""

from latticeflow.llm import arc_convert


def test_revisits_name_the_record_of_their_response(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a b/2", "<p>x</p>"), (3, None, "<p>y</p>"), (4, "http://a/4", "<p>x</p>"), (5, "http://c", "<p>y</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    table = arc_convert.convert(pages, str(tmp_path / "table"))
    records = [x for r in table.collect() for x in arc_convert.parse_warc(bytes(r["content"]))]
    kinds = [f["WARC-Type"] for f, _ in records]
    assert kinds.count("response") == 2 and kinds.count("revisit") == 3 and kinds.count("warcinfo") == table.count()
    by_page = {arc_convert.http_split(b)[0]["x-page-id"]: f for f, b in records if f["WARC-Type"] != "warcinfo"}
    for page, last in (("1", "4"), ("2", "4"), ("3", "5")):
        assert by_page[page]["WARC-Refers-To"] == by_page[last]["WARC-Record-ID"]
        assert by_page[page]["WARC-Refers-To-Target-URI"] == by_page[last]["WARC-Target-URI"]
    written = arc_convert.write_archives(table, str(tmp_path / "files"))
    assert written.count() == table.count()
    for r in table.collect():
        assert (tmp_path / "files" / r["name"]).read_bytes() == bytes(r["content"])
    assert sorted(f["WARC-Type"] for f, _ in arc_convert.parse_warc((tmp_path / "files" / table.first()["name"]).read_bytes()))[-1] == "warcinfo"


def test_more_pages_of_one_payload_than_salts(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "same") for i in range(300)], "page_id long, url string, html string").repartition(7)
    got = arc_convert.round_trip(pages).collect()
    assert {r["page_id"]: r["refers_to"] for r in got} == {i: 299 if i != 299 else None for i in range(300)}
