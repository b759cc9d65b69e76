"""Plan-level gates, observed progress, variants and FB2 by built-ins."""

import json
import time

import pytest
from pyspark.sql import functions as F

from bindery.functions import fb2
from bindery.operators import state, view
from bindery.sources import books, catalogs, formats
from bindery.streaming import jobs
from test_sources import FB2


def checked(spark, rows):
    return spark.createDataFrame(rows, "path string, reason string")


def jobs_run(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_a_commit_is_gated_in_the_plan(spark):
    fine, bad = checked(spark, [("a", ""), ("b", "")]), checked(spark, [("a", ""), ("b", "stale"), ("c", "missing")])
    before = jobs_run(spark)
    passed, refused, none = state.gated(fine), state.gated(bad), state.gated(checked(spark, []))
    verdicts = [spark.range(1).select(state.allowed(x).alias("ok")) for x in (fine, bad, checked(spark, []))]
    assert jobs_run(spark) == before  # nothing has run yet
    assert passed.count() == 2 and none.count() == 0
    with pytest.raises(Exception, match="refused: 2 of its books"):
        refused.collect()
    with pytest.raises(Exception, match="refused"):
        refused.where("path = 'a'").collect()  # the whole batch is refused, its fresh books too
    assert [v.first().ok for v in verdicts] == [True, False, False]


def test_progress_is_observed_while_a_job_runs(spark, tmp_path):
    at = f"file://{tmp_path}"
    schema = "id long, failed boolean"
    for k in range(4):
        spark.createDataFrame([(k * 10 + j, j < k) for j in range(10)], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    seen = []

    def run(rows=4):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        return jobs.start(stream, lambda df: df, f"{at}/out", f"{at}/checkpoint", delay=0.2)

    job = run()
    while job.query.isActive:
        seen.append(job.progress())
        time.sleep(0.05)
    job.join()
    assert job.progress() == (40, 6) and seen == sorted(seen) and len(set(seen)) > 2
    want = jobs.progress(spark.read.schema("failed boolean").parquet(f"{at}/out")).first()
    assert job.progress() == (want.completed, want.failures)
    # a later run goes on from what was counted
    spark.createDataFrame([(99, True)], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    job = run()
    assert job.progress()[0] >= 40
    job.join()
    assert job.progress() == (41, 7)


def test_archive_strings_that_look_like_lists(spark):
    docs = [{"identifier": "a", "title": "T", "creator": "[Anonymous]", "description": "[Illustrated] a book"}, {"identifier": "b", "title": "U", "creator": [" X ", "", "Y"], "description": ["one", "two"], "year": 1999}, {"identifier": "c", "title": "V", "creator": '["A"]', "isbn": None}]
    rows = spark.createDataFrame([("k", json.dumps({"response": {"docs": docs}})), ("l", "{broken"), ("m", None), ("n", "[]"), ("o", '{"response":{"docs":"x"}}')], "book string, body string")
    a, b, c = catalogs.internet_archive(rows, ["book"]).orderBy("url").collect()
    assert (a.authors, a.description) == (["[Anonymous]"], "[Illustrated] a book")
    assert (b.authors, b.description, b.pubdate) == (["X", "Y"], "one, two", "1999")
    assert (c.authors, c.isbns, c.isbn) == (['["A"]'], [], "")


RICH = """<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><genre>g1</genre><genre> g2 </genre>
<author><first-name>A</first-name><middle-name>M</middle-name><last-name>B</last-name></author><author><nickname>x</nickname></author><book-title>T &amp; U &lt;3</book-title><annotation><p>one &lt; two</p><p>three <b>four</b> &amp;amp;</p></annotation>
<lang>ru</lang><translator><last-name>Z</last-name></translator><sequence name="S" number="2"/><sequence name="S2"/></title-info><src-title-info><book-title>Orig</book-title></src-title-info><publish-info><year>2001</year><isbn>1</isbn></publish-info>
<custom-info info-type="prog-rating">4</custom-info><custom-info info-type="edition">second</custom-info><custom-info info-type="other">x</custom-info></description>
<body><title><p>Head</p></title><section><p>Some <em>text</em> here &#60; &#x3C;.</p><empty-line/><p>More &amp; more</p></section></body><body name="notes"><p>note</p></body><binary id="a">AAAA</binary></FictionBook>"""


@pytest.mark.parametrize("xml", [FB2.decode(), RICH])
def test_fb2_by_built_ins_equals_the_parser(spark, xml):
    row = spark.createDataFrame([(xml,)], "xml string").select(fb2.parsed(F.col("xml")).alias("b"))
    got = row.select(fb2.record(F.col("b"), F.lit("/x/a.fb2")).alias("r"), fb2.body_text(F.col("b")).alias("t"), "b._damage").first()
    want = formats.read_fb2(xml.encode(), "/x/a.fb2")
    record = got.r.asDict()
    custom = record.pop("custom")
    assert {k: v for k, v in (record | custom).items() if v} == {k: v for k, v in want.items() if v}
    assert got.t == formats.read_text(xml.encode(), "a.fb2") and got._damage is None


def test_fb2_files_in_their_encodings(spark, tmp_path):
    body = '<?xml version="1.0" encoding="%s"?><FictionBook><description><title-info><book-title>Книга é</book-title></title-info></description><body><p>ёж</p></body></FictionBook>'
    for name, codec in (("utf-8", "utf-8"), ("windows-1251", "cp1251"), ("koi8-r", "koi8-r"), ("utf-16", "utf-16")):
        (tmp_path / f"{name}.fb2").write_bytes((body % name).encode(codec, "xmlcharrefreplace"))
    (tmp_path / "bad + one.FB2").write_bytes(b"<FictionBook><desc")
    (tmp_path / "empty.fb2").write_bytes(b"<FictionBook><description/></FictionBook>")
    rows = {r.path.rsplit("/", 1)[1]: r for r in books.read_fb2(spark, f"file://{tmp_path}").collect()}
    assert {rows[f"{n}.fb2"].record.title for n in ("utf-8", "windows-1251", "koi8-r", "utf-16")} == {"Книга é"}
    assert rows["koi8-r.fb2"].text == "ёж" and not rows["koi8-r.fb2"].damaged
    bad = next(r for n, r in rows.items() if n.startswith("bad"))
    assert bad.damaged and bad.record.title == "bad + one"
    assert rows["empty.fb2"].record.title == "empty" and not rows["empty.fb2"].damaged


def test_parent_folders(spark):
    paths = ["/", "/a", "/a/b", "/a/b/", "//"]
    got = [r.p for r in spark.createDataFrame([(p,) for p in paths], "f string").select(view.parent(F.col("f")).alias("p")).collect()]
    assert got == ["", "/", "/a", "/a", ""]
