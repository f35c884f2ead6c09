import hashlib
import json
import zipfile
from pathlib import Path

from rasterlake.llm import warc


def test_packages_are_files(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"page {k} " * 300) for k in range(500)], "page_id long, url string, html string").repartition(3)
    packages = spark.createDataFrame(warc.write_archives(pages, package_bytes=5000, folder=f"file://{tmp_path}/p").collect())
    paths = [Path(r.path.removeprefix("file://")) for r in packages.collect()]
    assert len(paths) > 3 and {p.name for p in paths} == {r.name for r in packages.collect()} == {p.name for p in (tmp_path / "p").iterdir()}
    assert all(zipfile.ZipFile(p).testzip() is None for p in paths)
    key = lambda r: r.page_id
    assert sorted(warc.read_archives(packages, "path").collect(), key=key) == sorted(warc.read_archives(warc.write_archives(pages)).collect(), key=key)
    assert warc.write_archives(pages.limit(0), folder=f"file://{tmp_path}/q").count() == 0


def test_zip64_file_is_read_by_ranges(spark, tmp_path):
    body, at = b"some text " * 50, tmp_path / "large.wacz"
    with open(at, "wb") as f:
        f.truncate(200 << 30)  # a hole, larger than any memory here
    member = warc.write_record("response", "urn:page:7", "u", body, hashlib.sha1(body).digest(), None)
    with zipfile.ZipFile(at, "a", zipfile.ZIP_STORED) as z:
        z.writestr(warc.DATA, member)
        z.writestr(warc.INDEX, "0 " + json.dumps({"url": "u", "offset": 0, "length": len(member)}))
    rows = warc.read_archives(spark.createDataFrame([(f"file://{at}",), (None,)], "path string"), "path").collect()
    assert [(r.page_id, r.payload) for r in rows] == [(7, body)]
    at.unlink()


def test_query_writes_files(spark):
    from rasterlake.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.rglob("*.wacz"))
    rows = warc.op3_warc(spark, "/root/testdata/sf0.001").count()
    assert rows == 50 and set(folder.rglob("*.wacz")) - before


def test_long_payloads_and_many_repeats(spark):
    from rasterlake.llm import warc
    from pyspark.sql import functions as F

    long = "<p>" + "wörter " * 400_000
    rows = [(1, "u", long), (2, "u", long), (3, "u", None)] + [(10 + k, f"u{k}", "x" * 1000) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumn("digest", F.lit("d")).withColumn("keep", F.lit(1))
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, package_bytes=20_000)).collect()}
    assert len(got) == 303 and got[2].record_type == "response" and got[1].refers_to == 2 and got[1].payload_bytes == len(long.encode())
    assert [k for k in range(10, 310) if got[k].record_type == "response"] == [309] and {got[k].refers_to for k in range(10, 309)} == {309}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert again == {k: (r.record_type, r.refers_to) for k, r in got.items()}
