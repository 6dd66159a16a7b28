import datetime as dt

import pytest
from pyspark.sql import functions as F

from mapshelf.operators import catalog as C
from mapshelf.operators import documents as M
from mapshelf.operators import options as O
from mapshelf.functions import links as L


def options(spark, **kw):
    df = spark.range(1).select(O.normalize_options(**{k: F.lit(v) if isinstance(v, str) else v for k, v in kw.items()}).alias("o"))
    return df.first().o


def test_options(spark):
    want = {"iformat": "point(1,2)", "skipheader": "true", "separator": " "}
    assert options(spark, text="iformat:point(1,2) -skipheader 'separator: '") == want
    assert options(spark, text='iformat:point(1,2)   "separator: " -skipheader') == want
    items = F.array(F.lit("iformat:point(1,2)"), F.lit("separator: "))
    assert options(spark, items=items) == {"iformat": "point(1,2)", "separator": " "}
    assert options(spark, text="a:1 a:2 b:x:y -c") == {"a": "2", "b": "x:y", "c": "true"}
    run = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    own = F.create_map(F.lit("b"), F.lit("3"))
    row = spark.range(1).select(O.merge_options(run, own).alias("m"), O.merge_options(run, F.lit(None).cast("map<string,string>")).alias("n")).first()
    assert row.m == {"a": "1", "b": "3"} and row.n == {"a": "1", "b": "2"}


@pytest.fixture(scope="module")
def small(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("01", "Riverside/roads", "Roads", ["x", "Lakes"], "published", t, 5, None), ("02", "NE", "natural", None, "ready", t + dt.timedelta(1), None, 9),
            ("03", "solo", None, [], "published", t + dt.timedelta(2), 50, 10), ("04", "Riversides", "lakes", [], "strange", t, 0, 3), ("05", " ", None, None, "created", t, 1, 1)]
    return spark.createDataFrame(rows, "_id string, name string, description string, tags array<string>, status string, modifiedAt timestamp, num_features long, num_points long")


def ids(df):
    return [r["_id"] for r in df.select("_id").collect()]


def test_lists(small):
    assert ids(C.list_datasets(small)) == ["03", "01", "05", "04", "02"]
    assert C.list_datasets(small, "published", ["name", "zzz"]).columns == ["_id", "name", "zzz"]
    assert ids(C.list_published(small)) == ["03", "01"]
    assert C.find(small, "01", ("status",)).columns == [c for c in small.columns if c != "status"]
    assert ids(C.find(small, "99")) == []
    row = C.find_id_then_name(small, "01").first()
    assert row.status is None
    assert C.find_id_then_name(small, "solo").first().status == "published"
    assert C.last_modified(small, "none").first().last_modified is None


def test_search(small):
    assert sorted(ids(C.search(small, " LAKES"))) == ["01", "04"]
    assert ids(C.search(small, "", "Riverside")) == ["01"]
    assert ids(C.search(small, "", "solo")) == ["03"]
    assert len(ids(C.search(small))) == 5
    assert ids(C.suggest(small, "R", 2)) == ["01", "02"]
    assert ids(C.suggest(small, "  ")) == []
    assert [r.prefix for r in C.category_prefixes(small).collect()] == ["Riversides", "solo"]


def test_derived(small):
    rows = {r["_id"]: r for r in small.select("_id", C.points_per_feature(F.col("num_points"), F.col("num_features")).alias("p"),
                                              C.needs_separate_index(F.col("num_points"), F.col("num_features"), threshold=1).alias("s"),
                                              C.needs_separate_index(F.col("num_points"), F.col("num_features"), F.lit(True)).alias("o")).collect()}
    assert [rows[i].p for i in ("01", "02", "03", "04", "05")] == [0, None, 0, None, 1]
    assert [rows[i].s for i in ("01", "02", "03", "04", "05")] == [False, False, False, False, True]
    assert rows["01"].o is True
    stages = {r["_id"]: r for r in C.remaining_stages(small).collect()}
    assert stages["04"].result == "strange-error" and stages["04"].stages is None
    assert stages["02"].error == "Cannot process dataset in status 'ready'"
    assert stages["05"].stages == C.STAGES[1:]


def test_documents(small, spark, tmp_path):
    import json
    doc = C.to_catalog_json(small.select("_id", "name", "num_points"))
    M.write_document(doc, str(tmp_path / "d"), "gzip", ordered=True)
    import gzip
    text = "".join(gzip.open(p, "rt").read() for p in sorted((tmp_path / "d").rglob("part-*")))
    parsed = json.loads(text)
    assert [d["_id"] for d in parsed["datasets"]] == ["01", "02", "03", "04", "05"]
    none = C.to_catalog_json(small.where("false"))
    assert [r.line for r in none.orderBy("part").collect()] == ['{"datasets":[', "]}"]
    one = C.to_catalog_json(C.find(small, "03").select("_id", "name"), single=True)
    assert json.loads("".join(r.line for r in one.orderBy("part").collect())) == {"dataset": {"_id": "03", "name": "solo"}}


def test_table(spark, tmp_path):
    table = C.CatalogTable(spark, str(tmp_path / "cat"))
    assert table.read().count() == 0
    rows = spark.createDataFrame([("a", "created", "http://x"), ("b", "created", None)], "name string, status string, download_url string")
    table.insert(rows)
    table.insert(spark.createDataFrame([("c", "ready")], "name string, status string"))
    got = table.read()
    assert got.count() == 3 and got.where("modifiedAt is null or length(_id) <> 24").isEmpty()
    a = C.find_by_name(got, "a").first()
    assert a.download_urls == ["http://x"]
    table.update(spark.createDataFrame([(a["_id"], None, 7)], "_id string, title string, size long"))
    again = C.find(table.read(), a["_id"]).first()
    assert (again["size"], again["title"], again["name"]) == (7, None, "a") and again["modifiedAt"] > a["modifiedAt"]
    assert table.update_status_many("created", "downloaded") == 2
    assert table.update_status_many("created", "downloaded") == 0
    assert table.delete(a["_id"]) and not table.delete(a["_id"])
    assert table.read().count() == 2


def test_submitted_tags(spark):
    rows = spark.createDataFrame([("a,b,,",), ("",), (",,",), (None,), ("a,,b",)], "tags string")
    got = [r.t for r in rows.select(C._tag_list(F.col("tags")).alias("t")).collect()]
    assert got == [["a", "b"], [""], None, None, ["a", "", "b"]]


def test_links(spark):
    urls = ["https://drive.google.com/open?id=A&x=1", "https://drive.google.com/file/d/B/view?id=C", "https://drive.google.com/x",
            "https://onedrive.live.com/file/d/ Z ", "https://www.dropbox.com/s/q/f.zip?dl=0", "ftp://h/f", "https://dropbox.com/"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select(
        "i", L.direct_download_url(F.col("u")).alias("d")).orderBy("i").collect()
    assert [r.d.url for r in rows] == [
        "https://docs.google.com/uc?export=download&id=A", "https://docs.google.com/uc?export=download&id=C", None,
        "https://onedrive.live.com/download?cid=Z", "https://www.dropbox.com/s/q/f.zip?dl=1", "ftp://h/f", None]
    assert rows[2].d.error == "Cannot parse link: https://drive.google.com/x"
    names = spark.createDataFrame([("http://h/a/b.csv", None), ("http://h/a?x", None), ("http://h/a", "attachment; filename='q r.zip'; z"), ("s3://x/y", None)],
                                  "u string, h string").select(L.filename_of(F.col("u"), F.col("h")).alias("f")).collect()
    assert names[0].f.filename == "b.csv" and names[1].f.filename.startswith("part-") and names[2].f.filename == "q r.zip"
    assert names[3].f.filename is None and names[3].f.error.startswith("Unsupported protocol")
