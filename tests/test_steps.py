"""Chains of steps and the export analysis: literal cases."""

import pytest
from pyspark.sql import functions as F

from quire.operators import export, steps

PAGE = "doc_id long, page_no int, text string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, i, f"page {i} of one") for i in range(4)] + [(2, 0, None)], PAGE)


def jobs(spark):
    return set(spark.sparkContext.statusTracker().getJobIdsForGroup())


def test_a_chain_is_one_lazy_query(spark, df):
    before = jobs(spark)
    chain = steps.compiled([("replace", {"term": "one", "by": "two"}), ("delete", {"page": 0}), ("move", {"page": 0, "by": 1}), ("redact", {"term": "PAGE", "match_case": False})])
    out = chain(df)
    assert jobs(spark) == before
    assert [(r["page_no"], r["text"]) for r in out.where("doc_id = 1").orderBy("page_no").collect()] == [(0, "████ 2 of two"), (1, "████ 1 of two"), (2, "████ 3 of two")]


@pytest.mark.parametrize(("chain", "says"), [
    ([], "no steps"), ([("repair", {}), ("fly", {})], "step 2: no tool"), ([("delete", {})], "step 1 (delete): missing"), ([("delete", {"page": 1, "x": 2})], "unexpected"), ([("delete", {"page": "1"})], "page can't be '1'"), ([("choose", {"pages": [1, "2"]})], "pages can't be"), ([("delete", {"page": True})], "can't be True"), ([("find", {"term": None})], "term can't be None"),
])
def test_bad_steps_fail_before_any_job(spark, chain, says):
    before = jobs(spark)
    with pytest.raises(steps.BadStep) as error:
        steps.compiled(chain)
    assert says in str(error.value) and jobs(spark) == before


def test_columns_that_are_missing(spark, df):
    chain = steps.compiled([("count", {"term": "one"}), ("redact", {"term": "x"})])
    with pytest.raises(steps.BadStep, match=r"step 2 \(redact\)"):
        chain(df)


def test_run_with_progress(spark, df, tmp_path):
    seen = []
    path = f"file://{tmp_path}/out"
    out = steps.run(df.repartition(3), steps.compiled([("repair", {})]), path, lambda done, known: seen.append((done, known)), every=0.01)
    assert out.count() == 5 and seen[-1][0] == seen[-1][1] > 0 and all(a[0] <= b[0] for a, b in zip(seen, seen[1:], strict=False))
    with pytest.raises(FileExistsError):
        steps.run(df, steps.compiled([("repair", {})]), path)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out"]


def test_cancelled_and_failed_runs_leave_nothing(spark, df, tmp_path):
    slow = F.udf(lambda t: __import__("time").sleep(30), "string")
    with pytest.raises(steps.Cancelled):
        steps.run(df.repartition(4), lambda d: d.withColumn("text", slow("text")), f"file://{tmp_path}/a", lambda done, known: known == 0, every=0.05)
    with pytest.raises(Exception, match="(?i)divi"):
        steps.run(df, lambda d: d.withColumn("n", F.expr("raise_error('divided')")), f"file://{tmp_path}/b")
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == []


def test_routes_and_summary(spark):
    """A picture between two flows cuts a section, and so do a size and a kind of numbering; an empty page is a picture that isn't reported."""
    span = lambda t, size=12.0, font="Arial": (t, size, font, 0, 0)
    texts = {0: ["- i -", "front"], 1: ["- ii -", "front"], 2: ["Page 3", "text"], 3: [""], 4: ["Page 5", "text"], 5: ["text"], 7: ["big"], 8: ["text"]}
    lines = [(1, p, 0, n, 100.0, 10.0 + n * 300, 300.0, 22.0 + n * 300, 1.0, 0.0, [span(t, 40.0 if t == "big" else 12.0)]) for p, own in texts.items() for n, t in enumerate(own)]
    lines = spark.createDataFrame(lines, "doc_id long, page_no int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, dx double, dy double, spans array<struct<text:string,size:double,font:string,flags:int,color:int>>")
    pages = spark.createDataFrame([(1, p, 700.0 if p == 5 else 600.0, 840.0) for p in range(9)] + [(2, 0, 600.0, 840.0)], "doc_id long, page_no int, width double, height double")
    images = spark.createDataFrame([(1, 0, 0, 7, 0.0, 0.0, 9.0, 9.0, 9, 9), (1, 1, 0, 7, 0.0, 0.0, 9.0, 9.0, 9, 9), (1, 3, 0, 8, 0.0, 0.0, 9.0, 9.0, 9, 9)], "doc_id long, page_no int, ord int, xref int, x0 double, y0 double, x1 double, y1 double, pixel_width int, pixel_height int")
    none = images.limit(0).withColumn("fill", F.array(F.lit(1.0)))
    routes = export.page_routes(pages, lines, images, none)
    found = [(r["page_no"], r["route"], r["reported"], r["section"]) for r in routes.where("doc_id = 1").orderBy("page_no").collect()]
    assert found == [(0, "flow", False, 0), (1, "flow", False, 0), (2, "flow", False, 1), (3, "picture", True, 2), (4, "flow", False, 3), (5, "flow", False, 4), (6, "picture", False, 5), (7, "pinned", False, 6), (8, "flow", False, 7)]
    renames = spark.createDataFrame([(1, "Arial", "Sarabun", True)], "doc_id long, family string, rename string, reject boolean")
    total = {r["doc_id"]: r for r in export.export_summary(routes, lines, images, renames).collect()}
    assert (total[1]["pages"], total[1]["sections"], total[1]["picture_pages"], total[1]["pinned_pages"], total[1]["images"], total[1]["fonts"]) == (9, 8, [4], 1, 3, ["Sarabun Regular"])
    assert (total[2]["pages"], total[2]["picture_pages"], total[2]["images"], total[2]["fonts"]) == (1, [], 1, [])
    kept = export.page_routes(pages, lines, images, none, keep_layout=True)
    assert {r["route"] for r in kept.collect()} == {"picture", "pinned"}
