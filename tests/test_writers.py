"""Run folders, reports, answers, progress, pages and statistics of the library."""

import json

import pytest
from pyspark.sql import functions as F

from murmura.engine import Engine
from murmura.errors import QueryError, answer
from murmura.functions import listings, times
from murmura.functions import text as X
from murmura.operators import items, labels
from murmura.operators.items import Filters
from murmura.plans import records
from murmura.plans.study import Study
from murmura.sources import export, runs, writer
from murmura.streaming.ingest import Ingest


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.of_parquet(spark, "/root/testdata/sf0.001")


def test_run_folder_is_whole_after_every_record(spark, tmp_path):
    root = str(tmp_path)
    run = writer.RunFolder(spark, root, "Garden Hose!", {"scope": "global", "browser_utc_offset_minutes": 60})
    assert run.run["run_id"].startswith("garden-hose_") and json.loads((tmp_path / run.document.removeprefix(root + "/")).read_text())["run"]["status"] == "running"
    for k in range(3):
        run.add({"id": f"r_{k}", "kind": "group_post", "text": f"The garden hose number {k} leaks a lot", "post_url": f"https://www.facebook.com/groups/7/posts/{k}/", "language": "en", "captured_at": "2026-03-01T10:00:00Z"})
        assert len(json.loads(open(run.document).read())["results"]) == k + 1
    run.count(skipped_job=2, skipped_not_posts=5)
    run.warn("slow")
    run.warn("slow")
    run.finish()
    other = writer.RunFolder(spark, root, "garden hose", {})
    assert other.path != run.path
    other.finish("failed", {"code": "blocked", "message": "m", "hint": None})
    found = {r.run_id: r for r in runs.document_summaries(runs.documents(spark, root), max_records=2).collect()}
    mine = found[run.run["run_id"]]
    assert (mine.ok, mine.status, mine.records_truncated, mine.filtered_out, mine.warnings, len(mine.records)) == (True, "completed", 1, {"job": 2}, ["slow"], 2)
    assert mine.records[0].asDict().keys() == set(runs.COMPACT) and mine.records[0].language == "en" and mine.stats["saved"] == 3
    assert found[other.run["run_id"]].error.code == "blocked" and not found[other.run["run_id"]].ok
    one = Engine.of_runs(spark, root, run=run.path.removeprefix(root + "/"))
    assert one.tables.runs.count() == 1 and one.count(include_types="all") == 3


def test_import_totals(spark, tmp_path):
    run = writer.RunFolder(spark, str(tmp_path), "hose", {})
    for k in (1, 1, 2, 3):
        run.add({"id": f"r_{k}", "kind": "group_post", "text": f"The garden hose number {k} leaks a lot", "post_url": f"https://www.facebook.com/groups/7/posts/{k}/"})
    (tmp_path / "hose" / "broken").mkdir()
    (tmp_path / "hose" / "broken" / "results.json").write_text("{")
    docs = runs.documents(spark, str(tmp_path))
    every = runs.record_rows(docs)
    out = spark.createDataFrame([(run.run["run_id"], "r_3")], "run_id string, record_id string")
    kept = labels.without_excluded(every, out)
    from murmura.operators import entity

    totals = runs.import_totals(docs, every, every.join(out, ["run_id", "record_id"], "left_semi"), entity.resolved(kept)["outcomes"]).first()
    assert tuple(totals) == (1, 4, 2, 0, 1, 1, 1)


def test_batch_report(spark, tmp_path):
    report = writer.BatchReport(spark, str(tmp_path), "My study", {"name": "My study"}, 3)
    assert report.add("hose", "global", None, {"ok": True, "run_dir": "a", "stats": {"saved": 2}})
    assert not report.add("pump", "group", "g", {"ok": False, "error": {"code": "blocked", "message": "wait"}})
    done = report.finish()
    stored = json.loads(open(done["report_file"]).read())
    assert not done["ok"] and stored["status"] == "stopped" and stored["searches_done"] == 2 and stored["runs"][1]["error"] == "blocked" and stored["stopped_reason"].startswith("blocked")


def test_answers():
    assert answer(lambda: {"n": 1}) == {"ok": True, "n": 1}

    def fails(error):
        raise error

    for error, code in ((FileNotFoundError("x"), "no_dataset"), (ValueError("x"), "invalid_argument"), (QueryError("not_found", "x"), "not_found"), (QueryError("odd", "x"), "failed")):
        got = answer(fails, error)
        assert (got["ok"], got["error"], got["message"]) == (False, code, "x") and "hint" in got
    with pytest.raises(TypeError):
        answer(fails, TypeError("x"))


def test_progress_of_a_stream(spark, tmp_path):
    run = writer.RunFolder(spark, str(tmp_path / "runs"), "hose", {})
    run.add({"id": "r_1", "kind": "group_post", "text": "The garden hose leaks a lot", "captured_at": "2026-03-01T10:00:00Z"})
    told = []
    Ingest(spark, str(tmp_path / "state"), parts=2).run(str(tmp_path / "runs"), lambda message, n: told.append((message, n)))
    assert Ingest(spark, str(tmp_path / "state"), parts=2).read("items").count() == 1


def test_pages_are_clamped(engine):
    assert items.clamped(None, 500) == 500 and items.clamped(0, 500) == 1 and items.clamped(9000, 500) == 500 and items.clamped(-3, 50) == 1 and items.clamped(7, 50) == 7
    assert engine.label_queue(1000).count() <= items.MOST_PAIRS
    page = engine.items(limit=5, include_types="all")
    assert page.count() == 5
    whole = items.with_details(engine.tables, engine.tables.items).select("item_id", "keywords", "sentiment")
    assert page.select("item_id", "keywords", "sentiment").exceptAll(whole).isEmpty()


def test_statistics_come_from_one_pass(engine):
    f = Filters(include_types="all")
    got = items.statistics(engine.tables, f)
    every = items.filtered(engine.tables, f)
    for name, want in (("by_kind", items.facet(every, "kind")), ("by_language", items.facet(every, "language")), ("by_month", items.by_month(every)), ("top_groups", items.facet(every.where("group_name is not null"), "group_name", 10)), ("totals", items.totals(every))):
        assert [tuple(r) for r in got[name].select(want.columns).collect()] == [tuple(r) for r in want.collect()], name
    none = items.statistics(engine.tables, Filters(keyword="no such keyword"))
    assert none["totals"].first()["items"] == 0 and none["by_kind"].count() == 0


def test_study_description():
    study = Study.from_dict({"name": "s", "keywords": ["a", "b"], "include_marketplace": True})
    told = study.described()
    assert told["searches"] == 4 and told["plan"][1] == {"keyword": "a", "scope": "marketplace"} and told["estimated_minutes"] == study.estimated_minutes() == 24


def test_moments_without_a_zone_are_utc(spark):
    rows = spark.createDataFrame([("2026-03-01T10:00:00",), ("2026-03-01T10:00:00Z",), ("2026-03-01T15:00:00+05:00",), ("soon",), (None,)], "t string")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Karachi")
        got = [r[0] for r in rows.select(times.utc_second(F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1772359200] * 3 + [None, None]


def test_own_text_of_a_post(spark):
    row = spark.createDataFrame([("Ann Lee\nMy own words\nOld shared text\nBob\nA comment here", ["A comment here", "Old shared text"], ["Ann Lee", "Bob"])], "t string, n array<string>, a array<string>")
    assert row.select(X.body_text(F.col("t"), F.col("n"), F.col("a"))).first()[0] == "My own words"
    assert row.select(X.body_text(F.col("t"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"))).first()[0].startswith("Ann Lee")


def test_listing_language_is_found_anew(spark):
    records_ = spark.createDataFrame([("u", "Hose", "und", None, None, None, None, None)], "post_url string, text string, language string, condition string, location string, author_name string, author_url string, time_text string")
    pages = spark.createDataFrame([("u", "Details\nThis is the best hose that you can buy for your garden", None, None)], "post_url string, page_text string, seller_name string, seller_url string")
    assert listings.with_details(records_, pages).first().language == "en"


def test_exports_are_parted_unless_asked_for(engine, tmp_path):
    export.export(items.with_details(engine.tables, engine.tables.items.repartition(3)), str(tmp_path / "a"), "jsonl")
    export.export(items.with_details(engine.tables, engine.tables.items.repartition(3)), str(tmp_path / "b"), "jsonl", single=True)
    assert len(list((tmp_path / "b").glob("part-*"))) == 1
    assert export.default_path("/x", "csv", "Garden Hose").startswith("/x/_exports/items_garden-hose_")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("items", "sightings", "runs", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", list(records.QUERIES))
def test_queries_take_empty_tables(spark, empty, name):
    assert len(records.QUERIES[name](spark, empty).collect()) <= 1
