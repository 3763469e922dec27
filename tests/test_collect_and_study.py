"""Verify-then-filter, studies, side files, queries on empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from murmura.engine import Engine
from murmura.functions import content, listings
from murmura.operators import collect, labels
from murmura.plans import queries
from murmura.plans.study import Study, plan_of
from murmura.sources import side_files

CANDIDATES = "position int, url_key string, kind string, text string, full_text string, image_text string, name_text string, author_name string"


def test_verify_then_filter(spark):
    rows = [
        (1, "u1", "group_post", "My garden hose leaks", None, None, None, None), (2, "u1", "group_post", "My garden hose leaks", None, None, None, None), (3, "u2", "post", "Nothing here", "… garden hose …", None, None, None),
        (4, "u3", "post", "Look", None, "a garden-hose", None, None), (5, None, "post", "Look", None, None, "garden hose fans", None), (6, "u4", "comment", "ok", "garden hose", None, None, None),
        (7, "u5", "post", "Garden hose for sale, order now, Rs 500", None, None, None, None), (8, "u6", "unknown", "garden hose", None, None, None, None), (9, "u7", "marketplace", "Garden hose, green", None, None, None, None),
    ]
    judged = collect.judged(spark.createDataFrame(rows, CANDIDATES), "garden hose")
    got = {r.position: (r.search_rank, r.matched_in) for r in judged.collect()}
    assert got == {1: (1, "text"), 3: (2, "full_text"), 4: (3, "image_text"), 5: (4, None), 6: (5, None), 7: (6, "text"), 8: (7, "text"), 9: (8, "title")}
    assert [r.position for r in collect.kept(judged).collect()] == [1, 3, 4]
    assert [r.position for r in collect.kept(judged, "promotion,marketplace", 4).collect()] == [1, 3, 4, 7]
    assert {r.reason: r.n for r in collect.skipped(judged).collect()} == {"skipped_not_posts": 1, "skipped_unverified": 2, "skipped_promotion": 1, "skipped_marketplace": 1}
    assert collect.filtered_examples(judged).count() == 2


def test_study(spark):
    study = Study.from_dict({"name": "s", "keywords": ["Garden hose", "garden HOSE", '"pump"'], "groups": ["https://www.facebook.com/groups/7/x", "https://facebook.com/groups/7/"], "include_marketplace": True, "include_comments": True})
    plan = [(r.keyword, r.scope, r.comments) for r in study.plan(spark).orderBy("search").collect()]
    assert plan == [(k, s, s != "marketplace") for k in ("Garden hose", "pump") for s in ("global", "group", "marketplace")]
    assert study.estimated_minutes() > 0
    for wrong in ({}, {"name": "s", "keywords": []}, {"name": "s", "keywords": ["a"], "groups": ["https://x.example"]}, {"name": "s", "keywords": ["a"], "match_mode": "x"}, {"name": "s", "keywords": ["a"], "max_results": 0}, {"name": "s", "keywords": ["a"], "other": 1}, {"name": "s", "keywords": [f"k{n}" for n in range(51)]}):
        with pytest.raises(ValueError, match="."):
            Study.from_dict(wrong)


def test_side_files(spark, tmp_path):
    path = str(tmp_path / "labels.json")
    assert side_files.read_labels(spark, path).count() == 0
    log = spark.createDataFrame([("i1", "a", "neutral", None, "x", "1", [("r", "1")]), ("gone", "a", "negative", None, "x", "2", [("r", "9"), ("r", "2")]), ("lost", "a", "neutral", None, "x", "3", [])], side_files.LABELS)
    side_files.write_side_file(log, path, "labels")
    back = side_files.read_labels(spark, path)
    items = spark.createDataFrame([("i1",), ("i2",)], "item_id string")
    sightings = spark.createDataFrame([("i2", "r", "2")], "item_id string, run_id string, record_id string")
    assert sorted((r.item_id, r.sentiment) for r in labels.restored(back, items, sightings).collect()) == [("i1", "neutral"), ("i2", "negative")]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError, match="read"):
        side_files.read_exclusions(spark, str(tmp_path / "bad.json"))
    (tmp_path / "report.json").write_text(json.dumps({"searches": [{"keyword": "a", "status": "completed", "saved": 3}]}))
    assert side_files.read_report(spark, str(tmp_path / "report.json")).first().saved == 3


def test_open_and_save(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Engine.open(spark, str(tmp_path))
    Engine.of_parquet(spark, "/root/testdata/sf0.001").save(str(tmp_path))
    engine = Engine.open(spark, str(tmp_path))
    assert engine.count(include_types="all") == spark.read.parquet("/root/testdata/sf0.001/items.parquet").count()
    assert {n: df.count() for n, df in engine.statistics(include_types="all").items()}["totals"] == 1


def test_reclassified(spark):
    engine = Engine.of_parquet(spark, "/root/testdata/sf0.001")
    assert engine.reclassified(content.rules_version()).tables.items is engine.tables.items
    anew = engine.reclassified("older").tables.items
    assert anew.columns == engine.tables.items.columns and anew.where("kind = 'marketplace' and content_type <> 'marketplace'").count() == 0
    shown = engine.items(limit=3, root="/data/").where("screenshot_path is not null").first()
    assert shown.screenshot_file == f"/data/{shown.screenshot_path}"


def test_listing_details(spark):
    records = spark.createDataFrame([("u", "Hose", None, None, None, None, None), ("v", None, "new", "T", "Ann", "x", "1d")], "post_url string, text string, condition string, location string, author_name string, author_url string, time_text string")
    pages = spark.createDataFrame([("u", "Listed 2 days ago in Townville\nDetails\nCondition\nUsed\nStill fine", "Bob", "https://x.example/b")], "post_url string, page_text string, seller_name string, seller_url string")
    got = {r.post_url: r for r in listings.with_details(records, pages).collect()}
    assert (got["u"].text, got["u"].condition, got["u"].location, got["u"].author_name, got["u"].time_text) == ("Hose\nStill fine", "Used", "Townville", "Bob", "2 days ago")
    assert got["v"].text is None and got["v"].author_name == "Ann"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("items", "sightings", "runs", "labels", "exclusions", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "entity_resolution"])
def test_queries_take_empty_tables(spark, empty, name):
    rows = queries.QUERIES[name](spark, empty).collect()
    assert len(rows) <= 1  # a total has its one row


def test_facets_are_whole(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/items.parquet")
    from murmura.operators.items import facet

    assert facet(items, "language").agg(F.sum("n")).first()[0] == items.count()


def test_plans_of_long_lists_are_whole(spark):
    keywords = spark.createDataFrame([(k, f"word {k:02}") for k in range(1, 61)], "position bigint, keyword string")
    scopes = spark.createDataFrame([(k, f"scope {k:02}") for k in range(1, 53)], "position bigint, scope string")
    assert [tuple(r) for r in plan_of(keywords, scopes).collect()] == [(k, f"word {k:02}", s, f"scope {s:02}") for k in range(1, 61) for s in range(1, 53)]


def test_ranks_have_no_gaps(spark):
    from murmura.sources.runs import ranked

    rows = spark.range(1000).selectExpr("id * 7919 % 1009 as x", "id").repartition(7)
    assert [(r.x, r.position) for r in ranked(rows, ["x"]).orderBy("position").collect()] == [(x, k) for k, x in enumerate(sorted(n * 7919 % 1009 for n in range(1000)), 1)]
    assert ranked(rows.limit(0), ["x"]).count() == 0
