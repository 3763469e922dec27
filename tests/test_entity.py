"""Entity resolution against a plain sequential import, and a two-run scenario end to end."""

import json
import random

import pytest

from murmura.engine import Engine
from murmura.operators import entity
from murmura.sources import export, runs
from murmura.streaming.ingest import Ingest


def sequential(rows):
    """One record after the other, looking everything up in a list."""
    items, seen, out = [], {}, []
    weak = lambda k: bool(k) and k.startswith("url:/photo")
    for seq, record, url, content, author in rows:
        item = seen.get(record)
        if item is None and url:
            item = next((i for i in items if i["url"] == url), None)
        if item is None and content:
            item = next((i for i in items if i["content"] == content and (not i["url"] or not url or i["url"] == url or weak(i["url"]) or weak(url)) and (not i["author"] or not author or i["author"] == author)), None)
        if item is None:
            item = {"n": len(items), "url": None, "content": None, "author": None}
            items.append(item)
        if url and (not item["url"] or (weak(item["url"]) and not weak(url))) and not any(i is not item and i["url"] == url for i in items):
            item["url"] = url
        item["content"] = item["content"] or content
        item["author"] = item["author"] or author
        seen[record] = item
        out.append((seq, item["n"]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_fold_like_a_sequential_import(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(250):
        url = rng.choice([None, f"url:/p/{rng.randrange(60)}/", f"url:/photo/?fbid={rng.randrange(30)}"])
        rows.append((k, f"r|{rng.randrange(200)}", url, rng.choice([None, f"ck_{rng.randrange(70)}"]), rng.choice(["", "a", "b"])))
    df = spark.createDataFrame([(s, "r", rec.split("|")[1], u, c, a) for s, rec, u, c, a in rows], "seq bigint, run_id string, record_id string, url_key string, content_key string, author_name string")
    got = {r.seq: r.item_id for r in entity.assigned(df).collect()}
    groups = {}
    for seq, n in sequential([(s, rec, u, c, a or None) for s, rec, u, c, a in rows]):
        groups.setdefault(n, set()).add(got[seq])
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


SITE = "https://www.facebook.com"


def record(i, text, url, **more):
    return {"id": f"r_{i}", "kind": "group_post", "keyword": "garden hose", "text": text, "post_url": url, "group_url": f"{SITE}/groups/77/", "captured_at": f"2026-03-0{more.pop('day', 1)}T10:00:00Z", **more}


@pytest.fixture
def root(tmp_path):
    long = "The garden hose broke after two weeks and nobody answers"
    first = [
        record(1, long, f"{SITE}/groups/77/permalink/pfbid01/", time_text="2d"),
        record(2, "Another post about the garden hose in my yard", f"{SITE}/groups/77/posts/5/"),
        record(3, "Photo of a garden hose on the wall of the house", f"{SITE}/photo/?fbid=9&set=pcb.6", kind="photo"),
    ]
    second = [
        record(1, long + ", so I want my money back", f"{SITE}/groups/77/permalink/pfbid02/", author_name="Ann", time_exact="1 March 2026 at 09:00", day=2) | {"text": long},
        record(2, "Another post about the garden hose in my yard", f"{SITE}/groups/77/?multi_permalinks=5", day=2, author_name="Online status indicator"),
        record(3, "Another post about the garden hose in my yard", f"{SITE}/groups/77/posts/8/", day=2, author_name="Bob"),
    ]
    for stamp, results in (("20260301-100000", first), ("20260302-100000", second)):
        folder = tmp_path / "runs" / "garden-hose" / stamp
        folder.mkdir(parents=True)
        run = {"run_id": f"garden-hose_{stamp}", "keyword": "garden hose", "status": "completed", "started_at": "2026-03-01T10:00:00Z", "browser_utc_offset_minutes": 300, "stats": {"skipped_job": 2, "skipped_not_posts": 4}}
        (folder / "results.json").write_text(json.dumps({"run": run, "results": results}))
    return tmp_path


def test_two_runs(spark, root):
    broken = root / "runs" / "garden-hose" / "20260303-100000"
    broken.mkdir()
    (broken / "results.json").write_text("{not json")
    engine = Engine.of_runs(spark, str(root / "runs"))
    items = {r.url_key or r.content_key: r for r in engine.tables.items.collect()}
    assert len(items) == 4 and engine.tables.sightings.count() == 6 and engine.tables.runs.count() == 2
    merged = next(r for r in items.values() if r.url_key is None)
    assert (merged.author_name, merged.posted_at, merged.times_seen, merged.language) == ("Ann", "2026-03-01T09:00:00+05:00", 2, "en")
    assert items["url:/groups/77/posts/6/"].kind == "group_post"
    assert items["url:/groups/77/posts/5/"].author_name is None
    assert engine.count(keyword="GARDEN hose") == 4 and engine.count(contains="yard") == 2
    page = engine.items(limit=2, text_chars=10).collect()
    assert len(page) == 2 and page[0].posted_at is not None and page[0].text == "The garden…" and page[0].keywords == ["garden hose"]
    assert engine.runs().count() == 2
    without, excluded = engine.exclude(engine.tables.items.where("url_key = 'url:/groups/77/posts/5/'"), "off topic", "2026-03-05T00:00:00Z")
    assert without.count(include_types="all") == engine.count(include_types="all") - 1 and without.tables.items.where("url_key = 'url:/groups/77/posts/5/'").isEmpty()
    assert Engine.of_runs(spark, str(root / "runs"), exclusions=excluded).tables.items.count() == 3
    with pytest.raises(ValueError, match="reason"):
        engine.exclude(engine.tables.items, " ", "")


def test_stream_equals_rebuild(spark, root):
    state = Ingest(spark, str(root / "state"))
    state.run(str(root / "runs"))
    batch = Engine.of_runs(spark, str(root / "runs"))
    columns = ["item_id", "url_key", "content_key", "author_name", "text", "posted_at", "times_seen"]
    assert sorted(map(str, state.read("items").select(columns).collect())) == sorted(map(str, batch.tables.items.select(columns).collect()))
    state.run(str(root / "runs"))
    assert state.read("sightings").count() == 6


def test_stream_of_single_files_equals_rebuild(spark, root):
    """One run file per batch: a batch renews only what its keys reach, and other items stay."""
    other = root / "runs" / "pump" / "20260304-100000"
    other.mkdir(parents=True)
    run = {"run_id": "pump_20260304-100000", "keyword": "pump", "status": "completed", "browser_utc_offset_minutes": 0}
    (other / "results.json").write_text(json.dumps({"run": run, "results": [record(1, "A pump that has nothing to do with the rest", f"{SITE}/groups/77/posts/50/")]}))
    state = Ingest(spark, str(root / "single"), parts=3)
    docs = runs.documents(spark, str(root / "runs"))
    for number, path in enumerate(sorted(r.path for r in docs.select("path").collect())):
        state.add(docs.where(docs["path"] == path), number)
    assert state.touched(2).count() == 1
    batch = Engine.of_runs(spark, str(root / "runs"))
    columns = ["item_id", "url_key", "content_key", "author_name", "text", "posted_at", "times_seen"]
    assert sorted(map(str, state.read("items").select(columns).collect())) == sorted(map(str, batch.tables.items.select(columns).collect()))
    assert state.read("sightings").count() == 7 and state.read("runs").count() == 3


def test_a_crash_between_the_tables_shows_the_state_before(spark, root, monkeypatch):
    state = Ingest(spark, str(root / "crash"), parts=3, slots=4)
    docs = runs.documents(spark, str(root / "runs"))
    first, *later = sorted(r.path for r in docs.select("path").collect())
    state.add(docs.where(docs["path"] == first), 0)

    def seen():
        return [sorted(map(str, state.read(n).collect())) for n in ("items", "sightings")]

    before = seen()
    with monkeypatch.context() as m:
        m.setattr(state, "_swap", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            state.add(docs.where(docs["path"].isin(later)), 1)
    assert seen() == before
    state.add(docs.where(docs["path"].isin(later)), 1)  # the stream takes the batch in again
    batch = Engine.of_runs(spark, str(root / "runs"))
    assert sorted(r.item_id for r in state.read("items").collect()) == sorted(r.item_id for r in batch.tables.items.collect())
    after = seen()
    state.add(docs.where(docs["path"].isin(later)), 1)
    assert seen() == after


def test_labels_and_export(spark, root):
    engine = Engine.of_runs(spark, str(root / "runs"))
    assert engine.label_queue().count() == 4
    ids = [r.item_id for r in engine.tables.items.orderBy("item_id").collect()]
    new = spark.createDataFrame(
        [(ids[0], None, "Negative", "it broke", "x", "1"), (ids[1], "GARDEN HOSE", "neutral", None, "x", "1"), (ids[1], "pump", "positive", "", "x", "1"), ("i_none", "a", "neutral", None, "x", "1"), (ids[2], "a", "angry", None, "x", "1")],
        "item_id string, keyword string, sentiment string, reason string, labeler string, labeled_at string",
    )
    labelled, rejected = engine.label_items(new)
    assert {r.error for r in rejected.collect()} == {"unknown item", "unknown sentiment"}
    assert labelled.label_queue().count() == 2 and labelled.count(sentiment="negative") == 1
    shown = {r.item_id: r.sentiment for r in labelled.items(limit=None).collect()}
    assert shown[ids[1]] == "garden hose: neutral | pump: positive" and shown[ids[0]] == "negative"
    for fmt in export.FORMATS:
        labelled.export(str(root / fmt), fmt, salt=b"s" if fmt == "csv" else None)
    raw = next((root / "csv").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfitem_id") and b"facebook.com" not in raw and b"Ann" not in raw and b",a_" in raw
    lines = [json.loads(x) for x in next((root / "jsonl").glob("*.json")).read_text().splitlines()]
    assert len(lines) == 4 and list(lines[0]) == export.ITEM_COLUMNS
    assert spark.read.parquet(str(root / "parquet")).count() == 4
    with pytest.raises(ValueError, match="format"):
        labelled.export(str(root / "x"), "xlsx")


def test_one_content_key_of_many_posts_is_folded_in_linear_time():
    import time

    def seconds(n):
        fold, began = entity._Fold(), time.perf_counter()
        for k in range(n):
            fold.add(f"r|{k}", f"url:/posts/{k}/", "ck", f"author {k % 7}")
        assert len(fold.ids) == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 40 * seconds(10_000)


def test_ids_are_unique_over_components(spark, monkeypatch):
    monkeypatch.setattr(entity, "ID_DIGITS", 2)
    rows = [(k, k, f"i_{k % 30:02x}", "new_items", True, False, f"seed {k}") for k in range(90)] + [(100 + k, k, f"i_{k % 30:02x}", "merged", False, False, f"seed {k}") for k in range(90)]
    placed = spark.createDataFrame(rows, "seq bigint, component bigint, item_id string, outcome string, sets_key boolean, key_clash boolean, seed string")
    got = entity.with_own_ids(placed).collect()
    owner = {}
    for r in got:
        assert owner.setdefault(r.item_id, r.component) == r.component
    assert len(owner) == 90 and all(r.item_id == f"i_{r.component:02x}" for r in got if r.component < 30)
