"""Survivors of duplicate groups and batch-wise deduplication, against brute force."""

import random

import pytest

from murmura.llm import history, survivors

RUNS = "run_id string, started_at string, finished_at string, imported_at string, x string"
ITEMS = "item_id string, content_key string, text string, time_exact string, image_text string, last_seen string, url_key string, d_text string, _n string"
FULL = "The hose came loose last week and the seller never answered my calls. I want my money back now."


@pytest.fixture
def runs(spark):
    return spark.createDataFrame([("r1", "2026-01-01T00:00:00Z", None, "2026-06-01T00:00:00Z", ""), ("r2", None, None, None, "")], RUNS)


def test_best_values(spark, runs):
    rows = [
        ("a", "k", FULL[:40] + "… See more", "31 February 2026 at 10:00", "May be an image", "2038-01-19T03:14:07Z", None),
        ("b", "k", FULL, "May be an image of a roof", "May be an image of text that says 'Big sale'", "2026-03-01T10:00:00+05:00", None),
        ("c", "k", FULL + "\nLike\nShare", "5 March 2026 at 10:00", "May be an image of text that says 'Big sa…", "2026-03-01T06:00:00", "url:/x/"),
        ("d", "k", FULL[:50] + "�" * 30, None, None, "Sun, 01 Mar 2026 05:30:00 +0000", None),
        ("e", "cut", FULL[:50], None, "", None, None), ("f", "cut", FULL[:50] + "�" * 60, "", None, "9999-01-01 00:00:00", None),
        ("g", "one", FULL, None, None, None, None), ("h", None, FULL, None, None, None, None), ("i", None, FULL, None, None, None, None),
        ("j", "tie", FULL, None, None, None, None), ("k", "tie", FULL, None, None, None, None), ("k", "tie", FULL, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ITEMS)
    got = {(r.content_key, r.field_name): r.item_id for r in survivors.survivors(df, runs).collect()}
    assert got == {("k", "text"): "b", ("k", "time_exact"): "c", ("k", "image_text"): "b", ("k", "last_seen"): "c", ("tie", "text"): "j"}
    made = {r.content_key: r for r in survivors.surviving_records(df, runs).collect()}
    assert made["k"].text == FULL and made["tie"].last_seen is None
    assert survivors.survivors(df.limit(0), runs).count() == 0 and survivors.survivors(df, runs.limit(0)).count() == 5  # the year 9999 is no date


@pytest.mark.parametrize(
    ("text", "broken"),
    [("Is it working???", False), ("Really???? I paid", False), ("What?? Why??", False), ("split u??? ?? ????", True), ("my ???? broke", True), ("caf??s here", True), ("caf\ufffd", True), ("?????", False), ("", False), (None, False)],
)
def test_questions_are_no_damage(text, broken):
    assert (survivors.text_state(text)[2] >= 0) is broken


def test_later_layers_fill_what_the_first_leaves_null(spark, runs):
    quote = "May be an image of text that says 'Sale'"
    rows = [
        ("a", "k", FULL, None, quote, "2026-03-01T10:00:00Z", "url:/x/"), ("b", "k", FULL[:60] + "…", "5 March 2026 at 10:00", None, "2026-02-01T10:00:00Z", None), ("c", "k", FULL[:60] + "…", "5 March 2026 at 10:00", None, "2026-01-05T10:00:00Z", None),
        ("d", "k", None, "5 March 2026 at 10:00", None, None, "url:/photo/?fbid=1"),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ITEMS)
    got = {r.field_name: r.item_id for r in survivors.survivors(df, runs).collect()}
    # Only dominated rows state a time; of their own skyline (b by recency, d by trust) the more trusted one gives it.
    assert got == {"text": "a", "image_text": "a", "last_seen": "a", "time_exact": "d"}


def test_layers_equal_brute_force(spark, runs, monkeypatch):
    rng = random.Random(9)
    rows = []
    for k in range(300):
        rows.append((f"i{k:03}", f"k{k % 12}", rng.choice([None, FULL, FULL + " And more of it.", FULL[:50] + "…"]), rng.choice([None, None, "5 March 2026 at 10:00"]), rng.choice([None, "May be text that says 'A'", "May be text that says 'A b'"]), rng.choice([None, f"2026-02-{rng.randrange(1, 28):02}T10:00:00Z"]), rng.choice([None, "url:/photo/?fbid=1", "url:/x/"]), "", ""))
    df = spark.createDataFrame(rows, ITEMS)

    longest = {key: max(len(r[2] or "") for r in rows if r[1] == key) for key in {r[1] for r in rows}}

    def vector(r):  # a text shorter than another of its group is not complete
        return (len(r[2]) if r[2] and "…" not in r[2] and len(r[2]) == longest[r[1]] else -1, survivors.quote_length(r[4]), r[5] or "", 0 if not r[6] else 1 if "photo" in r[6] else 2)

    want = set()
    for key in {r[1] for r in rows}:
        left, missing = [r for r in rows if r[1] == key], {"text": 0, "time_exact": None, "image_text": 1, "last_seen": 2}
        held = {"text": lambda r: vector(r)[0] >= 0, "time_exact": lambda r: r[3], "image_text": lambda r: vector(r)[1] >= 0, "last_seen": lambda r: r[5]}
        while left and missing:
            layer = [r for r in left if not any(all(a >= b for a, b in zip(vector(o), vector(r), strict=True)) and vector(o) != vector(r) for o in left)]
            for f in [f for f in missing if any(held[f](r) for r in layer)]:
                q = missing.pop(f)
                v = [(vector(r), r) for r in layer if held[f](r)]
                best = max((d[q] if q is not None else 0, d[3], d[2], d[0], d[1]) for d, _ in v)
                want.add((key, f, min(r[0] for d, r in v if (d[q] if q is not None else 0, d[3], d[2], d[0], d[1]) == best)))
            left = [r for r in left if r not in layer and any(held[f](r) for f in missing)]
    for salt in (5000, 4):
        monkeypatch.setattr(survivors, "SALT_ROWS", salt)
        assert {tuple(r) for r in survivors.survivors(df, runs).collect()} == want


def test_salted_groups_give_the_same(spark, runs, monkeypatch):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        text = rng.choice([None, FULL, FULL[: rng.randrange(20, 60)] + "…", FULL + " " + "More text here." * rng.randrange(3)])
        when = rng.choice([None, f"{rng.randrange(1, 28)} March 2026 at 10:{rng.randrange(60):02}"])
        rows.append((f"i{k:03}", rng.choice(["hot", "hot", "hot", "cold"]), text, when, rng.choice([None, f"May be an image that says '{'x' * rng.randrange(1, 9)}'"]), rng.choice([None, f"2026-02-{rng.randrange(1, 28):02}T10:00:00Z"]), None, "", ""))
    df = spark.createDataFrame(rows, ITEMS)
    plain = sorted(map(tuple, survivors.survivors(df, runs).collect()))
    monkeypatch.setattr(survivors, "SALT_ROWS", 20)
    assert sorted(map(tuple, survivors.survivors(df, runs).collect())) == plain
    best = max((r for r in rows if r[1] == "hot" and r[4]), key=lambda r: len(r[4]))
    picked = next(p[2] for p in plain if p[:2] == ("hot", "image_text"))
    assert len(next(r for r in rows if r[0] == picked)[4]) == len(best[4])


FIELDS = "item_id string, first_run_id string, url_key string, content_key string, kind string, group_url string, parent_post_url string, author_name string, text string, class string"


@pytest.mark.parametrize(
    ("key", "post"),
    [
        ("url:/groups/1/posts/22/", "p:22"), ("url:/Groups/1/Posts/22", "p:22"), ("url:/groups/1/?multi_permalinks=22", "p:22"), ("url:/permalink.php?story_fbid=22&id=1", "p:22"), ("comment:5", "c:5"), ("comment:22_5", "c:5"),
        ("comment:Y29tbWVudDoyMl81", "c:5"), ("url:/photo/?fbid=9", None), (None, None), ("", None),
    ],
)
def test_post_ids(key, post):
    assert history.post_id(key) == post


def texts(rng):
    words = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in "nrst"]
    pool = [f"{' '.join(rng.choices(words, k=9)).capitalize()}." for _ in range(80)]
    return [" ".join(rng.sample(pool, rng.randrange(1, 6))) for _ in range(25)]


def brute(rows):
    """All pairs by the definition, every row with every other."""
    out, facts = set(), []
    for r in rows:
        scope = history.scope_of(r[4], r[5], r[6])
        parts = history.paragraphs(r[8])[1].tolist() if scope else []
        facts.append((history.post_id(r[2]), scope, history.author_of(r[7]), r[3], set(parts), sum(p >> 25 for p in parts)))
    for x, (px, sx, ax, cx, bx, nx) in zip(rows, facts, strict=True):
        for y, (py, sy, ay, cy, by, ny) in zip(rows, facts, strict=True):
            if x[0] >= y[0] or x[1] == y[1]:
                continue
            common = sum(p >> 25 for p in bx & by) >= history.COVER * max(nx, ny, 1)
            near = sx is not None and sx == sy and not (px and py) and (not ax or not ay or ax == ay) and ((cx and cx == cy) or common)
            if (px and px == py) or near:
                out.add((x[0], y[0]))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_pairs_equal_brute_force(spark, batches):
    rng = random.Random(4)
    pool, rows = texts(rng), []
    for k in range(220):
        text = rng.choice([None, "", "ok", *pool, *pool])
        if text and rng.random() < 0.3:
            text = f"Up! {text[:-8]}x{text[-8:]}"
        kind = rng.choice(["group_post", "group_post", "comment"])
        key = rng.choice([None, None, f"url:/groups/1/posts/{rng.randrange(40)}/", f"url:/photo/?fbid={k}"]) if kind != "comment" else rng.choice([None, f"comment:{rng.randrange(40)}"])
        rows.append((f"i{k:03}", f"r{rng.randrange(9)}", key, rng.choice([None, None, f"ck_{rng.randrange(20)}"]), kind, rng.choice([None, "https://x.example/groups/1/", "https://x.example/groups/2/"]), rng.choice([None, "https://x.example/groups/1/posts/7/"]), rng.choice([None, "Ann Lee", "Ann Lее", "Bob", "Online status indicator"]), text, "clash"))
    df = spark.createDataFrame(rows, FIELDS)
    runs = spark.createDataFrame([(f"r{k}", f"2026-01-{k + 1:02}T00:00:00Z") for k in range(9)], "run_id string, imported_at string")
    got = [tuple(r) for r in history.repeated_posts(df, runs, batches).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert history.repeated_posts(df.limit(0), runs, 1).count() == 0
    # The form by classes says the same.
    of = {r.item_id: r["class"] for r in history.classes(df, runs, batches).collect()}
    assert set(of) == {r[0] for r in rows}
    links = {tuple(r) for r in history.class_links(df, runs, batches).collect()}
    run = {r[0]: r[1] for r in rows}
    assert {(x, y) for x in of for y in of if x < y and run[x] != run[y] and ((of[x], of[y]) in links or (of[y], of[x]) in links)} == set(got)
    assert spark.catalog.listTables() == [] or not [t for t in spark.catalog.listTables() if t.name.startswith("history_")]


def test_copies_in_salted_classes(spark, monkeypatch):
    monkeypatch.setattr(history, "MEMBERS_PER_SALT", 5)
    rows = [(f"i{k:02}", f"r{k % 4}", None, None, "group_post", "https://x.example/groups/1/", None, None, "The very same text in many copies.", "") for k in range(30)]
    df = spark.createDataFrame(rows, FIELDS)
    runs = spark.createDataFrame([("r0", "2026-01-01T00:00:00Z")], "run_id string, imported_at string")
    assert {tuple(r) for r in history.repeated_posts(df, runs, 2).collect()} == brute(rows)


SHORT_SENTENCES = ["Rs 4500. Call 03001234567. Solar panel for sale in good condition.", "Price please? Thank you! Inbox me.", "Yes sure. Still new. Price please? Thank you! Inbox me."]


@pytest.mark.parametrize("batches", [1, 2])
def test_texts_of_short_sentences_without_an_author(spark, batches):
    rows = [(f"i{k}{n}", f"r{n}", None, None, "group_post", f"https://x.example/groups/{k}/", None, name, text, "") for k, text in enumerate(SHORT_SENTENCES) for n, name in enumerate(["Ann Lee", None])]
    rows.append(("i20", "r2", None, None, "group_post", "https://x.example/groups/2/", None, None, SHORT_SENTENCES[2].replace("new", "sealed"), ""))
    df = spark.createDataFrame(rows, FIELDS)
    runs = spark.createDataFrame([(f"r{k}", f"2026-01-{k + 1:02}T00:00:00Z") for k in range(3)], "run_id string, imported_at string")
    assert {tuple(r) for r in history.repeated_posts(df, runs, batches).collect()} == brute(rows)


def test_small_edits_leave_most_paragraphs(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in "nrst"]
    rows, edits = [], 0
    for k in range(300):
        text = rng.choices(words, k=rng.randrange(30, 70))
        for n in range(9, len(text), 10):
            text[n] += "."
        edited = ["Again:", *text]
        for n in rng.sample(range(1, len(edited) - 1), rng.randrange(1, 4)):
            edited[n] += "x"
        for n, (line, author) in enumerate([(text, "Ann Lee"), (edited, rng.choice(["Ann Lee", None]))]):
            rows.append((f"i{k:03}{n}", f"r{n}", None, None, "group_post", f"https://x.example/groups/{k % 7}/", None, author, " ".join(line), ""))
        edits += (f"i{k:03}0", f"i{k:03}1") in brute(rows[-2:])
    rows += [("j0", "r0", None, None, "group_post", "https://x.example/groups/0/", None, None, "Disconnectedly", ""), ("j1", "r1", None, None, "group_post", "https://x.example/groups/0/", None, None, "Reestablishments", "")]
    runs = spark.createDataFrame([(f"r{k}", f"2026-01-{k + 1:02}T00:00:00Z") for k in range(2)], "run_id string, imported_at string")
    want = brute(rows)
    assert edits > 290 and {tuple(r) for r in history.repeated_posts(spark.createDataFrame(rows, FIELDS), runs, 2).collect()} == want


def test_paragraphs_of_odd_texts():
    assert history.paragraphs(None)[0] is None and len(history.paragraphs("Ok. 12!")[1]) == 0
    long = " ".join(f"w{k}" for k in range(5000))
    parts = history.paragraphs(long)[1]
    assert sum(int(p) >> 25 for p in parts) == 5000 and max(int(p) >> 25 for p in parts) <= history.LONGEST
    cut = " ".join("same" for _ in range(500))  # no word of it ends a paragraph, or every one does
    assert 1 <= len(history.paragraphs(cut)[1]) <= 2
    assert history.paragraphs("The Pump. is old, very old")[0] == history.paragraphs("the pump is OLD very old")[0]


@pytest.mark.parametrize("batches", [2, 4, 8])
def test_a_batch_reads_what_it_meets(spark, batches):
    """The parts of the history that a batch reads go by the batch's keys, however many batches came before."""
    with history.History(spark, buckets=2, slots=64) as h:
        for n in range(batches):
            rows = [(f"i{n}{k}", f"r{n}", f"url:/groups/1/posts/{n}{k}/", None, "group_post", None, None, None, None, "") for k in range(30 if n < batches - 1 else 3)]
            h.accept(spark.createDataFrame(rows, FIELDS))
        last = h.keys().where(f"batch = {batches - 1}")
        met = h._part("keys", "key", last).where(f"batch < {batches - 1}")
        assert last.count() == 3 and len({f.split("slot=")[1].split("/")[0] for f in met.inputFiles()}) <= 3
        assert h.keys().count() == 30 * (batches - 1) + 3
