"""Column functions against case tables."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from murmura.functions import content, identity, listings, times, urls
from murmura.functions import text as X
from murmura.functions.language import detect_language


def one(spark, column, **values):
    fields = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    row = spark.createDataFrame([tuple(values.values()) or (1,)], fields).select(column.alias("r")).first()[0]
    return row.asDict() if hasattr(row, "asDict") else row


@pytest.mark.parametrize(
    ("keyword", "text", "mode", "ok"),
    [
        ("garden hose", "my Garden-Hose leaks", "phrase", True), ("garden hose", "a garden🌞hose", "phrase", True), ("garden hose", "#gardenhose", "phrase", True),
        ("garden hose", "garden_hose", "phrase", True), ("garden hose", "garden hoses", "phrase", False), ("garden hose", "mygarden hose", "phrase", False),
        ("#sun", "bright #sun day", "phrase", True), ("#sun", "bright sun day", "phrase", False), ("c++", "we use c++ here", "phrase", True),
        ("hose garden", "garden then hose", "all", True), ("hose garden", "garden only", "all", False), ("hose garden", "garden only", "any", True),
        ("café", "au café noir", "phrase", True), ("garden hose", "gar​den hose", "phrase", True), ("پانی", "ٹھنڈا پانی ہے", "phrase", True),
        ("garden hose", "go to the garden. Hose it down", "phrase", True), ("garden hose", None, "phrase", False), ("", "anything", "phrase", False),
    ],
)
def test_match_keyword(spark, keyword, text, mode, ok):
    found = one(spark, X.match_keyword(keyword, F.col("t"), mode), t=text)
    assert found["ok"] is ok
    assert (found["snippet"] is not None) is ok


def test_snippet_and_partial_terms(spark):
    found = one(spark, X.match_keyword("hose", F.col("t"), context=5), t="🌞🌞 the long garden hose was green and old")
    assert found["snippet"] == "…rden hose was …"
    assert one(spark, X.match_keyword("hose pump", F.col("t"), "all"), t="a hose")["matched_terms"] == ["hose"]
    with pytest.raises(ValueError, match="mode"):
        X.keyword_terms("x", "fuzzy")


@pytest.mark.parametrize(
    ("raw", "cleaned"),
    [("Good fan See more", "Good fan"), ("a\nFacebook\nb", "a\nb"), ("line one See less…\nline two", "line one\nline two"), ("I see more here", "I see more here"), ("", ""), ("  x  ", "x")],
)
def test_clean_text(spark, raw, cleaned):
    assert one(spark, X.clean_text(F.col("t")), t=raw) == cleaned


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("The pump is not working and we need help", "en"), ("Yeh pump bilkul kaam nahi kar raha hai", "ur-Latn"), ("Ang ganda ng pump na ito po", "tl"),
        ("پانی کا پمپ خراب ہے", "ur"), ("المضخة لا تعمل", "ar"), ("پمپ گرم", "fa"), ("पंप खराब है", "hi"), ("পাম্প", "bn"), ("насос сломан", "und"), ("123 🌞", "und"), ("#pump #sun", "und"),
        ("The pump was شاندار in the summer and it is good", "en"), (None, "und"), ("", "und"), ("solar panels ko regular cleaning ki need", "ur-Latn"),
    ],
)
def test_detect_language(spark, text, code):
    assert one(spark, detect_language(F.col("t")), t=text) == code


def moment(spark, column, **values):
    got = one(spark, F.struct(F.date_format(F.timestamp_seconds(column["minute"] * 60), "yyyy-MM-dd HH:mm").alias("at"), column["precision"].alias("p")), **values)
    return None if got["at"] is None else (got["at"], got["p"])


@pytest.mark.parametrize(
    ("text", "at"),
    [
        ("Friday 6 November 2026 at 21:07", ("2026-11-06 21:07", "minute")), ("Tuesday, February 17, 2026 at 8:33 PM", ("2026-02-17 20:33", "minute")), ("3 May 2026", ("2026-05-03 00:00", "day")),
        ("12 December 2026 at 12:05 AM", ("2026-12-12 00:05", "minute")), ("31 February 2026 at 10:00", None), ("6 November at 21:07", None), ("5 May 2026 at 25:00", None), ("yesterday", None), (None, None),
    ],
)
def test_parse_exact(spark, text, at):
    assert moment(spark, times.parse_exact(F.col("t")), t=text) == at


@pytest.mark.parametrize(
    ("text", "at"),
    [
        ("just now", ("2026-03-10 12:30", "minute")), ("5m", ("2026-03-10 12:25", "minute")), ("about an hour ago", ("2026-03-10 11:30", "hour")), ("3 d", ("2026-03-07 12:30", "day")),
        ("2w", ("2026-02-24 12:30", "week")), ("a month ago", ("2026-02-08 12:30", "month")), ("1y", ("2025-03-10 12:30", "year")), ("Yesterday at 10:00", ("2026-03-09 10:00", "minute")),
        ("today", ("2026-03-10 00:00", "day")), ("Tuesday at 9:05 AM", ("2026-03-03 09:05", "minute")), ("Monday", ("2026-03-09 00:00", "day")), ("December 30 at 4 PM", ("2025-12-30 00:00", "day")),  # "4 PM" is no clock time
        
        ("March 11 at 8:33 PM", ("2025-03-11 20:33", "minute")), ("March 11 at 10:12", ("2026-03-11 10:12", "minute")), ("29 February", None), ("soon", None), ("7 blocks", None), (None, None), ("x" * 61, None),
    ],
)
def test_parse_relative(spark, text, at):
    now = F.unix_seconds(F.to_timestamp(F.lit("2026-03-10 12:30:20")))  # a Tuesday
    assert moment(spark, times.parse_relative(F.col("t"), now), t=text) == at


def test_resolve(spark):
    def r(**v):
        values = {"exact": None, "label": None, "at": "2026-03-10T20:30:00Z", "off": 300} | v
        return one(spark, times.resolve(F.col("exact"), F.col("label"), F.col("at"), F.col("off").cast("int")), **{k: (str(x) if k == "off" and x is not None else x) for k, x in values.items()})

    assert r(exact="9 March 2026 at 01:00", label="2h") == {"posted_at": "2026-03-09T01:00:00+05:00", "posted_date": "2026-03-09", "posted_at_precision": "minute", "posted_at_source": "time_exact"}
    assert r(label="2h")["posted_at"] == "2026-03-10T23:30:00+05:00"
    assert r(label="today", off=240)["posted_date"] == "2026-03-11"
    assert r(label="1h", off=None)["posted_at"] == "2026-03-10T19:30:00+00:00"
    assert r(label="1h", off=-210)["posted_at"] == "2026-03-10T16:00:00-03:30"
    assert set(r(label="soon").values()) == {None}


SITE = "https://www.facebook.com"


@pytest.mark.parametrize(
    ("url", "canonical", "kind", "role"),
    [
        ("http://m.facebook.com/groups/4711//posts/80?from=feed#top", f"{SITE}/groups/4711/posts/80/", "group_post", "content"),
        ("https://facebook.com/groups/4711/?multi_permalinks=80&tab=1", f"{SITE}/groups/4711/posts/80/", "group_post", "content"),
        (f"{SITE}/groups/4711/posts/80/?comment_id=90&mode=R", f"{SITE}/groups/4711/posts/80/?comment_id=90", "comment", "comment"),
        (f"{SITE}/groups/4711/posts/80/?reply_comment_id=91&comment_id=90", f"{SITE}/groups/4711/posts/80/?comment_id=90&reply_comment_id=91", "reply", "comment"),
        (f"{SITE}/reels/600", f"{SITE}/reels/600/", "reel", "content"), (f"{SITE}/watch/?v=33&autoplay=1", f"{SITE}/watch/?v=33", "video", "content"),
        (f"{SITE}/photo.php?set=a.7&fbid=22", f"{SITE}/photo.php?fbid=22&set=a.7", "photo", "content"), (f"{SITE}/events/44", f"{SITE}/events/44/", "event", "content"),
        (f"{SITE}/marketplace/item/12/?src=x", f"{SITE}/marketplace/item/12/", "marketplace", "content"), (f"{SITE}/hose.club/posts/q1", f"{SITE}/hose.club/posts/q1/", "post", "content"),
        (f"{SITE}/share/r/Zz/", f"{SITE}/share/r/Zz/", "reel", "content"), (f"{SITE}/share/q/Zz/", f"{SITE}/share/q/Zz/", "unknown", "other"), (f"{SITE}/groups/4711/", f"{SITE}/groups/4711/", "unknown", "group"),
        (f"{SITE}/groups/4711/user/5/", f"{SITE}/groups/4711/user/5/", "unknown", "profile"), (f"{SITE}/hashtag/hose", f"{SITE}/hashtag/hose/", "unknown", "hashtag"), (f"{SITE}/help", f"{SITE}/help/", "unknown", "other"),
        (f"{SITE}/hose.fan?comment_id=3", f"{SITE}/hose.fan/?comment_id=3", "unknown", "profile"), (f"{SITE}/profile.php?sk=about&id=9", f"{SITE}/profile.php?id=9", "unknown", "profile"),
        ("https://l.facebook.com/l.php?u=https%3A%2F%2Fhose.example%2Fb%23c&h=1", "https://hose.example/b", "unknown", "external"), ("https://hose.example/b?q=1#c", "https://hose.example/b?q=1", "unknown", "external"),
        ("https://l.facebook.com/l.php?u=https%3A%2F%2Fl.facebook.com%2Fl.php%3Fu%3Dhttps%253A%252F%252Fhose.example%252Fz", "https://hose.example/z", "unknown", "external"),
        ("https://facebook.com.hose.example/groups/1/posts/2", "https://facebook.com.hose.example/groups/1/posts/2", "unknown", "external"),
        (f"{SITE}/story.php?story_fbid=1%7E2*&id=", f"{SITE}/story.php?story_fbid=1~2%2A", "post", "content"), ("ftp://hose.example/b", None, "unknown", "none"), ("", None, "unknown", "none"), (None, None, "unknown", "none"),
    ],
)
def test_urls(spark, url, canonical, kind, role):
    found = one(spark, F.struct(urls.canonical_url(F.col("u")).alias("c"), urls.kind_of(F.col("u")).alias("k"), urls.role_of(F.col("u")).alias("r")), u=url)
    assert (found["c"], found["k"], found["r"]) == (canonical, kind, role)


def test_url_keys_and_links(spark):
    post = f"{SITE}/groups/4711/posts/80/"

    def key(kind, post_url=None, comment_url=None, author_url=None):
        return one(spark, urls.url_key(*[F.col(c) for c in "kpca"]), k=kind, p=post_url, c=comment_url, a=author_url)

    assert key("group_post", post) == "url:/groups/4711/posts/80/"
    assert key("comment", None, post + "?comment_id=Y29tbWVudDo4MF85MA") == "comment:90"
    assert key("comment", None, post + "?comment_id=abc") == "comment:abc" and key("comment", post) is None
    assert key("reply", None, post + "?comment_id=90&reply_comment_id=91") == "comment:91"
    assert key("post", f"{SITE}/permalink.php?story_fbid=pfbid0q&id=1") is None and key("post", f"{SITE}/share/p/Q/") is None and key(None) is None
    assert key("photo", f"{SITE}/photo/?fbid=22&set=a.7") == "url:/photo/?fbid=22"
    assert key("profile", f"{SITE}/Hose.Fan") == "profile:/hose.fan/?" and key("profile", "", None, f"{SITE}/profile.php?id=9") == "profile:/profile.php?id=9"
    assert one(spark, urls.photo_group_post(F.col("p"), F.col("g")), p=f"{SITE}/photo/?fbid=1&set=pcb.80", g=f"{SITE}/groups/Hoses/") == f"{SITE}/groups/Hoses/posts/80/"
    assert one(spark, urls.without_comment(F.col("u")), u=post + "?comment_id=9&v=1") == post + "?v=1"
    assert one(spark, urls.same_url_identity(F.col("a"), F.col("b")), a="url:/photo/?fbid=1", b="url:/x/") is True
    links = [{"i": 0, "href": f"{SITE}/photo/?fbid=22", "text": "", "img": True}, {"i": 1, "href": post, "text": "2h", "img": False}, {"i": 2, "href": f"{SITE}/hose.fan", "text": " Hose Fan\nx", "img": False}]
    only = [{"i": 4, "href": post + "?comment_id=90", "text": "1h", "img": False}]
    df = spark.createDataFrame([(links,), (only,), ([],), (None,)], "links array<struct<i:int,href:string,text:string,img:boolean>>")
    picked = [tuple(r[0]) if r[0] else (None, None, None) for r in df.select(urls.picked_permalink(F.col("links"))).collect()]
    assert picked == [(post, "group_post", 1), (post, "group_post", None), (None, None, None), (None, None, None)]
    assert [r[0] and r[0]["name"] for r in df.select(urls.first_named_link(F.col("links"), "profile")).collect()] == ["Hose Fan", None, None, None]
    assert urls.search_address("a b", "4711") == f"{SITE}/groups/4711/search/?q=a%20b" and urls.search_address("a") == f"{SITE}/search/posts/?q=a"
    assert urls.listing_address("a b", "/town/") == f"{SITE}/marketplace/town/search/?query=a%20b"


@pytest.mark.parametrize(
    ("text", "author", "keywords", "kind", "expected"),
    [
        ("Pump for sale, call now 0300 1234567, Rs 5000", None, ["pump"], "post", "promotion"), ("Two helpers needed, internship possible, apply now", None, ["pump"], "post", "job"),
        ("Lucky draw! tag 3 friends", None, ["pump"], "post", "giveaway"), ("Earn money daily, work from home", None, ["pump"], "post", "spam"),
        ("I bought this pump and it is the worst, paid Rs 5000, whatsapp me", None, ["pump"], "post", None), ("The pump makes a noise", None, ["pump"], "post", None),
        ("New colours", "Sunpump Official", ["sunpump"], "post", "promotion"), ("Nice pump", None, ["pump"], "marketplace", "marketplace"), ("", None, None, "post", None), (None, None, None, None, None),
        ("Power: 5W\nWeight: 2kg\nSize: 3cm\nColour: red\nbrand new in stock", None, [], "post", "promotion"),
    ],
)
def test_classify(spark, text, author, keywords, kind, expected):
    df = spark.createDataFrame([(text, author, keywords, kind)], "t string, a string, k array<string>, kind string")
    got = df.select(content.classify(F.col("t"), F.lit(None).cast("string"), F.col("a"), F.col("k"), F.col("kind")).alias("c")).first()[0]
    assert got["content_type"] == expected and (got["content_reason"] is None) is (expected is None)


def test_pseudonym_is_hmac(spark):
    salt = bytes(range(40))
    want = "a_" + hmac.new(salt, "some name ü".encode(), hashlib.sha256).hexdigest()[:12]
    assert one(spark, identity.pseudonym(F.col("t"), salt), t=" Some Name Ü ") == want
    assert one(spark, identity.pseudonym(F.col("t"), salt), t="") is None
    long = bytes(100)
    assert one(spark, identity.pseudonym(F.col("t"), long), t="x") == "a_" + hmac.new(long, b"x", hashlib.sha256).hexdigest()[:12]


def test_listings(spark):
    card = one(spark, listings.parse_card(F.col("t"), F.col("a")), t="PKR640\nPKR900\nGarden hose\ngreen\nTownville", a="Garden hose green in Townville")
    assert card == {"title": "Garden hose green", "price": "PKR640", "location": "Townville"}
    assert one(spark, listings.parse_card(F.col("t"), F.col("a")), t="Hose", a="") == {"title": "Hose", "price": None, "location": None}
    assert one(spark, listings.parse_card(F.col("t"), F.col("a")), t=None, a=None)["price"] is None
    page = one(spark, listings.parse_page(F.col("t")), t="Hose\nListed 2 weeks ago in\nTownville\nDetails\nCondition\nUsed\nGood hose\nSee more\nSeller information\nX\nRelated searches\nListed now in Y")
    assert page == {"listed_text": "2 weeks ago", "location": "Townville", "condition": "Used", "description": "Good hose"}
    assert set(one(spark, listings.parse_page(F.col("t")), t=None).values()) == {None}


def test_small_text_functions(spark):
    assert one(spark, X.group_name_from_title(F.col("t")), t="(3) Search results | Pump Fans | Facebook") == "Pump Fans"
    assert one(spark, X.image_text(F.split("t", "\n")), t="No photo description available.\na\na") == "a"
    assert one(spark, X.without_names(F.col("t"), F.col("n")), t="hi Ann Lee and Ann", n=["Ann", "Ann Lee"]) == "hi \n and \n"
    assert one(spark, X.slugify(F.col("t")), t="  Garden Hose! ") == "garden-hose" and one(spark, X.slugify(F.col("t")), t="!!!") == "keyword"
    assert one(spark, X.contains_like(F.col("t"), "a\\b%D"), t="xA\\B..d") is True
    assert one(spark, X.same_author(F.col("t"), F.lit("ann  LEE")), t="Ann Lee") is True
