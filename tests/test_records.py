"""Goldens of record mappings."""

from pyspark.sql import functions as F

from tidewater.functions import records as r


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_auction(spark):
    schema = "status string, start double, awards array<struct<status string, amount double>>, contracts array<struct<status string, amount double>>, bids array<struct<amount double>>, name map<string,string>"
    rows = [("complete", 100.0, [("unsuccessful", 200.0), ("active", 130.0)], [("pending", 131.0), ("signed", 135.5)], [(150.0,), (120.0,)], {"uk": "-", "en": "Lot"}), ("cancelled", 861.84, None, None, None, {"uk": "** *"}), ("active", None, [], [], [], None)]
    df = spark.createDataFrame(rows, schema)
    got = df.select(r.auction_result(F.col("status"), F.col("start"), F.col("awards"), F.col("contracts"), F.col("bids")).alias("x"), r.pick_lang(F.col("name"), "uk", "en").alias("n")).collect()
    assert [(*g["x"], g["n"]) for g in got] == [("sold", 135.5, 150.0, 35.5, "Lot"), ("cancelled", None, None, None, "[redacted]"), ("in_progress", None, None, None, None)]
    x = one(spark, m=r.method_parts(F.lit("land-lease-english")), p=r.unless_masked(F.lit("a@**")), o=r.organisation(a=F.lit(None).cast("string")))
    assert tuple(x["m"]) == ("land", "lease-english") and x["p"] is None and x["o"] is None
    docs = spark.createDataFrame([([("1", "t", "u")], None)], "a array<struct<id string, title string, url string>>, b array<struct<id string, title string, url string>>")
    assert [tuple(d) for d in docs.select(r.with_origin(lot=F.col("a"), award=F.col("b")).alias("d")).first()["d"]] == [("lot", "1", "t", "u")]


def test_permit(spark):
    states = ("KY", "FL")
    for text, want in (("3920 PFLANZ AVE, LOUISVILLE KY 40212 *", ("3920 PFLANZ AVE", "Louisville", "KY", "40212")), ("4501 W GANDY BLVD N UNIT 3 TAMPA FL 33611", ("4501 W GANDY BLVD N UNIT 3", "Tampa", "FL", "33611")), ("LOT 5 SUNSET HILLS", ("LOT 5 SUNSET HILLS", None, None, None))):
        assert tuple(one(spark, a=r.address_parts(F.lit(text), states))["a"]) == want
    c = one(spark, c=r.contact(F.array(F.lit("ABC ROOFING INC"), F.lit("Business Phone: (813) 555-0101"), F.lit("Contractor License #RC29027"))))["c"]
    assert (c["company"], c["phone"], c["license"], c["name"]) == ("ABC ROOFING INC", "(813) 555-0101", "RC29027", None)
    assert one(spark, d=r.without_persons(F.create_map(F.lit("Owner Name"), F.lit("x"))))["d"] is None


def test_prices(spark):
    p = one(spark, p=r.promotion(F.lit(2.0), F.lit(4.8), F.lit(True)), q=r.promotion(F.lit(9.5), F.lit(9.0)), t=r.promo_text(F.lit("Half price"), F.lit(" "), F.lit("Half price"), F.lit("Save")), n=r.branded_name(F.lit("Acme"), F.lit("Acme tea")), s=r.stay_price(F.lit(None).cast("double"), F.lit(10.5), F.lit(3)))
    assert tuple(p["p"]) == (4.8, 2.8, "HALF_PRICE") and tuple(p["q"]) == (None, None, None) and p["t"] == "Half price · Save" and p["n"] == "Acme tea" and tuple(p["s"]) == (10.5, 31.5)
    rooms = spark.createDataFrame([([("a", None), ("b", 2.0), ("c", 2.0)],)], "r array<struct<name string, price double>>")
    assert rooms.select(r.best_rate(F.col("r")).alias("b")).first()["b"]["name"] == "b"
    groups = spark.createDataFrame([([([(1, False), (2, True), (3, None)],), (None,)],)], "g array<struct<products array<struct<id int, is_ad boolean>>>>")
    assert [x["id"] for x in r.unwrap_groups(groups, "g").collect()] == [1, 3]
    img = spark.createDataFrame([([("BACK", "b"), ("FRONT", "u?w={width}")],)], "a array<struct<kind string, url string>>")
    assert img.select(r.image_of(F.col("a"), ("FRONT", "BACK"), 9999).alias("u")).first()["u"] == "u?w=2000"


def test_trends_and_pages(spark):
    pts = spark.createDataFrame([(1, [(0, [5, 7], [True, False], None), (86400, [1, 2], None, True)])], "k int, p array<struct<time long, values array<int>, has_data array<boolean>, partial boolean>>")
    rows = r.timeline_rows(pts, ["k"], "p", F.array(F.lit("x"), F.lit("y")), F.lit("DAY")).collect()
    assert [(t["term"], t["at"], t["value"], t["partial"]) for t in rows] == [("x", "1970-01-01", 5, False), ("y", "1970-01-01", None, False), ("x", "1970-01-02", 1, True), ("y", "1970-01-02", 2, True)]
    rel = spark.createDataFrame([(1, [("q", "Breakout", "/e")], [("p", "+1,250%", "http://z")])], "k int, top array<struct<query string, value string, link string>>, rising array<struct<query string, value string, link string>>")
    assert [(x["kind"], x["rank"], x["value"], x["breakout"], x["link"]) for x in r.related_rows(rel, ["k"], ("top", "rising"), "http://b").collect()] == [("top", 1, None, True, "http://b/e"), ("rising", 1, 1250, False, "http://z")]
    html = '<html lang="en"><meta property="og:description" content="D"><meta name="author" content="http://a"><link rel="canonical" href="C"><li><a href="1">one</a></li><li><a href="2">two</a></li>'
    x = one(spark, m=r.head_meta(F.lit(html)), c=r.related_coverage(F.lit(html)), s=r.term_status(a=F.lit(1), b=F.lit(None)), n=r.count_range(F.lit(100), F.lit(None).cast("int")), o=r.objects_with(F.lit('{"a": [{"h": 1, "b": {"h": 2}}, [{"h": 3}]]}'), "h"), v=r.video_id(F.struct(F.lit("https://youtu.be/abcdefghijk").alias("u"))))
    assert tuple(x["m"]) == ("D", None, None, "C", "en") and [tuple(y) for y in x["c"]] == [("2", "two")] and x["s"] == "partial" and x["n"] == "100+"
    assert x["o"] == ['{"b":{"h":2},"h":1}', '{"h":3}'] and x["v"] == "abcdefghijk"
